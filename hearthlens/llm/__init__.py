"""Operators for preparing training text: fingerprints, filters, deduplication, tokens and packing."""
