"""Text pieces, escaping and number formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Markup characters and their escapes, the ampersand first.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]


def escape_markup(text: Column) -> Column:
    for char, entity in ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def unescape_markup(text: Column) -> Column:
    """The reverse of :func:`escape_markup`, the ampersand last."""
    for char, entity in reversed(ESCAPES):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def join_pieces(pieces: Column, separator: str = "-") -> Column:
    return F.array_join(pieces, separator)


def first_token(text: Column) -> Column:
    """The first of the tokens separated by white space; null for blank text."""
    return F.nullif(F.get(F.split(F.trim(text), r"\s+"), F.lit(0)), F.lit(""))


def fixed_point(value: Column, digits: int = 2) -> Column:
    """A number with a fixed count of decimals. Halves are judged on the exact binary value and true
    ties go to the even digit, as in C and Python; ``format_string`` and ``round`` go by the
    shortest decimal text instead and differ for numbers like 2.675."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def round_exact(value: Column, digits: int = 2) -> Column:
    """Rounding with the same rule."""
    return fixed_point(value, digits).cast("double")
