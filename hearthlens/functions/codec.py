"""Decoding of stored bytes: character sets, base64, encrypted image addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def decode_utf8(data: Column) -> Column:
    return F.decode(data, "UTF-8")


def decode_base64(text: Column) -> Column:
    """Bytes of base64 text, null when the text is not base64."""
    return F.try_to_binary(text, F.lit("base64"))


def decrypt_text(text: Column, key: Column | str) -> Column:
    """Plain text of base64 AES text in ECB mode with block padding, null where it does not decrypt.

    The key has 16, 24 or 32 bytes and is configuration: pass it in, keep it out of source files.
    """
    key = key if isinstance(key, Column) else F.lit(key)
    data = decode_base64(text)
    # even an empty text is encrypted to a whole block, so no bytes at all are not a text
    return F.when(F.octet_length(data) > 0, decode_utf8(F.try_aes_decrypt(data, key, F.lit("ECB"), F.lit("PKCS"))))


def encrypt_text(text: Column, key: Column | str) -> Column:
    key = key if isinstance(key, Column) else F.lit(key)
    return F.base64(F.aes_encrypt(F.encode(text, "UTF-8"), key, F.lit("ECB"), F.lit("PKCS")))
