"""Encrypted secret columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _key(passphrase: Column) -> Column:
    return F.unhex(F.sha2(passphrase, 256))


def encrypted_json(value: Column, passphrase: Column) -> Column:
    """Base64 text of the AES-GCM cipher of a JSON object; an empty object becomes empty text."""
    empty = value.isNull() | value.isin("", "{}")
    return F.when(empty, "").otherwise(F.base64(F.aes_encrypt(value, _key(passphrase), F.lit("GCM"))))


def decrypted_json(cipher: Column, passphrase: Column) -> Column:
    """The JSON object of a cipher text; empty text becomes `{}`, an unreadable cipher becomes null."""
    plain = F.try_aes_decrypt(F.try_to_binary(cipher, F.lit("base64")), _key(passphrase), F.lit("GCM"))
    return F.when(cipher.isNull() | (cipher == ""), "{}").otherwise(plain.cast("string"))
