"""Words of UTF-8 texts by byte translation: one 256-byte table lower-cases A-Z and blanks separators."""

from __future__ import annotations

from collections.abc import Iterator

BLOCK_BYTES = 1 << 20


def byte_table(kept: bytes) -> bytes:
    """Translation table: A-Z become a-z, ASCII bytes outside ``kept`` a space; bytes from 0x80 on stay as they are.

    Every byte of a character beyond ASCII is at least 0x80, so such characters pass whole.
    """
    lower = bytes(range(256)).lower()
    return bytes(b if b >= 0x80 or b in kept else 0x20 for b in lower)


LETTERS = byte_table(b"abcdefghijklmnopqrstuvwxyz")
LETTERS_AND_DIGITS = byte_table(b"abcdefghijklmnopqrstuvwxyz0123456789")


def word_blocks(text: bytes | None, table: bytes, block: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words of a whole text in order, in lists of about ``block`` bytes of text; null and empty texts give none."""
    clean = (text or b"").translate(table)
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + block)
        end = len(clean) if end < 0 else end
        words = clean[at:end].split()
        if words:
            yield words
        at = end
