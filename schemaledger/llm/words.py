"""Words and word runs of whole texts as 64-bit hashes, in numpy, many texts at once.

A word's hash is the sum of its bytes' random values, each times the random value of its place in the word, mixed once; a
run's is the same sum over its words. All sums come from running totals, so words of any length cost one pass. The values
of places are random and not powers of one base, so no family of texts collides by construction, as with polynomials
modulo 2**64.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np

# The constants of a public 64-bit mixer (splitmix64).
_MIX_1, _MIX_2, _MIX_3 = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BLOCK_BYTES = 1 << 17


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes from hashes: another order of the same values for each ``seed``."""
    x = x + np.uint64(_MIX_1 * (seed + 1) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * _MIX_2
    x = (x ^ (x >> np.uint64(27))) * _MIX_3
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _values(seed: int, bits: int) -> np.ndarray:
    """The first 2**bits odd random values of a seed."""
    return mixed(np.arange(1 << bits, dtype=np.uint64), 100 + seed) | np.uint64(1)


def canonical(text: str | None) -> bytes:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, joined by one space; null gives no words."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) if text else b""


def hashed_runs(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of canonical texts, and the number of runs of each text.

    A text of fewer words gives one run, the whole text; a text without words gives none.
    """
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    counts = np.zeros(len(words), np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), counts
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    edges = np.concatenate(([0], np.cumsum(lengths + 1)))
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)[: len(data)]
    of_place = _values(2, max(20, int(place.max()).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_values(1, 8)[data] * of_place[place], out=total[1:])
    filled = ends > starts  # texts without words leave an empty word between two separators
    starts, ends = starts[filled], ends[filled]
    word = mixed(total[ends] - total[starts] + (ends - starts).astype(np.uint64))
    first_word = np.searchsorted(starts, edges)
    n_words = np.diff(first_word)
    counts = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
    text = np.repeat(np.arange(len(words)), counts)
    first = first_word[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    held = np.minimum(n_words[text], size)
    run = held.astype(np.uint64)
    for k, value in enumerate(of_place[:size]):
        part = word[np.minimum(first + k, len(word) - 1)] * value
        part[k >= held] = 0
        run += part
    return mixed(run), counts


def in_blocks(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    """Canonical texts in blocks of about an eighth of a megabyte; a longer text is a block of its own."""
    block, held = [], 0
    for text in texts:
        words = canonical(text)
        if block and held + len(words) > _BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append(words)
        held += len(words) + 1
    if block:
        yield block


def shingle_sets(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct run hashes of every text, ascending within a text, and how many each text has."""
    hashes, counts = hashed_runs(words, size)
    text = np.repeat(np.arange(len(words)), counts)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=len(words))
