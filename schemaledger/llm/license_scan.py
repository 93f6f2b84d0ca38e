"""License scans: an exact set-similarity join of text blocks with license templates, by containment.

A block of a template is any run of as many words as the template has (a shorter text is one block). It meets the
template if it holds at least ``threshold`` of the template's distinct words; phrases ask for all of them, consecutive
and in order. Words of the templates are ordered by their frequency in the whole corpus, rarest first, and

- prefix filter: a block that meets the template holds one of its rarest words, so many that the rest could not reach
  the threshold; an inverted index leads from these words to templates, and only blocks around such a word are looked at;
- length filter: a text that shares fewer of the template's words than the threshold needs is not looked at;
- positional filter: such a word counts only if the words that template and text share behind it are enough as well.

The survivors are verified exactly: each occurrence of a word counts for the blocks that start between its previous
occurrence and itself, so a running sum over these borders is the overlap of every block, whatever the text's length.

Only the templates travel with the tasks; they are a stated list, refused above ``MOST_TEMPLATE_BYTES``.

Edge cases: null and empty texts have no words and no match. Equal words in a template count once for containment, but
every time for the block's length. Templates without words never match. Repeated rows are scanned one by one, an empty
table gives an empty result; ``n_words`` and ``matches`` replace columns of these names, others pass through.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .byte_words import LETTERS_AND_DIGITS, word_blocks

MOST_TEMPLATE_BYTES = 16 << 20
MATCHES = "array<struct<label: string, exact: boolean, start: long, words: long, containment: double>>"
_MATCH = pa.list_(pa.struct([("label", pa.string()), ("exact", pa.bool_()), ("start", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())]))


@dataclass(frozen=True)
class Template:
    """Words in order; ``exact`` ones have to stand consecutively."""

    label: str
    words: tuple[bytes, ...]
    exact: bool


def templates(pairs: Sequence[tuple[str, str]], exact: bool) -> list[Template]:
    """Templates from (text, label) pairs."""
    found = [Template(label, tuple(w for part in word_blocks(text.encode(), LETTERS_AND_DIGITS) for w in part), exact) for text, label in pairs]
    return [t for t in found if t.words]


def word_frequencies(docs: DataFrame, words: set[bytes], text_col: str) -> dict[bytes, int]:
    """In how many texts of the whole table each of ``words`` stands; the result is as large as ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                held: set[bytes] = set()
                for part in word_blocks(text.as_py(), LETTERS_AND_DIGITS):
                    held |= words.intersection(part)
                counts.update(held)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
    found = {bytes(r["word"]): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(w, 0) for w in words}


class Index:
    """Templates with their words as numbers in the global order, rarest first, and the index of their prefixes."""

    def __init__(self, known: Sequence[Template], frequencies: Mapping[bytes, int], threshold: float):
        in_order = sorted({w for t in known for w in t.words}, key=lambda w: (frequencies.get(w, 0), w))
        self.numbers = {w: i for i, w in enumerate(in_order)}
        self.templates = known
        self.sequences = [np.array([self.numbers[w] for w in t.words]) for t in known]
        self.sets = [np.unique(s) for s in self.sequences]
        self.needed = [len(s) if t.exact else max(1, ceil(threshold * len(s) - 1e-9)) for s, t in zip(self.sets, known)]
        self.by_prefix: dict[int, list[int]] = defaultdict(list)
        for i, (own, needed) in enumerate(zip(self.sets, self.needed)):
            for number in own[: len(own) - needed + 1].tolist():
                self.by_prefix[number].append(i)

    def matches(self, text: bytes | None) -> tuple[int, list[tuple]]:
        """Number of words of a text, and its matches in order of start: label, exact, start, words, containment."""
        n_words, places, found = 0, [], []
        number_of = self.numbers.get
        for part in word_blocks(text, LETTERS_AND_DIGITS):
            numbers = np.fromiter((number_of(w, -1) for w in part), np.int64, len(part))
            hits = np.flatnonzero(numbers >= 0)
            places.append(hits + n_words)
            found.append(numbers[hits])
            n_words += len(part)
        if not n_words:
            return 0, []
        at, numbers = np.concatenate(places), np.concatenate(found)
        held = np.unique(numbers)
        candidates = sorted({i for number in held.tolist() for i in self.by_prefix.get(number, ())})
        out = [match for i in candidates for match in self._verified(i, n_words, at, numbers, held)]
        return n_words, sorted(out, key=lambda m: (m[2], m[0], m[3]))

    def _verified(self, i: int, n_words: int, at: np.ndarray, numbers: np.ndarray, held: np.ndarray) -> list[tuple]:
        own, needed, size = self.sets[i], self.needed[i], len(self.sequences[i])
        shared = np.intersect1d(own, held, assume_unique=True)
        prefix = np.intersect1d(own[: len(own) - needed + 1], shared[: max(0, len(shared) - needed + 1)], assume_unique=True)
        chosen = np.isin(numbers, own)
        at, numbers = at[chosen], numbers[chosen]
        rare = at[np.isin(numbers, prefix)]
        if not len(rare):
            return []
        after = np.searchsorted(rare, at)
        gap = np.minimum(np.abs(at - rare[np.maximum(after - 1, 0)]), np.abs(at - rare[np.minimum(after, len(rare) - 1)]))
        at, numbers = at[gap < size], numbers[gap < size]
        starts, ends, overlap = overlaps(at, numbers, size, n_words)
        label, exact = self.templates[i].label, self.templates[i].exact
        if exact:
            places = [s for a, b, o in zip(starts.tolist(), ends.tolist(), overlap.tolist()) if o == needed for s in range(a, b)]
            number_at = dict(zip(at.tolist(), numbers.tolist()))
            sequence = self.sequences[i].tolist()
            return [(label, True, s, size, 1.0) for s in places if all(number_at.get(s + k) == w for k, w in enumerate(sequence))]
        out: list[tuple] = []
        last = -1
        for a, b, o in zip(starts.tolist(), ends.tolist(), overlap.tolist()):
            if o >= needed:
                words, share = min(b - 1 + size, n_words) - a, o / len(own)
                if last == a:  # blocks that start one after another are one match, with the best containment of them
                    begin, best = out[-1][2], out[-1][4]
                    out[-1] = (label, False, begin, a + words - begin, max(best, share))
                else:
                    out.append((label, False, a, words, share))
                last = b
        return out


def overlaps(at: np.ndarray, numbers: np.ndarray, size: int, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of block starts (from, to, exclusive) and the number of distinct ``numbers`` in each block of ``size`` words.

    ``at`` ascends. Starts outside all ranges have none.
    """
    order = np.lexsort((at, numbers))
    sorted_at, sorted_numbers = at[order], numbers[order]
    previous = np.full(len(at), -1, np.int64)
    same = sorted_numbers[1:] == sorted_numbers[:-1]
    previous[1:][same] = sorted_at[:-1][same]
    latest = max(0, n_words - size)
    begin = np.maximum(np.maximum(sorted_at - size + 1, previous + 1), 0)
    end = np.minimum(sorted_at, latest) + 1
    real = begin < end
    borders = np.concatenate((begin[real], end[real]))
    steps = np.concatenate((np.ones(int(real.sum()), np.int64), np.full(int(real.sum()), -1, np.int64)))
    places, which = np.unique(borders, return_inverse=True)
    change = np.bincount(which, weights=steps, minlength=len(places)).astype(np.int64) if len(places) else np.zeros(0, np.int64)
    total = np.cumsum(change)[:-1]
    return places[:-1], places[1:], total


def scan_licenses(
    docs: DataFrame, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]], threshold: float = 0.8, text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``n_words`` long and ``matches``: every place of a phrase, every text block that meets a notice.

    ``phrases`` and ``notices`` are (text, label) pairs. A match has ``label``, ``exact`` (of a phrase), ``start`` (word,
    from 0), ``words`` and ``containment``; blocks that overlap without a gap between their starts are one match.
    """
    if sum(len(text.encode()) for text, _ in [*phrases, *notices]) > MOST_TEMPLATE_BYTES:
        raise ValueError("templates are sent to every task; scan this many in several calls")
    known = templates(phrases, True) + templates(notices, False)
    index = Index(known, word_frequencies(docs, {w for t in known for w in t.words}, text_col), threshold)
    names = [c for c in docs.columns if c not in ("n_words", "matches")]
    own = names.index(text_col)
    rows = docs.select(*[F.col(f"`{c}`").cast("binary") if c == text_col else F.col(f"`{c}`") for c in names]).toDF(*[f"c{k}" for k in range(len(names))])
    shape = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + ["n_words long", f"matches {MATCHES}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.matches(text.as_py()) for text in batch.column(own)]
            counts = pa.array([n for n, _ in found], pa.int64())
            spans = pa.array([[dict(zip(("label", "exact", "start", "words", "containment"), m)) for m in all_of] for _, all_of in found], _MATCH)
            yield pa.RecordBatch.from_arrays([*batch.columns, counts, spans], [*batch.schema.names, "n_words", "matches"])

    return rows.mapInArrow(run, shape).toDF(*names, "n_words", "matches").withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
