"""Benchmark decontamination: every passage of every document is a BM25 query against an inverted index of test items.

An impact is a term's BM25 weight in an item, divided by the item's weight of all its terms, so a score is the covered
share of the item (at most 1) and one threshold serves short and long items. Items are ordered by length and lie in
blocks; a term knows its largest impact in each block. The sums of these block maxima are taken for all passages of many
texts at once; a passage without a block that can reach the threshold is done. The others run block-max WAND, which
returns every item at or above the threshold.
Hits are verified by the word runs of question and answer, which must both be there.

Words are runs without white space and ASCII punctuation, A-Z lower-cased. Test items are a stated query set: they go to
the tasks in blocks of a documented size; counts (items, lengths, item frequencies) are taken over all of them.
"""

from __future__ import annotations

import math
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W

ITEMS_PER_BLOCK = 20_000
BLOCK_ITEMS = 8          # items that share a block maximum
CHUNK = 1 << 16          # (passage, term) pairs whose bounds are summed at a time
K1, B = 1.2, 0.75
_LEAK = ("item_id", "first_word", "score", "question_overlap", "answer_overlap")
_WORD_BYTES = bytes.maketrans((string.punctuation + string.ascii_uppercase).encode(), (" " * len(string.punctuation) + string.ascii_lowercase).encode())


def plain_words(text: str | None) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()) if text else b""


def term_hashes(words: bytes) -> np.ndarray:
    return W.hashed_runs([words], 1)[0].view(np.int64)


class ItemIndex:
    """Inverted index of one block of test items with block maxima, and the items' parts for verification."""

    def __init__(self, items: list[tuple[object, str]], df: dict[int, int], n_items: int, mean_words: float, theta: float):
        self.theta = theta
        items = sorted(items, key=lambda item: plain_words(item[1]).count(b" "))
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(text) for _, text in items]
        self.longest = 1
        postings: dict[int, list[tuple[int, float]]] = {}
        for at, (_, text) in enumerate(items):
            terms = term_hashes(plain_words(text)).tolist()
            self.longest = max(self.longest, len(terms))
            weight = {
                t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(terms) / mean_words))
                for t, tf in Counter(terms).items()
            }
            whole = sum(weight.values())
            for t, w in weight.items():
                postings.setdefault(t, []).append((at, w / whole))
        self.terms = np.array(sorted(postings), dtype=np.int64)
        lists = [postings[t] for t in self.terms.tolist()]
        self.items = [[i for i, _ in p] for p in lists]
        self.impacts = [[w for _, w in p] for p in lists]
        maxima: list[dict[int, float]] = [{} for _ in lists]
        for held, postings_of in zip(maxima, lists):
            for item, impact in postings_of:
                held[item // BLOCK_ITEMS] = max(impact, held.get(item // BLOCK_ITEMS, 0.0))
        self.block_max = maxima
        self.blocks = -(-len(items) // BLOCK_ITEMS)
        self.first_block = np.concatenate(([0], np.cumsum([len(m) for m in maxima]))).astype(np.int64)
        self.block = np.array([b for m in maxima for b in m], np.int64)
        self.block_impact = np.array([w for m in maxima for w in m.values()])

    def hopeful(self, passage: np.ndarray, term: np.ndarray, passages: int) -> Iterator[tuple[int, list[int]]]:
        """Passages with the blocks whose maxima, summed over the distinct terms, reach theta; pairs are in passage order."""
        size = max(1, (1 << 22) // max(self.blocks, 1))
        cuts = np.union1d(np.arange(0, passages, size), passage[CHUNK - 1:: CHUNK])
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), passages]):
            a, b = np.searchsorted(passage, (lo, hi))
            t = term[a:b]
            begin, n = self.first_block[t], self.first_block[t + 1] - self.first_block[t]
            at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            key = np.repeat(passage[a:b] - lo, n) * self.blocks + self.block[at]
            sums = np.bincount(key, weights=self.block_impact[at], minlength=(hi - lo) * self.blocks)
            of, block = np.divmod(np.flatnonzero(sums >= self.theta - 1e-9), self.blocks)
            for k in np.unique(of).tolist():
                yield lo + k, block[slice(*np.searchsorted(of, (k, k + 1)))].tolist()

    def search(self, terms: list[int], blocks: Iterable[int] | None = None) -> list[tuple[int, float]]:
        """Every item of ``blocks`` (all by default) with a score of at least theta for these distinct terms."""
        return [hit for block in (range(self.blocks) if blocks is None else blocks) for hit in self._search_block(terms, block)]

    def _search_block(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """WAND inside a block of items; the block maxima are the terms' upper bounds."""
        found, least, end = [], self.theta - 1e-9, (block + 1) * BLOCK_ITEMS
        lists = []  # current item, its place in the postings, the term's bound, the term
        for t in terms:
            most = self.block_max[t].get(block)
            if most is not None:
                at = bisect_left(self.items[t], block * BLOCK_ITEMS)
                lists.append((self.items[t][at], at, most, t))
        while lists:
            lists.sort()
            bound = 0.0
            for pivot, _, most, _ in lists:  # no item before the pivot can reach theta
                bound += most
                if bound >= least:
                    break
            else:
                return found
            if lists[0][0] == pivot:
                score = sum(self.impacts[t][at] for item, at, _, t in lists if item == pivot)
                if score >= least:
                    found.append((pivot, score))
                pivot += 1
            moved = []
            for item, at, most, t in lists:
                if item < pivot:
                    own = self.items[t]
                    at = bisect_left(own, pivot, at)
                    if at == len(own) or own[at] >= end:
                        continue
                    item = own[at]
                moved.append((item, at, most, t))
            lists = moved
        return found


def question_and_answer(text: str) -> tuple[bytes, bytes]:
    """An item's last sentence is its answer, the rest its question; of a single sentence, the last third of the words."""
    sentences = [w for w in (plain_words(s) for s in text.replace("!", ".").replace("?", ".").replace("\n", ".").split(".")) if w]
    if len(sentences) > 1:
        return b" ".join(sentences[:-1]), sentences[-1]
    words = sentences[0].split() if sentences else []
    cut = len(words) - len(words) // 3
    return b" ".join(words[:cut]), b" ".join(words[cut:])


def overlap(part: bytes, passage: bytes, size: int) -> float:
    """Share of the part's distinct word runs that the passage holds; 1 for an empty part."""
    size = min(size, part.count(b" ") + 1)
    wanted = np.unique(W.hashed_runs([part], size)[0])
    return float(np.isin(wanted, W.hashed_runs([passage], size)[0]).mean()) if len(wanted) else 1.0


def leaks_in(texts: list[str | None], index: ItemIndex, least: float, run_words: int) -> list[list[tuple]]:
    """``(item_id, first word, score, question overlap, answer overlap)`` of the best passage of each item, for each text."""
    words = [plain_words(t) for t in texts]
    out: list[dict[int, tuple]] = [{} for _ in texts]
    hashes, n = W.hashed_runs(words, 1)
    if not len(hashes) or not len(index.terms):
        return [[] for _ in texts]
    hashes = hashes.view(np.int64)
    term = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = index.terms[term] == hashes
    step, begin = index.longest, np.cumsum(n) - n
    passages = np.maximum(-(-n // step) - 1, (n > 0).astype(np.int64))  # passages of two steps, one step apart
    text = np.repeat(np.arange(len(texts)), passages)
    first = begin[text] + step * (np.arange(len(text)) - np.repeat(np.cumsum(passages) - passages, passages))
    size = np.minimum(first + 2 * step, (begin + n)[text]) - first
    place = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    passage = np.repeat(np.arange(len(text)), size)[known[place]]
    pair = np.sort(passage * len(index.terms) + term[place[known[place]]])
    pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
    passage, of_passage = np.divmod(pair, len(index.terms))
    for k, blocks in index.hopeful(passage, of_passage, len(text)):
        lo, hi, at = int(first[k]), int(first[k] + size[k]), int(text[k])
        hits = index.search(of_passage[slice(*np.searchsorted(passage, (k, k + 1)))].tolist(), blocks)
        if not hits:
            continue
        own = words[at].split(b" ")
        held = b" ".join(own[lo - int(begin[at]): hi - int(begin[at])])
        for item, score in hits:
            question, answer = (overlap(part, held, run_words) for part in index.parts[item])
            if question >= least and answer >= least and score > out[at].get(item, (0, 0, -1.0))[2]:
                out[at][item] = (index.ids[item], lo - int(begin[at]), float(score), question, answer)
    return [sorted(found.values(), key=lambda x: (x[1], str(x[0]))) for found in out]


def _blocks_of_items(benchmark: DataFrame, item_col: str, text_col: str, theta: float) -> Iterator[ItemIndex]:
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")

    def terms(batches):
        for batch in batches:
            sets = [term_hashes(plain_words(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in sets], pa.int64()), pa.array([np.unique(s) for s in sets], pa.list_(pa.int64()))], ["n", "terms"])

    counted = items.select("text").mapInArrow(terms, "n long, terms array<long>")
    total = counted.where("n > 0").agg(F.count("*").alias("items"), F.avg("n").alias("mean")).first()
    blocks = -(-total["items"] // ITEMS_PER_BLOCK)
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").count()
    placed = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(blocks, 1))))
    for number in range(blocks):
        of_block = placed.where(F.col("block") == number)
        rows = sorted(((r["item"], r["text"]) for r in of_block.collect() if plain_words(r["text"])), key=lambda r: (str(r[0]), r[1]))
        wanted = of_block.select("text").mapInArrow(terms, "n long, terms array<long>").select(F.explode("terms").alias("term")).distinct()
        frequency = {r["term"]: r["count"] for r in df.join(wanted, "term").collect()}
        if rows:
            yield ItemIndex(rows, frequency, total["items"], total["mean"], theta)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    theta: float = 0.6, least_overlap: float = 0.7, run_words: int = 3,
) -> DataFrame:
    """``docs`` with ``leaks``, an array of ``item_id, first_word, score, question_overlap, answer_overlap``, at the end.

    ``score`` is the best passage's share of the item's BM25 weight (at least ``theta``). Null and empty texts have no
    leaks; null and empty items are never found; equal items are all found. A column ``leaks`` of ``docs`` is replaced,
    all others pass through. An empty benchmark gives empty arrays. Passages span twice the longest item, half over
    half, so each item lies in one passage. One pass per block of ``ITEMS_PER_BLOCK`` items; no shuffle of texts.
    """
    names = [c for c in docs.columns if c != "leaks"]
    at = names.index(text_col)
    item_type = benchmark.schema[item_col].dataType.simpleString()
    leaks_type = f"array<struct<item_id:{item_type},first_word:long,score:double,question_overlap:double,answer_overlap:double>>"
    inner = [f"c{i}" for i in range(len(names))]
    out = docs.select(*[F.col(f"`{c}`") for c in names]).toDF(*inner)
    shape = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in out.schema] + [f"leaks {leaks_type}", f"more {leaks_type}"])
    out = out.withColumn("leaks", F.array().cast(leaks_type))
    for index in _blocks_of_items(benchmark, item_col, item_text_col, theta):

        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct(list(zip(_LEAK, (pa.array(index.ids).type, pa.int64(), pa.float64(), pa.float64(), pa.float64())))))
            for batch in batches:
                for begin in range(0, batch.num_rows, 128):
                    part = batch.slice(begin, 128)
                    found = leaks_in(part.column(at).to_pylist(), index, least_overlap, run_words)
                    more = pa.array([[dict(zip(_LEAK, leak)) for leak in leaks] for leaks in found], kind)
                    yield pa.RecordBatch.from_arrays([*part.columns, more], [*part.schema.names, "more"])

        out = out.mapInArrow(run, shape).select(*inner, F.concat("leaks", "more").alias("leaks"))
    return out.toDF(*names, "leaks")
