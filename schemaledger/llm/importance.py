"""Target-distribution importance resampling: documents drawn by the likeness of their hashed n-grams to a target.

Words come from a byte translation and ``bytes.split``; the hash of a run of words extends the hash of its beginning
(``zlib.crc32`` takes it as seed), and Counters add up runs before anything is shuffled. Corpus and target shrink to one
count per bucket, the only thing that the driver holds: ``buckets`` numbers, whatever the size of the tables.

Edge cases: null and empty texts have no features, weight 0 and are never drawn. A null id counts as an empty one in the
random draw and ranks after equal scores of other ids. Repeated rows are rows of their own, ranked next to each other.
An empty target gives finite gains; an empty table gives an empty result. Only the named columns are read, so further
columns never clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .byte_words import LETTERS_AND_DIGITS, word_blocks
from .ranks import ranked

_HELD = 1 << 18  # distinct runs in a Counter before it is reduced to buckets


def run_hashes(text: bytes | None, longest: int) -> Iterator[tuple[int, list[int]]]:
    """Of a whole text, block by block: the number of new words, and the hashes of all runs that end in them."""
    tail: list[bytes] = []
    for words in word_blocks(text, LETTERS_AND_DIGITS):
        held, joined = len(tail), tail + words
        found = hashes = list(map(crc32, joined))
        found = found[held:]
        later = list(map(b" ".__add__, joined))
        for size in range(2, longest + 1):
            hashes = list(map(crc32, later[size - 1:], hashes))
            found += hashes[max(0, held - size + 1):]
        yield len(words), found
        tail = joined[len(joined) - longest + 1:] if longest > 1 else []


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, longest: int) -> DataFrame:
    """``bucket, n``: all features of all texts, repeats counted; buckets without a feature are absent."""

    def reduced(counts: Counter) -> pa.RecordBatch:
        keys = np.fromiter(counts.keys(), np.int64, len(counts)) % buckets
        place, which = np.unique(keys, return_inverse=True)
        total = np.zeros(len(place), np.int64)
        np.add.at(total, which, np.fromiter(counts.values(), np.int64, len(counts)))
        return pa.RecordBatch.from_arrays([pa.array(place), pa.array(total)], ["bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for _, hashes in run_hashes(text.as_py(), longest):
                    counts.update(hashes)
                    if len(counts) > _HELD:
                        yield reduced(counts)
                        counts = Counter()
        if counts:
            yield reduced(counts)

    rows = texts.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's smoothed share in the target over its share in the corpus."""
    s, t = ({r["bucket"]: r["n"] for r in counts.collect()} for counts in (corpus, target))
    in_all, in_target = sum(s.values()) + buckets, sum(t.values()) + buckets
    return np.array([
        math.floor(1000 * math.log(float((t.get(b, 0) + 1) * in_all) / float((s.get(b, 0) + 1) * in_target))) for b in range(buckets)
    ], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, longest: int) -> DataFrame:
    """``id, n_words, n_features, weight`` of every row: the weight is the floored mean gain of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n_words = n_features = total = 0
                for n, hashes in run_hashes(text.as_py(), longest):
                    n_words += n
                    n_features += len(hashes)
                    total += int(gains[np.array(hashes, np.int64) % len(gains)].sum())
                rows.append((n_words, n_features, total // n_features if n_features else 0))
            sums = [pa.array(column, pa.int64()) for column in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums], [id_col, "n_words", "n_features", "weight"])

    rows = docs.select(id_col, F.col(text_col).cast("binary").alias("_text"))
    shape = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_words long, n_features long, weight long"
    return rows.mapInArrow(run, shape)


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, longest: int = 2,
    seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Id, ``n_words, n_features, weight, score, rank`` of every row of ``docs``, all long.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred are drawn without replacement: those of
    the highest scores, where a score is the weight plus Gumbel noise from the hash of ``seed`` and id. ``rank`` counts
    the drawn ones from 1 along falling scores, ties to the smaller id; it is null for the others.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest), buckets)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    share = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln(share)))
    scored = weighted(docs, gains, id_col, text_col, longest).withColumn("score", F.col("weight") + noise)
    eligible = F.col("n_words") >= least_words
    placed = ranked(scored, [eligible.desc(), F.col("score").desc(), F.col(id_col).asc_nulls_last()], "rank")
    drawn = placed.where(eligible).count() * percent // 100
    return placed.withColumn("rank", F.when(eligible & (F.col("rank") <= drawn), F.col("rank")))
