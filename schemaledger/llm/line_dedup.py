"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches. The keys of a batch are merge-anti-joined with every run of earlier keys; what is new becomes
a run of its own: bucketed and sorted by hash, with the smallest document id that holds the key. After ``fanout`` runs of
one level they are compacted to one run of the next level, so the number of runs to join stays logarithmic in the number
of batches. Runs hold disjoint keys and are stored in buckets, so neither the joins nor a compaction has to sort them
anew at equal bucket counts.

A line stays if its document is the owner of its key. Hot lines are pre-aggregated before they are shuffled, and the
test of lines against owners is spread over (key, document).
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder, written

WHITE = " \t\n\x0b\x0c\r"
_KEY = ["k1", "k2"]
_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    cut = F.btrim(line, F.lit(WHITE))
    plain = F.octet_length(cut) == F.char_length(cut)
    return F.when(plain, F.lower(cut)).otherwise(F.translate(cut, string.ascii_uppercase, string.ascii_lowercase))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Sorted runs of owned line keys (``k1, k2, owner``) as bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, fanout: int):
        self.spark, self.folder, self.buckets, self.fanout = spark, folder, buckets, fanout
        self.levels: dict[int, list[str]] = {}
        self.made: list[str] = []

    def _store(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.write.format("parquet").bucketBy(self.buckets, *_KEY).sortBy(*_KEY)
         .option("path", f"{self.folder}/{name}").saveAsTable(name))
        self.made.append(name)
        return name

    def names(self) -> list[str]:
        return [name for level in sorted(self.levels, reverse=True) for name in self.levels[level]]

    def add(self, keys: DataFrame) -> DataFrame:
        """Store those of ``keys`` (one row each) that no run holds; returns the new run."""
        new = keys
        for name in self.names():
            new = new.join(self.spark.table(name), _KEY, "left_anti")
        name = self._store(new if self.names() else new.repartition(self.buckets, *_KEY))
        self.levels.setdefault(0, []).append(name)
        return self.spark.table(name)

    def compact(self) -> None:
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            merged = None
            for name in self.levels.pop(level):
                run = self.spark.table(name)
                merged = run if merged is None else merged.union(run)
            self.levels.setdefault(level + 1, []).append(self._store(merged.repartition(self.buckets, *_KEY)))
            level += 1

    def forget(self) -> None:
        """Take the tables out of the catalogue; their files belong to the shared folder."""
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """``docs`` with ``text_col`` cut to its kept lines, and ``n_lines``, ``n_dropped`` (as long) put at the end.

    Line keys of at least ``min_chars`` code points lose their lines in every document but the one of the smallest id
    that holds the key; within that document repeats stay. Batches are ranges of the id. A null or empty text is one
    empty line and gives an empty text. Rows of one id are one document, so repeated rows keep the same lines. A row
    without id comes after all others; rows without id count as one document. Columns of ``docs`` named ``n_lines`` or
    ``n_dropped`` are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    order, same_text = F.coalesce(F.col(id_col), F.lit(_LAST)), F.xxhash64(text_col)
    cuts = docs.select(F.percentile_approx(order, [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    batch = sum((F.when(order > F.lit(cut), 1).otherwise(0) for cut in dict.fromkeys(cuts)), F.lit(0))
    key = F.col("line_key")
    lines = (
        docs.select(order.alias("ord"), same_text.alias("same_text"), batch.alias("batch"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
        .select("ord", "same_text", "batch", "pos", line_key(F.col("line")).alias("line_key"))
        .where(F.char_length(key) >= min_chars)
        .select("ord", "same_text", "batch", "pos", F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2"))
    )
    ledger = written(lines, "batch")
    runs = LineRuns(spark, shared_folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    try:
        dropped = None
        for number in range(len(dict.fromkeys(cuts)) + 1):
            part = ledger.where(F.col("batch") == number)
            own = runs.add(part.groupBy(*_KEY).agg(F.min("ord").alias("owner")))
            lost = part.join(own.withColumnRenamed("owner", "ord"), [*_KEY, "ord"], "left_anti").select("ord", "same_text", "pos")
            dropped = lost if dropped is None else dropped.union(lost)
            if number < len(dict.fromkeys(cuts)):
                runs.compact()
        marks = dropped.distinct().groupBy("ord", "same_text").agg(F.sort_array(F.collect_list("pos")).alias("at"))
        before = lambda i: F.when(i == 0, -1).otherwise(F.get("at", i - 1))
        flags = F.transform("at", lambda p, i: F.concat(F.repeat(F.lit("0"), p - before(i) - 1), F.lit("1")))
        marks = written(marks.select("ord", "same_text", F.size("at").alias("lost"), F.array_join(flags, "").alias("flags")))
    finally:
        runs.forget()
    marks = marks.select("ord", "same_text", "lost", F.split("flags", "").alias("flag_list"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    kept = F.filter(lines_of(F.col(f"d.{text_col}")), lambda line, i: F.coalesce(F.get("m.flag_list", i), F.lit("0")) == "0")
    text = F.when(F.col("m.lost").isNull(), F.coalesce(f"d.{text_col}", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return (
        docs.alias("d")
        .join(marks.alias("m"), (F.coalesce(F.col(f"d.{id_col}"), F.lit(_LAST)) == F.col("m.ord")) & (F.xxhash64(f"d.{text_col}") == F.col("m.same_text")), "left")
        .select(
            *[text.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in names],
            F.size(lines_of(F.col(f"d.{text_col}"))).cast("long").alias("n_lines"),
            F.coalesce("m.lost", F.lit(0)).cast("long").alias("n_dropped"),
        )
    )
