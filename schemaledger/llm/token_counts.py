"""Token counts by source, language and tokenizer version, kept by signed deltas.

A batch of changes is turned into deltas: an insert adds a document's count, a delete takes away the count that the
ledger holds, a revision takes the old count away and adds the new one. Totals are sums of the deltas of committed
batches, so nothing is counted anew. A batch writes its ledger rows and deltas into folders of its own and then its
commit row; a batch that broke off before the commit is written again over its own folders, and a committed batch that
comes again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_bpe import ranks_of

_LEDGER = "doc_id long, version string, source string, lang string, n_tokens long, deleted boolean"
_DELTAS = "source string, lang string, version string, docs long, tokens long"
_KEY = ["source", "lang", "version"]


class TokenRollup:
    """Rollup below ``folder`` (shared storage). Null sources, languages and document ids are values like any other."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        for part, shape in (("ledger", _LEDGER), ("deltas", _DELTAS), ("commits", "batch_no long")):
            path = f"{folder}/{part}/at=-1"  # an empty batch, so that each part can be read from the start
            spark.createDataFrame([], shape).write.mode("overwrite").parquet(path)

    def _read(self, part: str, shape: str) -> DataFrame:
        rows = self.spark.read.schema(f"{shape}, at long").parquet(f"{self.folder}/{part}")
        return rows.where(F.col("at").isin([*self.committed(), -1]))

    def committed(self) -> list[int]:
        """Numbers of the committed batches, ascending; one small row for each batch."""
        commits = self.spark.read.schema("batch_no long").parquet(f"{self.folder}/commits")
        return sorted(r["batch_no"] for r in commits.distinct().collect())

    def commit(self, number: int, changes: DataFrame) -> bool:
        """Take in a batch of ``op, doc_id, source, lang, version, n_tokens``; false if it is committed already.

        ``op`` is insert, delete or revise. Of several rows of one document and version a delete comes last, else the
        largest count stays. An insert of what is there counts as a revision, a revision of what is not as an insert,
        a delete of what is not there as nothing; a null count counts as 0.
        """
        if number in self.committed():
            return False
        asked = changes.groupBy("doc_id", "version").agg(F.max(F.struct(
            (F.col("op") == "delete").alias("deleted"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "source", "lang")).alias("c")).select("doc_id", "version", "c.*")
        held = self._read("ledger", _LEDGER).groupBy("doc_id", "version").agg(
            F.max_by(F.struct("source", "lang", "n_tokens", "deleted"), "at").alias("was"))
        met = asked.alias("a").join(
            held.alias("h"), F.col("a.doc_id").eqNullSafe(F.col("h.doc_id")) & F.col("a.version").eqNullSafe(F.col("h.version")), "left"
        ).select("a.*", F.when(~F.col("h.was.deleted"), F.col("h.was")).alias("was"))
        met.select("doc_id", "version", "source", "lang", "n_tokens", "deleted").write.mode("overwrite").parquet(f"{self.folder}/ledger/at={number}")
        signed = F.filter(F.array(
            F.when(F.col("was").isNotNull(), F.struct(F.col("was.source").alias("source"), F.col("was.lang").alias("lang"), F.lit(-1).alias("docs"), (-F.col("was.n_tokens")).alias("tokens"))),
            F.when(~F.col("deleted"), F.struct("source", "lang", F.lit(1).alias("docs"), F.col("n_tokens").alias("tokens"))),
        ), lambda x: x.isNotNull())
        (met.select("version", F.inline(signed)).groupBy(*_KEY)
         .agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
         .write.mode("overwrite").parquet(f"{self.folder}/deltas/at={number}"))
        self.spark.range(number, number + 1).select(F.col("id").alias("batch_no")).write.mode("overwrite").parquet(f"{self.folder}/commits/at={number}")
        return True

    def totals(self) -> DataFrame:
        """``source, lang, version, n_docs, n_tokens`` of all groups that hold a document."""
        sums = self._read("deltas", _DELTAS).groupBy(*_KEY).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0")


_encodings: dict[tuple, object] = {}


def counted(docs: DataFrame, files: Mapping[str, bytes], pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with one column of token counts (long) for each of ``files`` (name to rank file), without special tokens.

    Whole texts; null and empty ones have 0 tokens. Columns of these names are replaced, others pass through.
    """
    names = [c for c in docs.columns if c not in files]
    at = names.index(text_col)
    rows = docs.select(*[F.col(f"`{c}`") for c in names]).toDF(*[f"c{i}" for i in range(len(names))])
    shape = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + [f"n{k} long" for k in range(len(files))])
    held = dict(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        key = tuple((name, len(file)) for name, file in held.items())
        if key not in _encodings:
            _encodings[key] = [tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks_of(file), special_tokens={}) for name, file in held.items()]
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [t or "" for t in part.column(at).to_pylist()]
                counts = [pa.array([len(e.encode_ordinary(t)) for t in texts], pa.int64()) for e in _encodings[key]]
                yield pa.RecordBatch.from_arrays([*part.columns, *counts], [*part.schema.names, *(f"n{k}" for k in range(len(counts)))])

    return rows.mapInArrow(run, shape).toDF(*names, *files)
