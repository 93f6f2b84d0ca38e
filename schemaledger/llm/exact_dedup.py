"""Exact dedup by a stateful stream.

Two streams follow each other, each exactly once by its checkpoint:

1. documents -> ledger: one narrow row per document with digest, id, length and content locator (file and row);
2. ledger -> keyed state: a streaming aggregation on the digest without watermark, so the state never expires. It lies
   on disk (RocksDB) and holds per digest the count, the stable id and the locator of the document that stays. Partial
   aggregation runs before the shuffle, so a text that a third of all rows share is one row per task.

A digest hit is not trusted: the whole normalised bytes behind each digest are compared, copies collapsing within a task
before anything is shuffled. Digests with more than one text behind them are settled by the texts themselves.

Later calls with the same folder take only new files and go on from the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import written

WHITE = r"[\x20\x09-\x0D]+"
_LEDGER = "id {id}, n_chars long, digest string, file string, row long"
_UPDATES = "digest string, group_size long, best struct<short:long, no_id:boolean, id:{id}, file:string, row:long>"


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _stay() -> Column:
    """Least value for the row that stays: most code points, then smallest id (null last), then place in the files."""
    return F.struct((-F.col("n_chars")).alias("short"), F.col("id").isNull().alias("no_id"), "id", "file", "row")


def _drain(stream, checkpoint: str, to: Callable[[DataFrame, int], None], mode: str) -> None:
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(to).start()
    query.awaitTermination()


def exact_dedup(
    spark: SparkSession, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` for each document of the Parquet files at ``path``.

    ``folder`` (shared storage) holds ledger, state and stream checkpoints. Documents are equal if their normalised
    texts are. Null texts equal empty ones. Repeated rows are rows of their own: just one row of a group is kept, the
    first in the files among full ties. A null id loses against any other. Other columns are not read. An empty table
    gives no rows.
    """
    session = spark.newSession()
    for key, value in {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # no megabytes set aside for each partition's small state
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }.items():
        session.conf.set(key, value)
    schema = spark.read.parquet(path).schema
    id_type = schema[id_col].dataType.simpleString()
    ledger_schema, updates_schema = _LEDGER.format(id=id_type), _UPDATES.format(id=id_type)
    for part, shape in (("ledger", ledger_schema), ("updates", updates_schema)):
        spark.createDataFrame([], shape).write.mode("overwrite").parquet(f"{folder}/{part}/batch_no=-1")

    norm = normalised(F.col(text_col))
    located = lambda docs: docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("n_chars"), digest(norm).alias("digest"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    documents = (
        session.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern: one file and a folder of files are both read
    )
    _drain(located(documents), f"{folder}/ledger_checkpoint",
           lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/ledger/batch_no={number}"), "append")
    kept = (
        session.readStream.schema(ledger_schema).parquet(f"{folder}/ledger/batch_no=*")
        .groupBy("digest").agg(F.count("*").alias("group_size"), F.min(_stay()).alias("best"))
    )
    _drain(kept, f"{folder}/state_checkpoint",
           lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/updates/batch_no={number}"), "update")

    updates = spark.read.schema(f"{updates_schema}, batch_no long").parquet(f"{folder}/updates")
    state = updates.groupBy("digest").agg(F.max_by(F.struct("group_size", "best"), "batch_no").alias("last")).select("digest", "last.*")
    ledger = spark.read.schema(ledger_schema).parquet(f"{folder}/ledger")
    rows = ledger.join(state, "digest").select(*_columns())

    contents = spark.read.schema(schema).parquet(path)
    texts = contents.select(digest(norm).alias("digest"), norm.alias("norm")).distinct()
    false_hits = written(texts.groupBy("digest").count().where("count > 1").select("digest"))
    if false_hits.isEmpty():
        return rows
    full = contents.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), digest(norm).alias("digest"), norm.alias("norm"))
    disputed = full.join(false_hits, "digest", "left_semi").join(ledger.drop("digest"), ["file", "row"])
    classes = disputed.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), F.min(_stay()).alias("best"))
    settled = disputed.join(classes, ["digest", "norm"]).select(*_columns())
    return rows.join(false_hits, "digest", "left_anti").select("doc_id", "keep_id", "group_size", "kept", "digest").union(settled)


def _columns() -> list[Column]:
    return [
        F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), F.col("group_size"),
        ((F.col("best.file") == F.col("file")) & (F.col("best.row") == F.col("row"))).alias("kept"), F.col("digest"),
    ]
