"""The snapshot store: append, scan, published relations."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import model
from ..operators import flatten, history
from ..session import broadcast_if_small

COMMITS = "name STRING, at TIMESTAMP, attempt STRING, retired_attempt STRING, snapshot_id BIGINT"
COMMITTED = f"{model.STORED}, attempt STRING"
# What a retired snapshot is replaced in: its facts and its tables, the rows that hold growth.
REPLACED_KINDS = (model.SNAPSHOT, model.TABLE_KIND)


def append_snapshots(rows: DataFrame, path: str) -> None:
    """Append rows of the store: a folder for each kind, month and bucket of sources.

    Rows are rebalanced on the folder key, so a large folder is split over many files and small ones are not scattered;
    inside a file they are ordered by source and snapshot, so that footers prune further.
    """
    placed = rows.hint("rebalance", *model.PARTITIONS).sortWithinPartitions(*model.PARTITIONS, "data_source_id", "snapshot_id", "schema_name", "name")
    placed.write.mode("append").partitionBy(*model.PARTITIONS).parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(model.STORED).parquet(path)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """Records of the commit log below ``path``; none before the first append.

    A record without `retired_attempt` names the attempt of a commit; the others the snapshots it replaces.
    """
    try:
        return spark.read.schema(COMMITS).parquet(f"{path}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITS)


def append_once(rows: DataFrame, path: str, name: str, retired: DataFrame | None = None) -> bool:
    """Append rows of the store as the commit ``name``; False, and nothing is written, if that commit is there already.

    Every attempt has folders of its own, and readers take those of committed attempts only. The record that commits one
    is a single file, which appears at once, so an append that failed half way is not seen and can be repeated.
    ``retired`` (attempt, snapshot_id): snapshots whose rows of `REPLACED_KINDS` this commit replaces.
    """
    spark = rows.sparkSession
    if not commits(spark, path).where(F.col("name") == name).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    keys = [*model.PARTITIONS, "data_source_id", "snapshot_id", "schema_name", "name"]
    placed = rows.drop("attempt").hint("rebalance", *model.PARTITIONS).sortWithinPartitions(*keys).withColumn("attempt", F.lit(attempt))
    placed.write.mode("append").partitionBy(*model.PARTITIONS, "attempt").parquet(f"{path}/rows")
    facts = [F.lit(name).alias("name"), F.current_timestamp().alias("at"), F.lit(attempt).alias("attempt")]
    record = spark.range(1).select(*facts, F.lit(None).cast("string").alias("retired_attempt"), F.lit(None).cast("bigint").alias("snapshot_id"))
    if retired is not None:
        record = record.unionByName(retired.select(*facts, F.col("attempt").alias("retired_attempt"), "snapshot_id"))
    record.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return True


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all commits below ``path``, less those that a later one replaced; `attempt` names the folder of a row.

    If two drivers committed one name, the earlier record counts. Folders of other attempts are pruned by the join.
    """
    log = commits(spark, path)
    first = log.groupBy("name").agg(F.min(F.struct("at", "attempt")).alias("_first")).select("_first.attempt")
    retired = (
        log.where("retired_attempt IS NOT NULL").join(first, "attempt", "left_semi")
        .select(F.col("retired_attempt").alias("attempt"), "snapshot_id", F.explode(F.lit(list(REPLACED_KINDS))).alias("kind"))
    )
    try:
        rows = spark.read.schema(COMMITTED).parquet(f"{path}/rows")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITTED)
    taken = rows.join(broadcast_if_small(first), "attempt", "left_semi")
    return taken.join(broadcast_if_small(retired), ["attempt", "snapshot_id", "kind"], "left_anti").select(*rows.columns)


def snapshots_of_source(stored: DataFrame, data_source_id: int) -> DataFrame:
    """All rows of one source: only the folders of its bucket are listed."""
    return stored.where((F.col("source_bucket") == data_source_id % model.SOURCE_BUCKETS) & (F.col("data_source_id") == data_source_id))


def snapshot_by_id(stored: DataFrame, snapshot_id: int, data_source_id: int | None = None) -> DataFrame:
    """All rows of one snapshot. With the source given, folders of other buckets are not listed."""
    rows = stored if data_source_id is None else snapshots_of_source(stored, data_source_id)
    return rows.where(F.col("snapshot_id") == snapshot_id)


def headers(stored: DataFrame) -> DataFrame:
    """One row per snapshot, from the folders that hold no objects."""
    return flatten.of_kind(stored, model.SNAPSHOT).select(*model.HEADER_COLUMNS)


def publish(stored: DataFrame, fingerprints: DataFrame, prefix: str = "integration_") -> list[str]:
    """Register the read-only history relations as views for SQL users."""
    history_rows = flatten.snapshot_history(stored).join(fingerprints, "snapshot_id")
    relations = {
        "snapshot_history": history_rows,
        "latest_snapshots": history.latest(history_rows),
        "schema_history": flatten.schema_history(stored),
        "table_history": flatten.table_history(stored),
        "column_history": flatten.column_history(stored),
    }
    for name, rows in relations.items():
        rows.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in relations]
