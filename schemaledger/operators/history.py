"""Latest snapshots, growth over the history, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import model
from ..functions.values import growth_bytes, growth_percent
from ..session import broadcast_if_small
from . import flatten
from .ordering import numbered, time_block

_HEADER = list(model.HEADER_COLUMNS)


# --- latest and newest -------------------------------------------------------------------------------------------
def latest(headers: DataFrame, source: str = "data_source_id", at: str = "captured_at", key: str = "snapshot_id") -> DataFrame:
    """The newest row per source, ties by id. A partial aggregate keeps one candidate per task and source."""
    newest = headers.groupBy(source).agg(F.max_by(F.struct("*"), F.struct(at, key)).alias("_row"))
    return newest.select("_row.*")


def headers(stored: DataFrame) -> DataFrame:
    """Header columns and folder of every snapshot; objects are not read."""
    return flatten.of_kind(stored, model.SNAPSHOT).select(*_HEADER, "month", "source_bucket")


def latest_with_payload(stored: DataFrame) -> DataFrame:
    """All rows of the newest snapshot per source. The choice reads headers only; its folders are the only ones read."""
    return of_snapshots(stored, latest(headers(stored)))


def of_snapshots(stored: DataFrame, chosen: DataFrame) -> DataFrame:
    """All rows of the chosen snapshots (rows of `headers`).

    A checked number of ids is broadcast, so objects are not shuffled, and Spark prunes the folders of other months and
    buckets before it reads them.
    """
    keys = ["month", "source_bucket", "data_source_id", "snapshot_id"]
    return stored.join(broadcast_if_small(chosen.select(*keys)), keys, "left_semi")


def newest(headers: DataFrame, limit: int) -> DataFrame:
    """The N newest snapshots of every source, ties by id.

    Spark cuts each task's rows to the limit before the shuffle (window group limit), so at most N rows per task and
    source reach the final sort.
    """
    if limit < 1:
        raise ValueError("at least one snapshot of each source has to be asked for")
    order = W.partitionBy("data_source_id").orderBy(F.col("captured_at").desc(), F.col("snapshot_id").desc())
    return headers.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit).drop("_rank")


def newest_of_source(headers: DataFrame, source_id: int, limit: int | None = None) -> DataFrame:
    """Snapshots of one source, newest first: a filter that reaches the scan; a top-N if a limit is given."""
    rows = headers.where(F.col("data_source_id") == source_id)
    ordered = rows.orderBy(F.col("captured_at").desc(), F.col("snapshot_id").desc())
    return ordered if limit is None else ordered.limit(limit)


# --- growth ------------------------------------------------------------------------------------------------------
def sequenced(headers: DataFrame) -> DataFrame:
    """Add `seq`: the number of the snapshot within its source, from 1, by (captured_at, snapshot_id)."""
    order = [F.col("captured_at"), F.col("snapshot_id")]
    return numbered(headers, ["data_source_id"], order, time_block("captured_at"), "seq")


def storage_growth(tables: DataFrame, headers: DataFrame) -> DataFrame:
    """Add previous total, growth and growth percent against the immediately preceding snapshot of the source.

    ``tables``: snapshot_id, schema_name, table_name, total_bytes, … (a row per table with storage). ``headers``: one
    row per snapshot. The frame is one step of the snapshot number, not one row: a table absent from the preceding
    snapshot has no previous total. The table relation is read and shuffled once.
    """
    numbers = sequenced(headers.select("snapshot_id", "data_source_id", "captured_at")).select(
        "snapshot_id", F.col("data_source_id").alias("_source"), F.col("seq").alias("_seq")
    )
    step = W.partitionBy("_source", "schema_name", "table_name").orderBy("_seq").rangeBetween(-1, -1)
    previous = F.last("total_bytes").over(step)
    return (
        tables.join(numbers, "snapshot_id")
        .withColumn("previous_total_bytes", previous)
        .withColumn("growth_bytes", growth_bytes(F.col("total_bytes"), F.col("previous_total_bytes")))
        .withColumn("growth_percent", growth_percent(F.col("total_bytes"), F.col("previous_total_bytes")))
        .drop("_source", "_seq")
    )


def previous_totals(tables: DataFrame, previous: DataFrame) -> DataFrame:
    """Add the total of the same table in the snapshot named by `previous_snapshot_id` (one row per snapshot)."""
    old = tables.select(
        F.col("snapshot_id").alias("previous_snapshot_id"), "schema_name", "table_name",
        F.col("total_bytes").alias("previous_total_bytes"),
    )
    asked = tables.join(previous.select("snapshot_id", "previous_snapshot_id"), "snapshot_id", "left")
    return asked.join(old, ["previous_snapshot_id", "schema_name", "table_name"], "left")


def storage_summary(grown: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sums per snapshot; growth counts only tables that can be compared. Grouped partially before the shuffle."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return grown.groupBy(*(keys or ["snapshot_id"])).agg(
        total("data_bytes"), total("index_bytes"), total("total_bytes"), total("growth_bytes"),
        F.count("total_bytes").alias("observed_tables"), F.count("previous_total_bytes").alias("comparable_tables"),
    )


# --- summaries ---------------------------------------------------------------------------------------------------
_COUNTED = (model.SCHEMA, model.TABLE_KIND, model.VIEW_KIND, model.ROUTINE_KIND)


def snapshot_summary(stored: DataFrame) -> DataFrame:
    """Header, schema / table / view / procedure counts and skipped schemas per snapshot: one scan, one grouping."""
    facts = ("source", "db_type", "database", "skipped_schemas")
    counts = [F.count_if(F.col("kind") == kind).alias(f"{kind}_count") for kind in _COUNTED]
    return stored.groupBy(*_HEADER).agg(*[F.first(c, ignorenulls=True).alias(c) for c in facts], *counts)


def collected_objects(stored: DataFrame) -> DataFrame:
    """Tables, views and procedures per snapshot; columns and indexes do not count."""
    rows = flatten.of_kind(stored, *_COUNTED)
    return rows.groupBy("snapshot_id").agg(F.count_if(F.col("kind") != model.SCHEMA).alias("object_count"))


def schema_totals(stored: DataFrame) -> DataFrame:
    """Tables, views and procedures of every schema, added up."""
    total = F.col("table_count") + F.col("view_count") + F.col("procedure_count")
    return flatten.schema_history(stored).withColumn("object_count", total)


def total_counts() -> list[Column]:
    """Schemas, tables, views, columns, indexes and foreign keys of a group of stored rows, from list lengths alone."""
    count = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    under = lambda item: F.coalesce(F.sum(F.size(f"{item}.name")), F.lit(0)).cast("bigint").alias(item)
    return [
        count(model.SCHEMA, "schemas"), count(model.TABLE_KIND, "tables"), count(model.VIEW_KIND, "views"),
        under("columns"), under("indexes"), under("foreign_keys"),
    ]


def export_totals(stored: DataFrame) -> DataFrame:
    """`total_counts` of every snapshot."""
    return stored.groupBy("snapshot_id").agg(*total_counts())
