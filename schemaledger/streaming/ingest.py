"""Incremental ingest of landed catalogue extracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import model
from ..operators import flatten, history
from ..plans.collection import collected, summaries, with_growth
from ..session import broadcast_if_small, written
from ..sources import store as stores
from ..sources.catalogs import landed

RELATIONS = (
    "schemas", "tables", "columns", "primary_keys", "foreign_keys", "indexes", "unique_constraints", "storage", "views", "routines", "grants",
)
_NEEDED = ("tables", "storage")
_GROWN = ("previous_total_bytes", "growth_bytes", "growth_percent")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return stores.read_committed(spark, path)


def _delivered(session: SparkSession, landing: str, relation: str, asked: DataFrame) -> DataFrame | None:
    """Rows of the asked snapshots; None if the relation has no folder or no file, as one without rows may.

    Folders of other deliveries are pruned, where a producer lands by delivery.
    """
    try:
        rows = landed(session, landing, relation)
    except AnalysisException as missing:
        if relation in _NEEDED or missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    keys = [c for c in ("snapshot_id", "delivery") if c in asked.columns and c in rows.columns]
    return rows.join(asked.select(*keys), keys, "left_semi").drop("delivery")


def stored_around(fresh: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows of ``heads`` just before or just after a fresh header of their source, with `follows`: it comes just after one.

    Order is that of growth: (captured_at, snapshot_id). Only headers are numbered.
    """
    both = heads.withColumn("_fresh", F.lit(False)).unionByName(fresh.select("snapshot_id", "data_source_id", "captured_at", F.lit(True).alias("_fresh")), allowMissingColumns=True)
    numbers = history.sequenced(both)
    beside = F.inline(F.array(*[F.struct((F.col("seq") + step).alias("seq"), F.lit(step == 1).alias("follows")) for step in (-1, 1)]))
    near = numbers.where("_fresh").select("data_source_id", beside).groupBy("data_source_id", "seq").agg(F.bool_or("follows").alias("follows"))
    return numbers.where("NOT _fresh").join(near, ["data_source_id", "seq"]).select(*heads.columns, "follows")


def corrected(successors: DataFrame, grown: DataFrame) -> DataFrame:
    """Facts and tables of stored snapshots with the growth that ``grown`` gives them now; their digests leave growth out."""
    sizes = grown.select("snapshot_id", "schema_name", F.col("table_name").alias("name"), *[F.col(c).alias(f"_{c}") for c in _GROWN], F.lit(True).alias("_known"))
    new = F.col("storage")
    for c in _GROWN:
        new = new.withField(c, F.col(f"_{c}"))
    tables = flatten.of_kind(successors, model.TABLE_KIND).join(sizes, ["snapshot_id", "schema_name", "name"], "left")
    tables = tables.withColumn("storage", F.when(F.col("_known"), new).otherwise(F.col("storage"))).select(*successors.columns)
    totals = summaries(grown).withColumnRenamed("storage_summary", "_summary")
    facts = flatten.of_kind(successors, model.SNAPSHOT).join(totals, "snapshot_id", "left")
    facts = facts.withColumn("storage_summary", F.coalesce("_summary", "storage_summary")).select(*successors.columns)
    return facts.unionByName(tables)


def batch_writer(landing: str, store: str) -> Callable[[DataFrame, int], None]:
    """The `foreachBatch` function: headers of one batch -> one commit of the store, named after the batch.

    Snapshots already stored by an earlier batch for the same source and run are left out; of equal sources and runs in
    one batch the smallest snapshot id counts. Growth is taken against the snapshot just before, wherever the new one
    falls in the history; a stored snapshot that comes just after a late one is corrected in the same commit. Of the store,
    a batch reads the headers of its sources and the tables of the snapshots beside its own. A repeated batch is a commit
    that is there already, so replay after a lost driver or executor neither loses nor doubles a snapshot.
    """

    def write(headers: DataFrame, batch_id: int) -> None:
        session = headers.sparkSession
        name = f"batch {batch_id}"
        if not stores.commits(session, store).where(F.col("name") == name).isEmpty():
            return
        stored = read_store(session, store)
        one = headers.groupBy("data_source_id", "run_id").agg(F.min_by(F.struct("*"), "snapshot_id").alias("_row")).select("_row.*")
        sources = one.select("data_source_id", F.pmod("data_source_id", F.lit(model.SOURCE_BUCKETS)).cast("int").alias("source_bucket")).distinct()
        heads = written(
            flatten.of_kind(stored, model.SNAPSHOT).select(*model.HEADER_COLUMNS, "month", "source_bucket", "attempt")
            .join(broadcast_if_small(sources), ["data_source_id", "source_bucket"], "left_semi")
        )
        fresh = written(one.join(heads.select("data_source_id", "run_id"), ["data_source_id", "run_id"], "left_anti"))
        around = written(stored_around(fresh, heads))
        totals = flatten.table_details(history.of_snapshots(flatten.of_kind(stored, model.TABLE_KIND), around)).where("total_bytes IS NOT NULL")
        asked = broadcast_if_small(fresh.select(*[c for c in ("snapshot_id", "delivery") if c in fresh.columns]))
        relations = {n: rows for n in RELATIONS if (rows := _delivered(session, landing, n, asked)) is not None}
        fresh = fresh.drop("delivery")
        grown = written(with_growth(fresh, relations, around, totals))
        rows, retired = collected(fresh, relations, around, totals, grown), None
        late = around.where("follows")
        if not late.isEmpty():
            retired = late.select("attempt", "snapshot_id")
            changed = grown.join(late.select("snapshot_id"), "snapshot_id", "left_semi")
            after = history.of_snapshots(flatten.of_kind(stored, *stores.REPLACED_KINDS), late).drop("attempt")
            rows = rows.unionByName(corrected(after, changed))
        stores.append_once(rows, store, name, retired)

    return write


def ingest(spark: SparkSession, landing: str, store: str, checkpoint: str) -> StreamingQuery:
    """Append every snapshot whose header has landed since the last call, then stop.

    A producer writes the relations of a snapshot below ``landing/<relation>`` first and its header row below
    ``landing/headers`` last, so a header announces complete relations. Relations may lie in folders by `delivery`, a
    number that headers then have as a column; a batch reads the folders of its own deliveries only.
    """
    schema = spark.read.parquet(f"{landing}/headers").schema
    return (
        spark.readStream.schema(schema)
        .parquet(f"{landing}/headers")
        .writeStream.foreachBatch(batch_writer(landing, store))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
