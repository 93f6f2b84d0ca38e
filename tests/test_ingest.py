"""Stream ingest: nothing lost, nothing doubled, growth carried on."""

import test_assembly as small
from pyspark.sql import functions as F

from schemaledger import model
from schemaledger.operators import flatten
from schemaledger.plans.collection import collected
from schemaledger.sources import store as stores
from schemaledger.streaming import ingest


def _facts(parts):
    rows = flatten.table_details(parts).select("snapshot_id", "table_name", "total_bytes", "previous_total_bytes", "growth_bytes")
    return sorted(map(tuple, rows.collect()))


def _growing(spark, *ids):
    """Relations of snapshots whose table grows by the square of the id; the second has one table less."""
    out = {}
    for i in ids:
        own = dict(small._relations(spark, i))
        size = F.lit(100 + i * i).cast("bigint")
        own["storage"] = own["storage"].withColumns({"data_bytes": size - 5, "index_bytes": F.lit(5).cast("bigint"), "total_bytes": size})
        if i == 2:
            own["tables"] = own["tables"].where("table_name <> 'members'")
        out = {n: out[n].unionAll(r) if n in out else r for n, r in own.items()}
    return out


def _whole(rows):
    """Everything the store says, the place of a row left out."""
    return sorted(rows.select(F.to_json(F.struct("kind", "snapshot_id", "schema_name", "name", "storage", "storage_summary", "digest")).alias("j")).toPandas()["j"])


def test_late_repeated_and_doubled_deliveries(spark, tmp_path):
    landing, store, checkpoint = (str(tmp_path / n) for n in ("landing", "store", "checkpoint"))
    ids = (1, 2, 3, 6)
    both = _growing(spark, *ids)
    delivery = lambda rows: rows.withColumn("delivery", F.expr("CASE snapshot_id WHEN 1 THEN 1 WHEN 6 THEN 1 WHEN 3 THEN 2 ELSE 3 END"))
    for name, rows in both.items():
        delivery(rows).write.partitionBy("delivery").parquet(f"{landing}/{name}")
    for landed_ids in ((1, 6), (3, 3), (2, 1)):  # 3 is doubled and late for 6; 2 is late for 3, 1 is repeated
        heads = delivery(small._headers(spark, *landed_ids, storage=True))
        doubled = heads.where("snapshot_id = 3").limit(1).withColumn("snapshot_id", F.lit(30).cast("bigint"))
        heads.unionAll(doubled).write.mode("append").parquet(f"{landing}/headers")
        ingest.ingest(spark, landing, store, checkpoint).awaitTermination()
    stored = ingest.read_store(spark, store)
    assert _whole(stored) == _whole(collected(small._headers(spark, *ids, storage=True), both))
    assert stores.commits(spark, store).where("retired_attempt IS NOT NULL").count() == 2, "6 after 3, then 3 after 2"


def test_a_batch_reads_its_own_deliveries(spark, tmp_path):
    landing = str(tmp_path / "landing")
    rows = spark.range(100).selectExpr("id AS snapshot_id", "id % 10 AS delivery")
    rows.write.partitionBy("delivery").parquet(f"{landing}/tables")
    asked = F.broadcast(rows.where("snapshot_id IN (3, 13)"))
    got = ingest._delivered(spark, landing, "tables", asked)
    assert sorted(r["snapshot_id"] for r in got.collect()) == [3, 13]
    assert "dynamicpruning" in got._jdf.queryExecution().toString().lower()


def test_appends_that_break_off_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = collected(small._headers(spark, 1, storage=True), _growing(spark, 1))
    assert ingest.read_store(spark, path).isEmpty()
    broken = rows.withColumn("attempt", F.lit("broken"))
    broken.write.partitionBy(*model.PARTITIONS, "attempt").parquet(f"{path}/rows")  # files without a commit
    assert ingest.read_store(spark, path).isEmpty()
    assert stores.append_once(rows, path, "first") and not stores.append_once(rows, path, "first")
    assert _whole(ingest.read_store(spark, path)) == _whole(rows)
    first = stores.commits(spark, path).first()
    again = spark.createDataFrame([("first", first["at"].replace(year=2999), "broken", None, None)], stores.COMMITS)
    again.coalesce(1).write.mode("append").parquet(f"{path}/commits")  # a second driver was later with the same commit
    assert _whole(ingest.read_store(spark, path)) == _whole(rows)


def test_two_deliveries_with_replay(spark, tmp_path):
    landing, store, checkpoint = (str(tmp_path / n) for n in ("landing", "store", "checkpoint"))
    both = {n: r.unionAll(small._relations(spark, 2)[n]) for n, r in small._relations(spark, 1).items()}
    for name, rows in both.items():
        rows.write.parquet(f"{landing}/{name}")
    first, second = small._headers(spark, 1, storage=True), small._headers(spark, 2, storage=True)

    first.write.mode("append").parquet(f"{landing}/headers")
    ingest.ingest(spark, landing, store, checkpoint).awaitTermination()
    second.unionAll(first).write.mode("append").parquet(f"{landing}/headers")
    ingest.ingest(spark, landing, store, checkpoint).awaitTermination()

    wanted = _facts(collected(small._headers(spark, 1, 2, storage=True), both))
    assert _facts(ingest.read_store(spark, store)) == wanted, "stream and batch give the same, a repeated header adds nothing"

    ingest.batch_writer(landing, store)(second, 1)
    assert _facts(ingest.read_store(spark, store)) == wanted, "a replayed batch adds nothing"
