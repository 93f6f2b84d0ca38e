"""Growth, latest snapshots and running numbers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from schemaledger.operators import history
from schemaledger.operators.ordering import number_block, numbered, running_total

TABLES = "snapshot_id BIGINT, schema_name STRING, table_name STRING, data_bytes BIGINT, index_bytes BIGINT, total_bytes BIGINT"
HEADS = "snapshot_id BIGINT, data_source_id BIGINT, captured_at TIMESTAMP_NTZ"


def _at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def _growth(spark, tables, heads):
    grown = history.storage_growth(
        spark.createDataFrame([(*t[:3], t[3], 0, t[3]) for t in tables], TABLES), spark.createDataFrame(heads, HEADS)
    )
    return grown, {
        (r["snapshot_id"], r["table_name"]): (r["previous_total_bytes"], r["growth_bytes"], r["growth_percent"])
        for r in grown.collect()
    }


def test_growth_against_the_preceding_snapshot(spark):
    heads = [(1, 5, _at(1)), (2, 5, _at(1, 6)), (3, 5, _at(2)), (4, 5, _at(9)), (9, 6, _at(3))]
    tables = [
        (1, "s", "a", 100), (2, "s", "a", 150), (3, "s", "a", 120), (1, "s", "gone", 10), (3, "s", "gone", 30),
        (2, "s", "zero", 0), (3, "s", "zero", 5), (9, "s", "a", 7),
    ]
    grown, got = _growth(spark, tables, heads)
    assert got[(1, "a")] == (None, None, None)
    assert got[(2, "a")] == (100, 50, 50.0)
    assert got[(3, "a")] == (150, -30, -20.0)
    assert got[(3, "gone")] == (None, None, None), "absent from the preceding snapshot"
    assert got[(3, "zero")] == (0, 5, None), "no percent of nothing"
    assert got[(9, "a")] == (None, None, None), "another source"
    summary = {r["snapshot_id"]: r for r in history.storage_summary(grown).collect()}
    assert (summary[3]["observed_tables"], summary[3]["comparable_tables"], summary[3]["growth_bytes"]) == (3, 2, -25)
    assert (summary[1]["observed_tables"], summary[1]["comparable_tables"], summary[1]["growth_bytes"]) == (2, 0, 0)


def test_snapshot_without_storage_breaks_the_chain(spark):
    heads = [(1, 5, _at(1)), (2, 5, _at(2)), (3, 5, _at(3))]
    _grown, got = _growth(spark, [(1, "s", "a", 100), (3, "s", "a", 150)], heads)
    assert got[(3, "a")] == (None, None, None)


def test_latest_takes_the_higher_id_on_equal_times(spark):
    heads = spark.createDataFrame([(1, 5, _at(1)), (2, 5, _at(2)), (3, 5, _at(2)), (4, 6, _at(1))], HEADS)
    assert sorted(r["snapshot_id"] for r in history.latest(heads).collect()) == [3, 4]
    assert [r["snapshot_id"] for r in history.newest_of_source(heads, 5, 2).collect()] == [3, 2]
    assert sorted(r["snapshot_id"] for r in history.newest(heads, 1).collect()) == [3, 4]
    assert history.newest(heads, 501).count() == 4
    with pytest.raises(ValueError):
        history.newest(heads, 0)


def test_numbers_in_blocks_equal_plain_numbers(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), n) for n in rng.sample(range(100_000), 2000)]
    frame = spark.createDataFrame(rows, "k STRING, n BIGINT")
    got = {(r["k"], r["n"]): r["no"] for r in numbered(frame, ["k"], [F.col("n")], number_block("n", 500), "no").collect()}
    wanted = {}
    for key in "ab":
        for place, n in enumerate(sorted(n for k, n in rows if k == key), start=1):
            wanted[(key, n)] = place
    assert got == wanted


def test_running_total_in_blocks(spark):
    frame = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("n"), (F.col("id") % 3).alias("v"))
    got = running_total(frame, ["k"], [F.col("n")], number_block("n", 64), F.col("v"), "t").collect()
    assert {r["n"]: r["t"] for r in got} == {n: sum(i % 3 for i in range(n + 1)) for n in range(1000)}
