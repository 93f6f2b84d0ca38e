"""Numbers by range: against a window over the key, with one key, null keys, ties and no rows."""

import pytest
from pyspark.sql import Window as W, functions as F

from schemaledger.operators.ordering import numbered_by_range


@pytest.fixture
def five_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("key", ["'one'", "CAST(NULL AS STRING)", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 40 AS STRING) END",
                                 "CASE WHEN id % 2 = 0 THEN NULL ELSE CAST(id % 700 AS STRING) END"])
def test_numbers_by_range(five_ranges, key):
    rows = five_ranges.range(2000).select(F.expr(key).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("name"), "id")
    got = numbered_by_range(rows, ["k"], [F.col("name").desc(), F.col("id")], "n")
    wanted = rows.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy(F.col("name").desc(), "id")))
    assert got.columns == ["k", "name", "id", "n"]
    assert sorted(got.collect(), key=lambda r: r["id"]) == sorted(wanted.collect(), key=lambda r: r["id"])


def test_numbers_without_a_key(five_ranges):
    got = numbered_by_range(five_ranges.range(1000), [], [F.col("id").desc()], "n").collect()
    assert all(r["n"] == 1000 - r["id"] for r in got) and len(got) == 1000


def test_ties_and_no_rows(five_ranges):
    rows = five_ranges.range(600).select(F.lit(1).alias("k"), F.lit("same").alias("name"))
    assert sorted(r["n"] for r in numbered_by_range(rows, ["k"], [F.col("name")], "n").collect()) == list(range(1, 601))
    assert numbered_by_range(rows.where("k = 2"), ["k"], [F.col("name")], "n").count() == 0
