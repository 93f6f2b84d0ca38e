"""Rank of every row in one order over the whole table, without a task that sees it whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import written

_POSITIONS = 33  # monotonically_increasing_id: partition number above, position within the partition below


def ranked(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: 1, 2, 3 … along ``order``, over all rows; rows that are equal in it are numbered in any order.

    Rows are dealt to sorted ranges by sampled borders (a tie breaker spreads rows that are equal in ``order``), and
    written once with their position in the range. The ranks of a range begin after the rows of the ranges before it:
    one number for each range, which is all that one task or a broadcast ever gets.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    along = [*order, F.col("_tie")]
    placed = written(
        tied.repartitionByRange(ranges, *along).sortWithinPartitions(*along).drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    split = placed.withColumn("_range", F.shiftright("_at", _POSITIONS)).withColumn("_at", F.col("_at").bitwiseAND((1 << _POSITIONS) - 1))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = split.groupBy("_range").agg(F.count("*").alias("_rows")).select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_ahead"))
    return split.join(F.broadcast(offsets), "_range").withColumn(out, F.col("_ahead") + F.col("_at") + 1).drop("_range", "_at", "_ahead")
