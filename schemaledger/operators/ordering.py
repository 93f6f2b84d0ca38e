"""Running totals and row numbers that never put a whole key into one task.

A window over a key would sort all rows of the key in one task. Here the rows of a key are cut into blocks that
follow the order; each block is totalled on its own, and only one row per block takes part in the second window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import written

_WITHIN = 33  # monotonically_increasing_id: partition number above, place in the partition below


def running_total(
    rows: DataFrame, keys: list[str], order: list[Column], block: Column, value: Column, out: str
) -> DataFrame:
    """Add ``out``: the total of ``value`` over the key's rows up to and including this one.

    ``block`` must not decrease along ``order``.
    """
    cut = rows.withColumn("_block", block).withColumn("_value", value.cast("bigint"))
    ahead = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_total"))
        .select(*keys, "_block", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).cast("bigint").alias("_ahead"))
    )
    inside = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        cut.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, [*keys, "_block"])
        .withColumn(out, F.col("_inside") + F.col("_ahead"))
        .drop("_block", "_value", "_inside", "_ahead")
    )


def numbered(rows: DataFrame, keys: list[str], order: list[Column], block: Column, out: str) -> DataFrame:
    """Add ``out``: the row number from 1 within the key."""
    return running_total(rows, keys, order, block, F.lit(1), out)


def time_block(moment: Column | str, unit: str = "day") -> Column:
    """Block of a point in time, for `numbered` over a history."""
    return F.date_trunc(unit, F.col(moment) if isinstance(moment, str) else moment)


def number_block(number: Column | str, size: int = 10_000) -> Column:
    """Block of a whole number, for `numbered` over row numbers."""
    return F.floor((F.col(number) if isinstance(number, str) else number) / F.lit(size))


def numbered_by_range(rows: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the row number from 1 within the key, for orders that no block can be derived from (texts, several columns).

    Rows are dealt to ranges of (key, order) by sampled borders, sorted there, and written once. A range holds many keys
    whole and begins with at most one that began before it, so what lies ahead is one row for each range. One key may hold
    all rows. Rows equal in key and order are numbered in any order; null keys are one key. ``keys`` may be empty.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    along = [*[F.col(k) for k in keys], *order, F.col("_tie")]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    sorted_rows = tied.repartitionByRange(ranges, *along).sortWithinPartitions(*along).drop("_tie")
    placed = written(sorted_rows.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", _WITHIN))
    counted = placed.groupBy("_range", *keys).agg(F.count("*").alias("_rows"))
    ahead = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    # Only a key that goes on from an earlier range has rows ahead: at most one row for each range.
    going_on = counted.withColumn("_ahead", F.sum("_rows").over(ahead)).where("_ahead IS NOT NULL")
    going_on = going_on.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_ahead")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_range") == F.col("_r"))
    inside = F.row_number().over(W.partitionBy("_range", *keys).orderBy("_at"))
    found = placed.withColumn("_inside", inside).join(F.broadcast(going_on), same, "left")
    return found.withColumn(out, F.col("_inside") + F.coalesce("_ahead", F.lit(0))).select(*rows.columns, out)
