"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node of ``edges``; the label is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours, then follows the label's own label, so the number of
    rounds grows with the logarithm of the longest path. Minima are pre-aggregated before each shuffle, so a node of
    very many edges is no hot group. A round is written to the shared folder: lost executors cost one round at most.
    Null ends are no edges; an empty list gives an empty result.
    """
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(
        F.col(a).alias("node"), F.col(b).alias("other")
    )
    both = written(known.union(known.select("other", "node")).distinct())
    labels = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("other"), "label"), "other")
            .groupBy("node").agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        moved = written(
            lower.join(target, "label", "left")
            .select("node", F.least("label", F.coalesce("beyond", "label")).alias("label"), "was")
        )
        labels = moved.select("node", "label")
        if moved.where(F.col("label") != F.col("was")).isEmpty():
            return labels
