"""Session settings, the shared folder, and the join-side size check."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Ids and a few more columns: some tens of megabytes as a hash table.
BROADCAST_ROWS = 500_000


def local_session(app: str = "schemaledger", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and single-machine runs; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("SCHEMALEDGER_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    A machine-local folder is made only for a local master that names none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="schemaledger-")
    return f"{base.rstrip('/')}/schemaledger-{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = shared_folder(spark)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(narrow: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``narrow`` marked for broadcast if it has at most ``rows`` rows, else as it is.

    For sides of a few id columns that choose among wide rows (payloads): without the mark both sides are shuffled
    before their sizes are known. The count stops at the limit.
    """
    few = narrow.limit(rows + 1).count() <= rows
    return F.broadcast(narrow) if few else narrow
