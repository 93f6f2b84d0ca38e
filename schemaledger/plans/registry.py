"""Registered queries, their oracle statements, and the stored snapshots they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import shared_folder, written
from ..sources.store import append_snapshots, read_snapshots
from . import driver_tables as p1
from .collection import collected
from .oracle_blocks import with_blocks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_STORES: dict[tuple[str, str], str] = {}
_EXTRACTS: dict[tuple[str, str], dict[str, tuple[str, T.StructType]]] = {}


def query(name: str, *needs: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its oracle statement over the blocks in ``needs``."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_blocks(needs, sql)
        return function

    return register


def landed_extracts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Catalogue relations of these tables as landed Parquet extracts; `headers` is one of them.

    They are written on first use in this application, as a producer would land them.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _EXTRACTS:
        path = shared_folder(spark)
        base = written(p1.columns(spark, sf))
        given = {**p1.relations(spark, sf, base), "headers": p1.headers(spark, sf, base)}
        for name, rows in given.items():
            rows.write.parquet(f"{path}/{name}")
        _EXTRACTS[key] = {name: (f"{path}/{name}", rows.schema) for name, rows in given.items()}
    return {name: spark.read.schema(schema).parquet(path) for name, (path, schema) in _EXTRACTS[key].items()}


def store_path(spark: SparkSession, sf: str) -> str:
    """Folder of the snapshot store of these tables; collected on first use in this application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        path = shared_folder(spark)
        relations = landed_extracts(spark, sf)
        append_snapshots(collected(relations.pop("headers"), relations), path)
        _STORES[key] = path
    return _STORES[key]


def stored(spark: SparkSession, sf: str) -> DataFrame:
    return read_snapshots(spark, store_path(spark, sf))


def captured_on() -> Column:
    return F.to_date("captured_at").alias("captured_on")


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        access_queries, catalog_queries, collection_queries, dialect_queries, history_queries, import_queries, ledger_queries,
        scalar_queries, sheet_queries,
    )
