"""Object listings and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import model
from ..functions import text
from . import flatten

_HEADER = list(model.HEADER_COLUMNS)


def snapshot_objects(objects: DataFrame, schema_name: str | None = None, kind: str | None = None) -> DataFrame:
    """Tables, columns, indexes, views and procedures; the kind `schema` is accepted and gives no rows.

    ``objects`` comes from `flatten.objects`; repeats are kept and (`position`, `item`) gives the document order. Name the
    kind there as well, and nothing else is read or printed.
    """
    if kind is not None and kind not in model.OBJECT_KINDS:
        raise ValueError(f"kind must be one of {', '.join(sorted(model.OBJECT_KINDS))}")
    rows = objects.where(F.col("kind").isin(list(model.LISTED_KINDS)))
    if schema_name:
        rows = rows.where(F.col("schema_name") == schema_name)
    return rows.where(F.col("kind") == kind) if kind else rows


def search_sources(sources: DataFrame, query: str) -> DataFrame:
    return sources.where(text.contains_text(query, F.col("name"), F.col("host"), F.col("database")))


def named_objects(stored: DataFrame) -> DataFrame:
    """Tables, views and procedures as (header, kind, schema_name, name): one scan of five columns."""
    rows = flatten.of_kind(stored, model.TABLE_KIND, model.VIEW_KIND, model.ROUTINE_KIND)
    return rows.select(*_HEADER, "kind", "schema_name", "name")


def search_objects(rows: DataFrame, query: str = "", schema_name: str | None = None) -> DataFrame:
    """Rows whose 'schema.name' holds the trimmed query, in any case, within one schema if given."""
    found = rows.where(text.contains_text(query.strip(), F.col("schema_name"), F.col("name"), separator="."))
    return found.where(F.col("schema_name") == schema_name) if schema_name else found


def visible_counts(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Found tables, views and procedures per snapshot."""
    counts = [F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("table", "view", "procedure")]
    return found.groupBy(*(keys or ["snapshot_id"])).agg(*counts)
