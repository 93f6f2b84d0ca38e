"""From the catalogue relations of each kind of database to rows of the snapshot store."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import model
from ..operators import collect, ledger, normalise
from ..session import broadcast_if_small, written
from ..sources import catalogs
from .collection import collected

# Per kind and facet: the normaliser and the relations it reads, in its order.
Normaliser = tuple[Callable[..., DataFrame], tuple[str, ...]]
_MYSQL_FAMILY: dict[str, Normaliser] = {
    "storage": (normalise.storage_mysql, ("storage",)),
    "routines": (normalise.routines_mysql, ("routines",)),
    "grants": (normalise.grants_mysql, ("grants",)),
}
NORMALISERS: dict[str, dict[str, Normaliser]] = {
    "postgresql": {
        "storage": (normalise.storage_postgresql, ("pg_class", "pg_namespace")),
        "routines": (normalise.routines_postgresql, ("pg_proc", "pg_namespace")),
        "grants": (normalise.grants_postgresql, ("grants",)),
    },
    "mysql": _MYSQL_FAMILY,
    "mariadb": _MYSQL_FAMILY,
    "mssql": {
        "storage": (normalise.storage_mssql, ("partition_stats", "sys_tables", "sys_schemas")),
        "routines": (normalise.routines_mssql, ("sys_objects", "sys_schemas")),
        "grants": (normalise.grants_mssql, ("sys_objects", "sys_schemas")),
    },
    "oracle": {
        "tables": (lambda t: _named(t, "owner", "table_name", "table_name", comment="comment_text"), ("all_tables",)),
        "views": (lambda v: _named(v, "owner", "view_name", "name", definition="definition"), ("all_views",)),
        "storage": (normalise.storage_oracle, ("all_tables", "all_segments", "all_indexes")),
        "routines": (normalise.routines_oracle, ("all_procedures", "all_source")),
        "grants": (normalise.grants_oracle, ("all_tab_privs", "all_tables", "all_views")),
    },
    "db2": {
        "tables": (lambda t: _named(t.where("type = 'T'"), "tabschema", "tabname", "table_name", comment="remarks"), ("syscat_tables",)),
        "storage": (normalise.storage_db2, ("syscat_tables", "tablespaces")),
        "routines": (normalise.routines_db2, ("routines",)),
        "grants": (normalise.grants_db2, ("tabauth",)),
    },
    "sqlite": {
        "tables": (lambda m: _named(_own(m, "table"), "schema_name", "name", "table_name"), ("sqlite_master",)),
        "views": (lambda m: _named(_own(m, "view"), "schema_name", "name", "name", definition="sql"), ("sqlite_master",)),
        "storage": (normalise.storage_sqlite, ("sqlite_master", "dbstat")),
        "grants": (lambda s: s.withColumn("name", F.lit("*")), ("schemata",)),
    },
    "bigquery": {"storage": (normalise.storage_bigquery, ("table_storage",))},
}
_STRUCTURE: dict[str, Normaliser] = {
    "schemas": (lambda s: s, ("schemata",)),
    "tables": (lambda t: _named(t, "schema_name", "table_name", "table_name", comment="comment_text"), ("tables",)),
    "columns": (lambda c: catalogs.with_boolean_nullable(c).withColumnRenamed("comment_text", "comment"), ("columns",)),
    "primary_keys": (lambda k: catalogs.key_lists(k, "PRIMARY KEY"), ("key_columns",)),
    "unique_constraints": (
        lambda k: catalogs.key_lists(k, "UNIQUE").withColumnRenamed("constrained_columns", "column_names"), ("key_columns",)),
    "foreign_keys": (catalogs.reference_lists, ("reference_columns",)),
    "indexes": (catalogs.index_lists, ("index_columns",)),
    "views": (lambda v: v, ("views",)),
}
# Facets without which a schema counts as not readable, and what asks for them; None: always.
_NEEDED = {
    "schemas": None, "tables": "TABLE", "columns": "TABLE", "views": "VIEW", "routines": "PROCEDURE", "grants": "SELECT PRIVILEGE",
    "storage": "STORAGE",
}


def _named(rows: DataFrame, schema: str, name: str, out: str, **more: str) -> DataFrame:
    return rows.select("snapshot_id", F.col(schema).alias("schema_name"), F.col(name).alias(out), *[F.col(c).alias(n) for n, c in more.items()])


def _own(sqlite_master: DataFrame, kind: str) -> DataFrame:
    return sqlite_master.where((F.col("type") == kind) & ~F.col("tbl_name").like("sqlite_%"))


def normalisers(kind: str) -> dict[str, Normaliser]:
    """Every facet of a kind. A relation the kind does not have leaves its facet out."""
    known = catalogs.CATALOG_QUERIES[kind]
    return {f: n for f, n in {**_STRUCTURE, **NORMALISERS[kind]}.items() if all(r in known for r in n[1])}


def facets(kind: str, extracts: Mapping[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """Facets of one kind from its catalogue relations; ``users``: snapshot_id, username.

    Facets whose relations are absent are left out.
    """
    found = {
        facet: normaliser(*[catalogs.conformed(extracts[r], kind, r) for r in reads])
        for facet, (normaliser, reads) in normalisers(kind).items() if all(r in extracts for r in reads)
    }
    if "grants" in found:
        found["grants"] = normalise.grant_rows(found["grants"], users, "sqlite" if kind == "sqlite" else "current_user")
    return found


def requested_schemas(headers: DataFrame, available: DataFrame) -> DataFrame:
    """(snapshot_id, schema_name) to collect: the listed ones, else the data set, else all usable ones."""
    asked = headers.select("snapshot_id", "db_type", F.col("selected_schemas").alias("selected"), "dataset")
    rows = asked.join(available.select("snapshot_id", "schema_name"), "snapshot_id", "left").withColumnRenamed("snapshot_id", "data_source_id")
    return collect.chosen_schemas(rows).withColumnRenamed("data_source_id", "snapshot_id")


def unreadable_snapshots(headers: DataFrame, failures: DataFrame) -> DataFrame:
    """Snapshots that asked for a facet one of whose relations failed. ``failures``: snapshot_id, db_type, relation."""
    needs = sorted(
        {(kind, r, _NEEDED[f]) for kind in model.DB_TYPES for f, (_, reads) in normalisers(kind).items() if f in _NEEDED for r in reads},
        key=str,
    )
    needed = failures.sparkSession.createDataFrame(needs, "db_type STRING, relation STRING, need STRING")
    asked = headers.select("snapshot_id", "items", "storage_growth")
    wanted = F.col("need").isNull() | F.when(F.col("need") == "STORAGE", F.col("storage_growth")).otherwise(F.array_contains("items", F.col("need")))
    return failures.join(needed, ["db_type", "relation"]).join(asked, "snapshot_id").where(wanted).select("snapshot_id").distinct()


def collected_catalogs(
    headers: DataFrame,
    extracts: Mapping[str, Mapping[str, DataFrame]],
    failures: DataFrame | None = None,
    before_headers: DataFrame | None = None,
    before_totals: DataFrame | None = None,
) -> DataFrame:
    """Store rows of snapshots from the catalogue relations of their databases.

    ``headers``: as in `collect.assemble`, with items as they were asked for, and username, selected_schemas, dataset.
    ``extracts``: kind -> relation -> rows, scanned or landed. ``failures``: relations that could not be read.

    Only chosen schemas and items go on. A listed schema that the catalogue does not show, and every schema of a snapshot
    whose tables, views, routines, grants or sizes were asked for and could not be read, is noted as skipped; keys,
    indexes and comments that could not be read are left out.
    """
    headers = written(headers.withColumn("items", collect.chosen_items(F.col("items"))))
    users = headers.select("snapshot_id", "username")
    of_facet: dict[str, list[DataFrame]] = {}
    for kind, relations in extracts.items():
        for facet, rows in facets(kind, relations, users).items():
            of_facet.setdefault(facet, []).append(rows)
    merged = {f: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows) for f, rows in of_facet.items()}
    spark = headers.sparkSession
    for facet in ("schemas", "tables", "storage"):
        if facet not in merged:
            merged[facet] = spark.createDataFrame([], collect.facet_ddl(facet))

    available = merged["schemas"].where("schema_name IS NOT NULL")
    requested = requested_schemas(headers, available)
    if failures is not None:
        available = available.join(unreadable_snapshots(headers, failures), "snapshot_id", "left_anti")
    marked = requested.join(available.distinct().withColumn("_found", F.lit(True)), ["snapshot_id", "schema_name"], "left")
    marked = written(marked)
    chosen = broadcast_if_small(marked.where("_found").drop("_found"))
    kept = {f: rows.join(chosen, ["snapshot_id", "schema_name"], "left_semi") for f, rows in merged.items()}
    skipped = ledger.skipped_schemas(marked.drop("_found"), marked.where("_found"))
    lists = skipped.groupBy("snapshot_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("schema_name").alias("name"), "reason"))).alias("skipped_schemas"))
    asked = collect.selected_relations(kept, headers)
    whole = headers.drop("username", "selected_schemas", "dataset").join(lists, "snapshot_id", "left")
    return collected(whole, asked, before_headers, before_totals)
