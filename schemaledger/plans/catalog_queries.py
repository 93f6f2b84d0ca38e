"""Queries from catalogue relations of each kind of database to stored snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import model
from ..session import written
from . import dialect_queries, landed_catalogs  # noqa: F401  (the dialects' statements are parts of these)
from .catalog_plan import collected_catalogs
from .registry import ORACLES, query


def _list(items: str, *fields: str) -> Column:
    text = lambda i: F.concat_ws(" ", *[i[f].cast("string") for f in fields])
    return F.array_join(F.transform(items, text), ", ")


def _printed(stored: DataFrame) -> DataFrame:
    """One row per stored table, view and routine, and one per skipped schema."""
    objects = stored.where(F.col("kind").isin(model.TABLE_KIND, model.VIEW_KIND, model.ROUTINE_KIND))
    printed = objects.select(
        "kind", "snapshot_id", "schema_name", "name", "comment", _list("columns", "name", "type", "nullable", "default", "comment").alias("column_list"),
        F.array_join("primary_key.constrained_columns", ",").alias("primary_key"),
        _list("unique_constraints", "name").alias("unique_keys"),
        F.array_join(F.transform("foreign_keys", lambda k: F.concat_ws(
            " ", k["name"], F.array_join(k["constrained_columns"], ","), k["referred_table"], F.array_join(k["referred_columns"], ","))), ", ").alias("foreign_key_list"),
        F.array_join(F.transform("indexes", lambda i: F.concat_ws(
            " ", i["name"], F.array_join(i["column_names"], ","), i["unique"].cast("string"))), ", ").alias("index_list"),
        F.col("storage.total_bytes").alias("total_bytes"), F.col("permissions.checked_as").alias("checked_as"), "routine_type", "definition",
    )
    skipped = stored.where(F.col("kind") == model.SNAPSHOT).select("snapshot_id", F.explode("skipped_schemas.name").alias("schema_name"))
    return printed.unionByName(skipped.withColumn("kind", F.lit("skipped")), allowMissingColumns=True)


def _sql(
    kinds: tuple[str, ...], storage: str, routines: str | None, tables: str = "true", star: str = "", own: str = "false",
    keys: bool = True, grants: bool = True,
) -> str:
    """``storage`` / ``routines``: registered queries of these facets. ``tables``: which are tables to the kind. ``star``:
    who a grant on everything is checked as. ``own``: schemas whose objects are granted without a grant."""
    listed = ", ".join(f"'{k}'" for k in kinds)
    checked = "coalesce(" + (f"CASE WHEN full_items THEN coalesce(username, '{star}') END" if star else
               f"CASE WHEN full_items AND ({{granted}}) AND {str(grants).lower()} THEN coalesce(username, 'current_user') END") + ", 'not_collected')"
    key = lambda text: text if keys else "''"
    routine_rows = f"""
        UNION ALL
        SELECT 'procedure', h.snapshot_id, h.schema_name, r.name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, r.routine_type, r.definition
        FROM seen h JOIN ({ORACLES[routines]}) r USING (snapshot_id, schema_name) WHERE full_items""" if routines else ""
    return f"""
    , h AS (SELECT p.id AS snapshot_id, p.data_source_id, p.yr, s.db_type, p.yr % 3 <> 0 AS full_items, p.yr % 4 <> 0 AS sized,
                   CASE WHEN p.data_source_id % 2 = 1 THEN 'reader' END AS username
            FROM p1_snapshots p JOIN p1_sources s ON s.id = p.data_source_id WHERE s.db_type IN ({listed})),
    present AS (SELECT DISTINCT snapshot_id, schema_name FROM p1_columns),
    wanted AS (SELECT h.snapshot_id, unnest(['BUILDING', 'absent']) AS schema_name FROM h WHERE yr % 5 = 0
               UNION ALL SELECT snapshot_id, 'MACHINERY' FROM h WHERE yr % 5 <> 0 AND db_type = 'bigquery' AND yr % 2 = 0
               UNION ALL SELECT h.snapshot_id, schema_name FROM h JOIN present USING (snapshot_id)
                         WHERE yr % 5 <> 0 AND NOT (db_type = 'bigquery' AND yr % 2 = 0)),
    seen AS (SELECT h.*, w.schema_name FROM h JOIN wanted w USING (snapshot_id) JOIN present USING (snapshot_id, schema_name)),
    cols AS (SELECT snapshot_id, schema_name, table_name, min(column_name) AS first_column, count(*) AS n,
                    string_agg(concat_ws(' ', column_name, data_type, CAST(nullable AS VARCHAR), CASE substr(column_name, 1, 1) WHEN '1' THEN '0' END,
                                         CASE substr(column_name, 1, 1) WHEN '2' THEN 'second' END), ', ' ORDER BY column_name) AS column_list,
                    string_agg(CASE WHEN data_bytes % 3 = 0 THEN concat('fk_', substr(column_name, 1, 1), ' ', column_name, ' ref_',
                                         substr(column_name, 1, 1), ' ', column_name) END, ', ' ORDER BY column_name) AS foreign_key_list
             FROM p1_columns GROUP BY ALL),
    ix AS (SELECT snapshot_id, schema_name, table_name, string_agg(concat(index_name, ' ', first_column, CASE WHEN column_count > 1
                  THEN ',more' ELSE '' END, ' ', CAST(is_unique AS VARCHAR)), ', ' ORDER BY index_name) AS index_list FROM p1_indexes GROUP BY ALL),
    named AS (SELECT t.*, g.table_name IS NOT NULL AS is_granted FROM p1_tables t LEFT JOIN p1_grants g USING (data_source_id, schema_name, table_name)
              WHERE {tables})
    SELECT 'table' AS kind, h.snapshot_id, h.schema_name, t.table_name AS name, concat('about ', t.table_name) AS comment, column_list,
           {key("CASE WHEN c.n > 1 THEN first_column ELSE '' END")} AS primary_key, {key("CASE WHEN c.n > 1 THEN 'uq' ELSE '' END")} AS unique_keys,
           {key("coalesce(foreign_key_list, '')")} AS foreign_key_list, {key("CASE WHEN full_items THEN index_list ELSE '' END")} AS index_list,
           CASE WHEN sized THEN coalesce(s.total_bytes, 0) END AS total_bytes, {checked.format(granted=f"t.is_granted OR {own}")} AS checked_as,
           NULL AS routine_type, NULL AS definition
    FROM seen h JOIN named t USING (snapshot_id, schema_name) JOIN cols c USING (snapshot_id, schema_name, table_name)
    LEFT JOIN ix USING (snapshot_id, schema_name, table_name) LEFT JOIN ({ORACLES[storage]}) s USING (snapshot_id, schema_name, table_name)
    UNION ALL
    SELECT 'view', h.snapshot_id, h.schema_name, v.name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {checked.format(granted=own)}, NULL, v.definition
    FROM seen h JOIN p1_views v USING (snapshot_id, schema_name){routine_rows}
    UNION ALL
    SELECT 'skipped', snapshot_id, schema_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
    FROM wanted ANTI JOIN present USING (snapshot_id, schema_name)"""


_BLOCKS = ("p1_columns", "p1_tables", "p1_snapshots", "p1_sources", "p1_indexes", "p1_views", "p1_grants")


def _snapshots(spark, sf, *kinds: str) -> DataFrame:
    heads = written(landed_catalogs.headers(spark, sf).where(F.col("db_type").isin(list(kinds))))
    return _printed(collected_catalogs(heads, landed_catalogs.landed(spark, sf, kinds, heads)))


@query("a3_postgresql_snapshots", *_BLOCKS, sql=_sql(("postgresql",), "n1_storage_postgresql", "n8_routines_postgresql"))
def postgresql_snapshots(spark, sf):
    """Snapshots of PostgreSQL sources from their catalogue relations, with their choice of schemas and items."""
    return _snapshots(spark, sf, "postgresql")


@query("a3_mysql_snapshots", *_BLOCKS, sql=_sql(("mysql", "mariadb"), "n2_storage_mysql", "n9_routines_mysql"))
def mysql_snapshots(spark, sf):
    return _snapshots(spark, sf, "mysql", "mariadb")


@query("a3_mssql_snapshots", *_BLOCKS, sql=_sql(("mssql",), "n3_storage_mssql", "n10_routines_mssql"))
def mssql_snapshots(spark, sf):
    return _snapshots(spark, sf, "mssql")


@query("a3_oracle_snapshots", *_BLOCKS, sql=_sql(("oracle",), "n4_storage_oracle", "n11_routines_oracle", own="h.schema_name = 'BUILDING'"))
def oracle_snapshots(spark, sf):
    return _snapshots(spark, sf, "oracle")


@query("a3_db2_snapshots", *_BLOCKS, sql=_sql(("db2",), "n6_storage_db2", "n9_routines_db2", tables="column_count % 4 <> 0"))
def db2_snapshots(spark, sf):
    return _snapshots(spark, sf, "db2")


@query("a3_sqlite_snapshots", *_BLOCKS, sql=_sql(("sqlite",), "n5_storage_sqlite", None, tables="t.table_name NOT LIKE '%7'", star="sqlite").replace(
    "concat('about ', t.table_name) AS comment", "CAST(NULL AS VARCHAR) AS comment"))
def sqlite_snapshots(spark, sf):
    return _snapshots(spark, sf, "sqlite")


@query("a3_bigquery_snapshots", *_BLOCKS, sql=_sql(("bigquery",), "n7_storage_bigquery", None, keys=False, grants=False))
def bigquery_snapshots(spark, sf):
    return _snapshots(spark, sf, "bigquery")
