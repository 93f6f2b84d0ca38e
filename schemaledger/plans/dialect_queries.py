"""Queries over the catalogue normalisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import grant_value
from ..operators import normalise
from . import driver_tables as p1, raw_catalogs as raw
from .registry import query

_STORAGE = "snapshot_id, schema_name, table_name"


@query("n1_storage_postgresql", "p1_tables", sql=f"""
    SELECT {_STORAGE}, data_bytes, index_bytes, total_bytes, row_estimate FROM p1_tables WHERE column_count % 3 <> 2""")
def storage_postgresql(spark, sf):
    return normalise.storage_postgresql(raw.pg_class(spark, sf), raw.pg_namespace(spark, sf))


@query("n2_storage_mysql", "p1_tables", sql=f"""
    SELECT {_STORAGE}, data_bytes, CASE WHEN row_estimate IS NULL THEN 0 ELSE index_bytes END AS index_bytes,
           data_bytes + CASE WHEN row_estimate IS NULL THEN 0 ELSE index_bytes END AS total_bytes, row_estimate
    FROM p1_tables WHERE column_count % 4 <> 0""")
def storage_mysql(spark, sf):
    return normalise.storage_mysql(raw.information_schema_tables(spark, sf))


@query("n3_storage_mssql", "p1_columns", sql=f"""
    SELECT {_STORAGE}, CAST(sum(pages // 2 + pages // 4 + 1) * 8192 AS BIGINT) AS data_bytes,
           CAST(sum(pages + 4 - pages // 2 - pages // 4) * 8192 AS BIGINT) AS index_bytes,
           CAST(sum(pages + 7) * 8192 AS BIGINT) AS total_bytes, count(*) AS row_estimate
    FROM (SELECT *, data_bytes // 8192 AS pages FROM p1_columns) GROUP BY {_STORAGE}""")
def storage_mssql(spark, sf):
    return normalise.storage_mssql(raw.partition_stats(spark, sf), raw.sys_tables(spark, sf), raw.sys_schemas(spark, sf))


@query("n4_storage_oracle", "p1_tables", "p1_indexes", sql=f"""
    , ix AS (SELECT {_STORAGE}, CAST(sum(column_count * 4096) AS BIGINT) AS bytes FROM p1_indexes GROUP BY {_STORAGE}),
    sized AS (SELECT t.snapshot_id, t.schema_name, t.table_name, t.row_estimate,
                     CASE WHEN t.column_count % 2 = 0 THEN t.data_bytes // 2 + 1000 ELSE 0 END AS data_bytes,
                     coalesce(ix.bytes, 0) AS index_bytes
              FROM p1_tables t LEFT JOIN ix USING (snapshot_id, schema_name, table_name))
    SELECT {_STORAGE}, data_bytes, index_bytes, data_bytes + index_bytes AS total_bytes, row_estimate FROM sized""")
def storage_oracle(spark, sf):
    return normalise.storage_oracle(raw.all_tables(spark, sf), raw.all_segments(spark, sf), raw.all_indexes(spark, sf))


@query("n5_storage_sqlite", "p1_tables", "p1_indexes", sql=f"""
    , ix AS (SELECT {_STORAGE}, CAST(sum(column_count * 4096) AS BIGINT) AS bytes FROM p1_indexes GROUP BY {_STORAGE}),
    sized AS (SELECT t.snapshot_id, t.schema_name, t.table_name, t.data_bytes // 2 + 10 AS data_bytes,
                     coalesce(ix.bytes, 0) AS index_bytes
              FROM p1_tables t LEFT JOIN ix USING (snapshot_id, schema_name, table_name) WHERE t.table_name NOT LIKE '%7')
    SELECT {_STORAGE}, data_bytes, index_bytes, data_bytes + index_bytes AS total_bytes, CAST(NULL AS BIGINT) AS row_estimate
    FROM sized""")
def storage_sqlite(spark, sf):
    return normalise.storage_sqlite(raw.sqlite_master(spark, sf), raw.dbstat(spark, sf))


@query("n6_storage_db2", "p1_tables", sql=f"""
    SELECT {_STORAGE}, CASE WHEN row_estimate IS NULL THEN 0 ELSE data_bytes // 4096 * page END AS data_bytes,
           CAST(0 AS BIGINT) AS index_bytes, (data_bytes // 4096 + 3) * page AS total_bytes, row_estimate
    FROM (SELECT *, CAST(CASE column_count % 3 WHEN 0 THEN 8192 WHEN 1 THEN 16384 ELSE 4096 END AS BIGINT) AS page FROM p1_tables)
    WHERE column_count % 4 <> 0""")
def storage_db2(spark, sf):
    return normalise.storage_db2(raw.syscat_tables(spark, sf), raw.syscat_tablespaces(spark, sf))


@query("n7_storage_bigquery", "p1_tables", sql=f"""
    SELECT {_STORAGE}, data_bytes, CAST(0 AS BIGINT) AS index_bytes, data_bytes AS total_bytes, row_estimate
    FROM p1_tables WHERE column_count % 5 <> 0 AND column_count % 4 <> 0""")
def storage_bigquery(spark, sf):
    return normalise.storage_bigquery(raw.table_storage(spark, sf))


_ROUTINE = "snapshot_id, schema_name, name"


@query("n8_routines_postgresql", "p1_routines", sql=f"""
    SELECT {_ROUTINE}, CASE digit WHEN '1' THEN 'PROCEDURE' ELSE 'FUNCTION' END AS routine_type, 'void' AS return_type,
           digit AS arguments, definition FROM p1_routines WHERE digit IN ('1', '2', '3')""")
def routines_postgresql(spark, sf):
    return normalise.routines_postgresql(raw.pg_proc(spark, sf), raw.pg_namespace(spark, sf))


@query("n9_routines_mysql", "p1_routines", sql=f"""
    SELECT {_ROUTINE}, 'FUNCTION' AS routine_type, digit AS return_type, definition FROM p1_routines""")
def routines_mysql(spark, sf):
    return normalise.routines_mysql(raw.mysql_routines(spark, sf)).drop("arguments")


@query("n9_routines_db2", "p1_routines", sql=f"""
    SELECT {_ROUTINE}, 'P' AS routine_type, definition FROM p1_routines""")
def routines_db2(spark, sf):
    return normalise.routines_db2(raw.db2_routines(spark, sf)).drop("arguments", "return_type")


@query("n10_routines_mssql", "p1_routines", sql=f"""
    SELECT {_ROUTINE}, 'ROUTINE' AS routine_type, definition FROM p1_routines WHERE digit <> '4'""")
def routines_mssql(spark, sf):
    return normalise.routines_mssql(raw.sys_objects(spark, sf), raw.sys_schemas(spark, sf)).drop("arguments", "return_type")


@query("n11_routines_oracle", "p1_routine_lines", sql=f"""
    SELECT {_ROUTINE}, CASE digit WHEN '1' THEN 'PACKAGE' WHEN '2' THEN 'FUNCTION' ELSE 'PROCEDURE' END AS routine_type,
           CASE WHEN digit <> '5' THEN string_agg(text, chr(10) ORDER BY line) END AS definition
    FROM p1_routine_lines WHERE digit <> '3' GROUP BY snapshot_id, schema_name, name, digit""")
def routines_oracle(spark, sf):
    rows = normalise.routines_oracle(raw.all_procedures(spark, sf), raw.all_source(spark, sf))
    return rows.drop("arguments", "return_type")


_GRANT = "SELECT data_source_id AS snapshot_id, schema_name, table_name AS name FROM p1_grants"


@query("n12_grants_postgresql", "p1_grants", sql=f"{_GRANT} WHERE k % 3 = 0 AND k % 4 <> 0")
def grants_postgresql(spark, sf):
    return normalise.grants_postgresql(raw.role_table_grants(spark, sf))


@query("n12_grants_mysql", "p1_grants", sql=f"{_GRANT} WHERE k % 3 = 0 AND k % 4 <> 0")
def grants_mysql(spark, sf):
    return normalise.grants_mysql(raw.role_table_grants(spark, sf, quoted=True))


@query("n13_grants_mssql", "p1_grants", sql=f"{_GRANT} WHERE k % 3 <> 2 AND k % 2 = 1")
def grants_mssql(spark, sf):
    return normalise.grants_mssql(raw.permission_objects(spark, sf), raw.permission_schemas(spark, sf))


@query("n14_grants_oracle", "p1_grants", sql=f"""
    {_GRANT} WHERE k % 4 <> 0 AND k % 3 <> 2
    UNION {_GRANT} WHERE schema_name = 'BUILDING' AND k % 2 = 0
    UNION {_GRANT} WHERE schema_name = 'BUILDING' AND k % 3 = 0""")
def grants_oracle(spark, sf):
    return normalise.grants_oracle(raw.all_tab_privs(spark, sf), raw.owned_tables(spark, sf), raw.owned_views(spark, sf))


@query("n15_grants_db2", "p1_grants", sql=f"{_GRANT} WHERE k % 4 <> 3 AND (k % 3 = 0 OR k % 5 = 0)")
def grants_db2(spark, sf):
    return normalise.grants_db2(raw.tabauth(spark, sf))


def _flat():
    return [
        F.col("permissions.select").alias("can_select"), F.array_join("permissions.privileges", ",").alias("privileges"),
        F.col("permissions.checked_as").alias("checked_as"),
    ]


@query("n16_grants_sqlite", "p1_tables", sql="""
    SELECT DISTINCT snapshot_id, schema_name, '*' AS name, true AS can_select, 'SELECT' AS privileges,
           CASE WHEN data_source_id % 2 = 0 THEN 'sqlite' ELSE 'reader' END AS checked_as FROM p1_tables""")
def grants_sqlite(spark, sf):
    user = F.when(F.col("data_source_id") % 2 == 0, "").otherwise("reader")
    schemas = p1.tables(spark, sf).select("snapshot_id", "schema_name", user.alias("username")).distinct()
    return normalise.grants_sqlite(schemas).select("snapshot_id", "schema_name", "name", *_flat())


@query("n17_grant_shape", "p1_connections", sql="""
    SELECT id, true AS can_select, 'SELECT' AS privileges,
           CASE WHEN username = '' THEN 'current_user' ELSE username END AS checked_as FROM p1_connections""")
def grant_shape(spark, sf):
    rows = p1.connections(spark, sf).select("id", grant_value(F.col("username")).alias("permissions"))
    return rows.select("id", *_flat())
