"""Queries over the export datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..operators import collect, sheets
from .registry import query, stored

_KEY = "snapshot_id, schema_name, table_name"
_LABELS = {
    section: labels
    for section, labels in zip(model.SUMMARY_SECTIONS, (model.SUMMARY_INFO, model.SUMMARY_TOTALS, model.SUMMARY_STORAGE))
}


def _line(section: int, label: int, value: str) -> str:
    name = model.SUMMARY_SECTIONS[section]
    return f"SELECT snapshot_id, '{name}' AS section, '{_LABELS[name][label]}' AS label, CAST({value} AS VARCHAR) AS value FROM facts"


@query("x1_summary_sheet", "p1_growth", "p1_sources", "p1_views", "p1_indexes", "p1_foreign_keys", "p1_fingerprints", sql="""
    , facts AS (SELECT t.snapshot_id, (SELECT fingerprint FROM p1_fingerprints p WHERE p.snapshot_id = t.snapshot_id) AS mark, any_value(s.name) AS source, any_value(s.db_type) AS kind, any_value(s.database_name) AS db,
        any_value(t.captured_on) AS captured_on, count(DISTINCT t.schema_name) AS schemas, count(*) AS tables,
        (SELECT count(*) FROM p1_views v WHERE v.snapshot_id = t.snapshot_id) AS views, sum(t.column_count) AS columns,
        (SELECT count(*) FROM p1_indexes i WHERE i.snapshot_id = t.snapshot_id) AS indexes,
        (SELECT count(*) FROM p1_foreign_keys f WHERE f.snapshot_id = t.snapshot_id) AS keys,
        sum(t.data_bytes) AS d, sum(t.index_bytes) AS i, sum(t.total_bytes) AS t, coalesce(sum(t.growth_bytes), 0) AS g,
        count(*) AS o, count(t.previous_total_bytes) AS c
      FROM p1_growth t JOIN p1_sources s ON s.id = t.data_source_id GROUP BY t.snapshot_id) """ + " UNION ALL ".join([
    _line(0, 0, "source"), _line(0, 1, "kind"), _line(0, 2, "db"), _line(0, 3, "concat(CAST(captured_on AS VARCHAR), ' 00:00:00')"),
    _line(0, 4, "mark"), _line(0, 5, f"'{model.LABEL_OPTION['storage']}'"),
    *[_line(1, i, c) for i, c in enumerate(("schemas", "tables", "views", "columns", "indexes", "keys"))],
    *[_line(2, i, c) for i, c in enumerate(("d", "i", "t", "g", "o", "c"))],
]))
def summary_sheet(spark, sf):
    rows = stored(spark, sf)
    return sheets.summary(rows, collect.fingerprints(rows)).drop("line_no")


@query("x2_table_sheet", "p1_growth", "p1_columns", "p1_indexes", "p1_foreign_keys", sql=f"""
    , c AS (SELECT {_KEY}, CASE WHEN count(*) > 1 THEN min(column_name) ELSE '' END AS primary_key FROM p1_columns GROUP BY ALL),
    i AS (SELECT {_KEY}, count(*) AS n FROM p1_indexes GROUP BY ALL), f AS (SELECT {_KEY}, count(*) AS n FROM p1_foreign_keys GROUP BY ALL)
    SELECT {_KEY}, concat('about ', table_name) AS comment, g.column_count, c.primary_key, coalesce(f.n, 0) AS foreign_key_count,
           coalesce(i.n, 0) AS index_count, g.data_bytes, g.index_bytes, g.total_bytes, g.growth_bytes,
           g.growth_percent / 100 AS growth_fraction, g.row_estimate
    FROM p1_growth g JOIN c USING ({_KEY}) LEFT JOIN i USING ({_KEY}) LEFT JOIN f USING ({_KEY})""")
def table_sheet(spark, sf):
    return sheets.tables(stored(spark, sf))


@query("x3_column_sheet", "p1_columns", sql=f"""
    SELECT {_KEY}, CAST(row_number() OVER w AS INT) AS ordinal, column_name, data_type, nullable, CAST(NULL AS VARCHAR) AS default_value,
           CAST(NULL AS VARCHAR) AS comment, count(*) OVER t > 1 AND column_name = min(column_name) OVER t AS is_primary_key
    FROM p1_columns WINDOW w AS (PARTITION BY {_KEY} ORDER BY column_name), t AS (PARTITION BY {_KEY})""")
def column_sheet(spark, sf):
    return sheets.columns(stored(spark, sf))


@query("x4_view_sheet", "p1_views", sql="SELECT snapshot_id, schema_name, name AS view_name, definition FROM p1_views")
def view_sheet(spark, sf):
    return sheets.views(stored(spark, sf))


@query("x5_index_sheet", "p1_indexes", sql=f"""
    SELECT {_KEY}, index_name, concat(first_column, CASE WHEN column_count > 1 THEN ', …' ELSE ', ' END) AS columns, is_unique FROM p1_indexes""")
def index_sheet(spark, sf):
    return sheets.indexes(stored(spark, sf))


@query("x6_foreign_key_sheet", "p1_foreign_keys", sql=f"""
    SELECT {_KEY}, key_name, column_name AS local_columns, schema_name AS referred_schema, concat('ref_', substr(column_name, 1, 1)) AS referred_table,
           concat(column_name, ', ') AS referred_columns FROM p1_foreign_keys""")
def foreign_key_sheet(spark, sf):
    return sheets.foreign_keys(stored(spark, sf))


@query("x7_procedure_sheet", "p1_routines", sql="""
    SELECT snapshot_id, schema_name, name AS procedure_name, 'PROCEDURE' AS routine_type, definition FROM p1_routines""")
def procedure_sheet(spark, sf):
    return sheets.procedures(stored(spark, sf))


@query("x8_privilege_sheet", "p1_permissions", "p1_views", sql=f"""
    SELECT snapshot_id, schema_name, '{model.LABEL_TABLE}' AS object_type, table_name AS object_name,
           CASE WHEN granted THEN true END AS can_select, checked_as, CASE WHEN granted THEN 'SELECT' ELSE '' END AS privileges FROM p1_permissions
    UNION ALL SELECT snapshot_id, schema_name, '{model.LABEL_VIEW}', name, CASE WHEN schema_name = 'MACHINERY' THEN true END,
           CASE WHEN schema_name = 'MACHINERY' THEN 'current_user' ELSE 'not_collected' END,
           CASE WHEN schema_name = 'MACHINERY' THEN 'SELECT' ELSE '' END FROM p1_views""")
def privilege_sheet(spark, sf):
    return sheets.privileges(stored(spark, sf))


@query("x9_storage_sheet", "p1_growth", sql=f"""
    SELECT {_KEY}, data_bytes, index_bytes, total_bytes, previous_total_bytes, growth_bytes, growth_percent / 100 AS growth_fraction, row_estimate
    FROM p1_growth""")
def storage_sheet(spark, sf):
    return sheets.storage(stored(spark, sf))
