"""Queries over flattening, history, growth and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import model
from ..functions.text import join_values
from ..operators import collect, diff, flatten, history, names, search
from ..session import shared_folder
from ..sources import store
from . import driver_tables as p1
from .registry import captured_on, query, stored

_TABLE = ["snapshot_id", "schema_name", "table_name"]


def _heads(spark, sf) -> DataFrame:
    """Snapshot headers without payload."""
    return p1.snapshots(spark, sf).select(
        F.col("id").alias("snapshot_id"), "data_source_id", "run_id", F.col("captured_on").cast("timestamp_ntz").alias("captured_at")
    )


def _column_objects(spark, sf) -> DataFrame:
    rows = p1.columns(spark, sf)
    value = F.to_json(
        F.struct(F.lit(None).cast("string").alias("comment"), F.lit(None).cast("string").alias("default"),
                 F.col("column_name").alias("name"), "nullable", F.col("data_type").alias("type")),
        {"ignoreNullFields": "false"},
    )
    return rows.select(
        "data_source_id", "snapshot_id", "schema_name", "table_name", F.col("column_name").alias("name"), value.alias("value"),
    )


_PARTS = ["schema_name", "table_name", "name"]
_PAIR = ["data_source_id", "from_snapshot_id", "to_snapshot_id"]


def _changes(spark, sf, digests: bool = False) -> DataFrame:
    """All changes between neighbouring snapshots; with ``digests`` values shrink to theirs before they are shuffled."""
    rows = _column_objects(spark, sf)
    if digests:
        rows = rows.withColumn("value", F.unhex(F.sha2("value", 256)))
    return diff.neighbour_changes(rows, _heads(spark, sf), _PARTS)


def _printed(rows: DataFrame) -> DataFrame:
    key = F.concat(F.lit("column:"), F.concat_ws(".", *_PARTS))
    return rows.withColumn("key", key)


_SIDES = """
    , pairs AS (SELECT s.data_source_id, p.previous_id AS from_snapshot_id, s.id AS to_snapshot_id
                FROM p1_previous p JOIN p1_snapshots s ON s.id = p.snapshot_id WHERE p.previous_id IS NOT NULL),
    b AS (SELECT p.from_snapshot_id, p.to_snapshot_id, o.* FROM p1_objects o JOIN pairs p ON p.from_snapshot_id = o.snapshot_id),
    a AS (SELECT p.from_snapshot_id, p.to_snapshot_id, o.* FROM p1_objects o JOIN pairs p ON p.to_snapshot_id = o.snapshot_id)"""
_SAME = "a.to_snapshot_id = b.to_snapshot_id AND a.schema_name = b.schema_name AND a.table_name = b.table_name AND a.name = b.name"
_CHANGES = _SIDES + f"""
    , changes AS (SELECT coalesce(a.data_source_id, b.data_source_id) AS data_source_id, coalesce(a.from_snapshot_id, b.from_snapshot_id) AS from_snapshot_id,
        coalesce(a.to_snapshot_id, b.to_snapshot_id) AS to_snapshot_id, coalesce(a.schema_name, b.schema_name) AS schema_name,
        coalesce(a.table_name, b.table_name) AS table_name, coalesce(a.name, b.name) AS name, coalesce(a."key", b."key") AS "key",
        CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed' WHEN a.value <> b.value THEN 'changed' END AS change,
        b.value AS before_value, a.value AS after_value
      FROM b FULL JOIN a ON {_SAME})"""
_NEEDS = ("p1_snapshots", "p1_previous", "p1_objects")


# --- differences -------------------------------------------------------------------------------------------------
@query("c6_snapshot_diff", *_NEEDS, sql=_CHANGES + " SELECT * FROM changes WHERE change IS NOT NULL")
def snapshot_diff(spark, sf):
    """Column changes between every two neighbouring snapshots of every source, from flat relations."""
    return _printed(_changes(spark, sf)).where("change <> 'same'")


@query("c6_payload_diff", *_NEEDS, sql=_CHANGES + """
    SELECT from_snapshot_id, to_snapshot_id, change, "key", before_value, after_value FROM changes WHERE change IS NOT NULL""")
def payload_diff(spark, sf):
    """The same changes taken from the store: digests choose the tables, whose columns alone are printed."""
    rows = stored(spark, sf)
    changes = diff.snapshot_diff(rows, diff.neighbour_pairs(history.headers(rows)), kinds=("column",))
    return changes.select("from_snapshot_id", "to_snapshot_id", "change", "key", "before_value", "after_value")


_LINE = _SIDES.replace(", pairs AS", """, line AS (SELECT id AS snapshot_id, row_number() OVER (PARTITION BY data_source_id ORDER BY captured_on, id) AS seq FROM p1_snapshots),
    pairs AS""", 1)


@query("c6_object_versions", *_NEEDS, sql=_LINE + """
    , o AS (SELECT o.*, l.seq FROM p1_objects o JOIN line l USING (snapshot_id)),
    s AS (SELECT *, CASE WHEN lag(seq) OVER w = seq - 1 AND lag(value) OVER w = value THEN 0 ELSE 1 END AS start FROM o
      WINDOW w AS (PARTITION BY data_source_id, "key" ORDER BY seq)),
    r AS (SELECT *, sum(start) OVER (PARTITION BY data_source_id, "key" ORDER BY seq) AS run FROM s)
    SELECT data_source_id, "key", CAST(min(seq) AS BIGINT) AS first_seq, CAST(max(seq) AS BIGINT) AS last_seq, any_value(value) AS value FROM r GROUP BY data_source_id, "key", run""")
def object_versions(spark, sf):
    """Columns of the store, once for each run of neighbouring snapshots in which they did not change."""
    rows = stored(spark, sf)
    columns = flatten.objects(rows, kinds=("column",))
    found = diff.object_versions(columns, history.headers(rows), list(flatten.OBJECT_KEY))
    return found.select("data_source_id", flatten.printed_key().alias("key"), "first_seq", "last_seq", "value")


@query("c6_version_diff", *_NEEDS, sql=_LINE + """
    , ends AS (SELECT data_source_id, max(seq) AS to_seq FROM line JOIN p1_snapshots ON id = snapshot_id GROUP BY data_source_id HAVING max(seq) > 1),
    o AS (SELECT o.*, l.seq FROM p1_objects o JOIN line l USING (snapshot_id)),
    x AS (SELECT * FROM o WHERE seq = 1 AND data_source_id IN (SELECT data_source_id FROM ends)), y AS (SELECT o.* FROM o JOIN ends e ON e.data_source_id = o.data_source_id AND e.to_seq = o.seq),
    c AS (SELECT coalesce(x.data_source_id, y.data_source_id) AS data_source_id, coalesce(x."key", y."key") AS "key", x.value AS before_value, y.value AS after_value,
        CASE WHEN x.value IS NULL THEN 'added' WHEN y.value IS NULL THEN 'removed' WHEN x.value <> y.value THEN 'changed' END AS change
      FROM x FULL JOIN y ON x.data_source_id = y.data_source_id AND x."key" = y."key")
    SELECT data_source_id, "key", change, before_value, after_value FROM c WHERE change IS NOT NULL""")
def version_diff(spark, sf):
    """First against last snapshot of every source, from the versions alone."""
    rows = stored(spark, sf)
    heads = history.headers(rows)
    keys = list(flatten.OBJECT_KEY)
    versions = diff.object_versions(flatten.objects(rows, kinds=("column",)), heads, keys)
    ends = heads.groupBy("data_source_id").agg(F.lit(1).cast("bigint").alias("from_seq"), F.count("*").alias("to_seq")).where("to_seq > 1")
    found = diff.version_diff(versions, ends, keys)
    return found.select("data_source_id", flatten.printed_key().alias("key"), "change", "before_value", "after_value")


@query("c4_added_objects", *_NEEDS, sql=_SIDES + f"""
    SELECT data_source_id, to_snapshot_id, "key" FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_SAME})""")
def added_objects(spark, sf):
    return _printed(_changes(spark, sf, digests=True)).where("change = 'added'").select("data_source_id", "to_snapshot_id", "key")


@query("c5_removed_objects", *_NEEDS, sql=_SIDES + f"""
    SELECT data_source_id, to_snapshot_id, "key" FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {_SAME})""")
def removed_objects(spark, sf):
    return _printed(_changes(spark, sf, digests=True)).where("change = 'removed'").select("data_source_id", "to_snapshot_id", "key")


@query("g5_key_sets", *_NEEDS, sql=_CHANGES + """
    SELECT data_source_id, to_snapshot_id, CASE WHEN change IN ('added', 'removed') THEN change ELSE 'common' END AS member, count(*) AS object_count
    FROM changes GROUP BY ALL""")
def key_sets(spark, sf):
    member = F.when(F.col("change").isin("added", "removed"), F.col("change")).otherwise("common")
    sets = _changes(spark, sf, digests=True).withColumn("member", member)
    return sets.groupBy("data_source_id", "to_snapshot_id", "member").agg(F.count("*").alias("object_count"))


@query("d10_diff_counts", *_NEEDS, sql=_CHANGES + """
    SELECT data_source_id, to_snapshot_id, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed,
           count(*) FILTER (change = 'changed') AS changed FROM changes WHERE change IS NOT NULL GROUP BY data_source_id, to_snapshot_id""")
def diff_counts(spark, sf):
    return diff.diff_counts(_changes(spark, sf, digests=True).where("change <> 'same'"), ["data_source_id", "to_snapshot_id"])


@query("b8_same_source_guard", "p1_snapshots", sql="""
    , pairs AS (SELECT data_source_id, id AS from_snapshot_id,
                       CASE id % 3 WHEN 0 THEN id + 1 WHEN 1 THEN id + 10000 ELSE id END AS to_snapshot_id FROM p1_snapshots)
    SELECT p.from_snapshot_id, p.to_snapshot_id, p.data_source_id,
           CASE WHEN t.id IS NULL THEN 'unknown snapshot' WHEN t.data_source_id <> p.data_source_id THEN 'other source' END AS reason,
           coalesce(t.data_source_id = p.data_source_id, false) AS valid
    FROM pairs p LEFT JOIN p1_snapshots t ON t.id = p.to_snapshot_id""")
def same_source_guard(spark, sf):
    key = F.col("snapshot_id")
    other = F.when(key % 3 == 0, key + 1).when(key % 3 == 1, key + 10000).otherwise(key)
    heads = _heads(spark, sf)
    pairs = heads.select("data_source_id", key.alias("from_snapshot_id"), other.alias("to_snapshot_id"))
    return diff.checked_pairs(pairs, heads)


# --- latest, growth, summaries -----------------------------------------------------------------------------------
_LATEST = """
    , latest AS (SELECT *, row_number() OVER (PARTITION BY data_source_id ORDER BY captured_on DESC, id DESC) AS rn FROM p1_snapshots)"""


@query("e1_latest_snapshots", "p1_snapshots", sql=_LATEST + """
    SELECT id AS snapshot_id, data_source_id, run_id, captured_on FROM latest WHERE rn = 1""")
def latest_snapshots(spark, sf):
    return history.latest(_heads(spark, sf)).select("snapshot_id", "data_source_id", "run_id", captured_on())


@query("e2_latest_metadata", "p1_snapshots", "p1_columns", sql=_LATEST + """
    SELECT l.id AS snapshot_id, l.data_source_id, l.captured_on, count(*) AS column_count
    FROM latest l JOIN p1_columns c ON c.snapshot_id = l.id WHERE l.rn = 1 GROUP BY ALL""")
def latest_metadata(spark, sf):
    """Newest snapshot per source with its payload, newest first."""
    columns = flatten.column_history(history.latest_with_payload(stored(spark, sf)))
    counts = columns.groupBy("snapshot_id", "data_source_id", captured_on()).agg(F.count("*").alias("column_count"))
    return counts.orderBy(F.col("captured_on").desc(), F.col("snapshot_id").desc())


@query("e3_storage_growth", "p1_growth", sql="""
    SELECT snapshot_id, schema_name, table_name, total_bytes, previous_total_bytes, growth_bytes, growth_percent FROM p1_growth""")
def storage_growth(spark, sf):
    rows = p1.tables(spark, sf).select(*_TABLE, "total_bytes")
    return history.storage_growth(rows, _heads(spark, sf))


@query("c3_previous_totals", "p1_growth", sql="""
    SELECT snapshot_id, schema_name, table_name, total_bytes, previous_total_bytes FROM p1_growth""")
def previous_totals(spark, sf):
    heads = history.sequenced(_heads(spark, sf))
    old = heads.select("data_source_id", (F.col("seq") + 1).alias("seq"), F.col("snapshot_id").alias("previous_snapshot_id"))
    pairs = heads.join(old, ["data_source_id", "seq"], "left")
    rows = history.previous_totals(p1.tables(spark, sf).select(*_TABLE, "total_bytes"), pairs)
    return rows.drop("previous_snapshot_id")


@query("d4_storage_summary", "p1_growth", sql="""
    SELECT snapshot_id, CAST(sum(data_bytes) AS BIGINT) AS data_bytes, CAST(sum(index_bytes) AS BIGINT) AS index_bytes,
           CAST(sum(total_bytes) AS BIGINT) AS total_bytes, CAST(coalesce(sum(growth_bytes), 0) AS BIGINT) AS growth_bytes,
           count(*) AS observed_tables, count(previous_total_bytes) AS comparable_tables FROM p1_growth GROUP BY snapshot_id""")
def storage_summary(spark, sf):
    rows = p1.tables(spark, sf).select(*_TABLE, "data_bytes", "index_bytes", "total_bytes")
    return history.storage_summary(history.storage_growth(rows, _heads(spark, sf)))


_COUNTS = """
    , t AS (SELECT snapshot_id, schema_name, count(*) AS n FROM p1_tables GROUP BY ALL),
    v AS (SELECT snapshot_id, schema_name, count(*) AS n FROM p1_views GROUP BY ALL)"""


@query("d1_snapshot_summary", "p1_tables", "p1_views", "p1_sources", sql=_COUNTS + """
    SELECT t.snapshot_id, s.name AS source, s.db_type, s.database_name AS "database", count(*) AS schema_count,
           CAST(sum(t.n) AS BIGINT) AS table_count, CAST(sum(v.n) AS BIGINT) AS view_count,
           CAST(sum(v.n) AS BIGINT) AS procedure_count, 0 AS skipped_count
    FROM t JOIN v USING (snapshot_id, schema_name) JOIN p1_sources s ON s.id = t.snapshot_id // 10000 GROUP BY ALL""")
def snapshot_summary(spark, sf):
    rows = history.snapshot_summary(stored(spark, sf))
    return rows.select(
        "snapshot_id", "source", "db_type", "database", "schema_count", "table_count", "view_count", "procedure_count",
        F.size("skipped_schemas").alias("skipped_count"),
    )


@query("f3_newest_snapshots", "p1_tables", "p1_snapshots", sql=_LATEST + """
    SELECT l.data_source_id, l.id AS snapshot_id, count(*) AS table_count FROM latest l
    JOIN p1_tables t ON t.snapshot_id = l.id WHERE rn <= 3 GROUP BY ALL""")
def newest_snapshots(spark, sf):
    """Summaries of the three newest snapshots of every source."""
    rows = stored(spark, sf)
    kept = history.of_snapshots(rows, history.newest(history.headers(rows), 3))
    return history.snapshot_summary(kept).select("data_source_id", "snapshot_id", "table_count")


@query("f3_newest_of_source", "p1_snapshots", sql=_LATEST + """
    SELECT id AS snapshot_id, captured_on FROM latest WHERE data_source_id = 3 AND rn <= 5""")
def newest_of_source(spark, sf):
    return history.newest_of_source(history.headers(store.snapshots_of_source(stored(spark, sf), 3)), 3, 5).select("snapshot_id", captured_on())


@query("d2_collected_objects", "p1_tables", "p1_views", sql=_COUNTS + """
    SELECT snapshot_id, CAST(sum(t.n + v.n + v.n) AS BIGINT) AS object_count FROM t JOIN v USING (snapshot_id, schema_name) GROUP BY 1""")
def collected_objects(spark, sf):
    return history.collected_objects(stored(spark, sf))


@query("d3_schema_history", "p1_tables", "p1_views", sql=_COUNTS + """
    SELECT snapshot_id, schema_name, t.n AS table_count, v.n AS view_count, v.n AS procedure_count
    FROM t JOIN v USING (snapshot_id, schema_name)""")
def schema_history(spark, sf):
    rows = flatten.schema_history(stored(spark, sf))
    return rows.select("snapshot_id", "schema_name", "table_count", "view_count", "procedure_count")


@query("d13_schema_totals", "p1_tables", "p1_views", sql=_COUNTS + """
    SELECT snapshot_id, schema_name, t.n + v.n + v.n AS object_count FROM t JOIN v USING (snapshot_id, schema_name)""")
def schema_totals(spark, sf):
    return history.schema_totals(stored(spark, sf)).select("snapshot_id", "schema_name", "object_count")


@query("d6_export_totals", "p1_columns", "p1_tables", "p1_views", "p1_indexes", "p1_foreign_keys", sql="""
    SELECT t.snapshot_id, count(DISTINCT t.schema_name) AS schemas, count(*) AS tables,
           (SELECT count(*) FROM p1_views v WHERE v.snapshot_id = t.snapshot_id) AS views,
           CAST(sum(t.column_count) AS BIGINT) AS columns,
           (SELECT count(*) FROM p1_indexes i WHERE i.snapshot_id = t.snapshot_id) AS indexes,
           (SELECT count(*) FROM p1_foreign_keys f WHERE f.snapshot_id = t.snapshot_id) AS foreign_keys
    FROM p1_tables t GROUP BY t.snapshot_id""")
def export_totals(spark, sf):
    return history.export_totals(stored(spark, sf))


@query("d7_table_counts", "p1_tables", "p1_indexes", "p1_foreign_keys", sql="""
    SELECT t.snapshot_id, t.schema_name, t.table_name, t.column_count, coalesce(f.n, 0) AS foreign_key_count, coalesce(i.n, 0) AS index_count
    FROM p1_tables t
    LEFT JOIN (SELECT snapshot_id, schema_name, table_name, count(*) AS n FROM p1_foreign_keys GROUP BY ALL) f USING (snapshot_id, schema_name, table_name)
    LEFT JOIN (SELECT snapshot_id, schema_name, table_name, count(*) AS n FROM p1_indexes GROUP BY ALL) i USING (snapshot_id, schema_name, table_name)""")
def table_counts(spark, sf):
    return flatten.table_details(stored(spark, sf)).select(*_TABLE, "column_count", "foreign_key_count", "index_count")


# --- flattening --------------------------------------------------------------------------------------------------
@query("g1_snapshot_history", "p1_tables", "p1_snapshots", "p1_sources", sql="""
    SELECT s.id AS snapshot_id, s.data_source_id, s.run_id, s.captured_on, d.name AS source_name, d.db_type,
           count(DISTINCT t.schema_name) AS schema_count
    FROM p1_snapshots s JOIN p1_sources d ON d.id = s.data_source_id JOIN p1_tables t ON t.snapshot_id = s.id GROUP BY ALL""")
def snapshot_history(spark, sf):
    rows = flatten.snapshot_history(stored(spark, sf))
    return rows.select("snapshot_id", "data_source_id", "run_id", captured_on(), "source_name", "db_type", "schema_count")


@query("g2_table_history", "p1_tables", sql="""
    SELECT snapshot_id, schema_name, table_name, concat('about ', table_name) AS comment FROM p1_tables""")
def table_history(spark, sf):
    return flatten.table_history(stored(spark, sf)).select(*_TABLE, "comment")


@query("g3_column_history", "p1_columns", sql="""
    SELECT snapshot_id, data_source_id, captured_on, schema_name, table_name, column_name, data_type, nullable FROM p1_columns""")
def column_history(spark, sf):
    return flatten.column_history(stored(spark, sf)).select(
        "snapshot_id", "data_source_id", captured_on(), "schema_name", "table_name", "column_name", "data_type", "nullable"
    )


@query("g4_objects", "p1_objects", "p1_values", "p1_indexes", sql="""
    SELECT snapshot_id, kind, "key", value FROM p1_objects
    UNION ALL SELECT snapshot_id, kind, concat(kind, ':', schema_name, '.', name), own_value FROM p1_values
    UNION ALL SELECT snapshot_id, 'index', concat('index:', schema_name, '.', table_name, '.', index_name),
      concat('{"column_names":["', first_column, CASE WHEN column_count > 1 THEN '","…"' ELSE '",null' END, '],"name":"', index_name, '","unique":', is_unique, '}') FROM p1_indexes
    UNION ALL SELECT DISTINCT snapshot_id, 'schema', concat('schema:', schema_name), NULL FROM p1_values WHERE kind = 'table'""")
def objects(spark, sf):
    """Objects of all kinds with their values; storage, which follows the data, is left out of them."""
    rows = flatten.objects(stored(spark, sf), without=("storage",))
    return flatten.keyed_objects(rows).select("snapshot_id", "kind", "key", "value")


@query("g6_privileges", "p1_permissions", "p1_views", sql=f"""
    SELECT snapshot_id, schema_name, '{model.LABEL_TABLE}' AS object_type, table_name AS object_name,
           CASE WHEN granted THEN true END AS can_select, checked_as FROM p1_permissions
    UNION ALL SELECT snapshot_id, schema_name, '{model.LABEL_VIEW}', name, CASE WHEN schema_name = 'MACHINERY' THEN true END,
           CASE WHEN schema_name = 'MACHINERY' THEN 'current_user' ELSE 'not_collected' END FROM p1_views""")
def privileges(spark, sf):
    return flatten.privileges(stored(spark, sf)).select(
        "snapshot_id", "schema_name", "object_type", "object_name", "can_select", "checked_as"
    )


@query("g7_flattened_objects", "p1_tables", "p1_views", "p1_routines", sql="""
    SELECT snapshot_id, 'table' AS kind, schema_name, table_name AS name FROM p1_tables
    UNION ALL SELECT snapshot_id, 'view', schema_name, name FROM p1_views
    UNION ALL SELECT snapshot_id, 'procedure', schema_name, name FROM p1_routines""")
def flattened_objects(spark, sf):
    return search.named_objects(stored(spark, sf)).select("snapshot_id", "kind", "schema_name", "name")


@query("e4_column_ordinal", "p1_columns", sql="""
    SELECT snapshot_id, schema_name, table_name, column_name,
           CAST(row_number() OVER (PARTITION BY snapshot_id, schema_name, table_name ORDER BY column_name) AS INT) AS ordinal FROM p1_columns""")
def column_ordinal(spark, sf):
    return flatten.column_details(stored(spark, sf)).select(*_TABLE, "column_name", "ordinal")


@query("h2_fingerprint", "p1_fingerprints", sql="SELECT snapshot_id, fingerprint FROM p1_fingerprints")
def fingerprints(spark, sf):
    """Fingerprint of every snapshot, from the stored digests of its objects."""
    return collect.fingerprints(stored(spark, sf))


@query("h2_schema_digests", "p1_values", sql="""
    SELECT snapshot_id, schema_name, count(*) AS objects, """ + ", ".join(
    f"CAST(sum(CAST('0x' || substr(sha256(CAST(to_json([kind, schema_name, value]) AS VARCHAR)), {k * 8 + 1}, 8) AS BIGINT)) AS BIGINT) AS w{k}" for k in range(8)) + """
    FROM p1_values GROUP BY snapshot_id, schema_name""")
def schema_digests(spark, sf):
    """Digest sums of every schema: those of its objects, and parts of those of its snapshot."""
    return collect.digest_tree(stored(spark, sf), "schema_name")


# --- searches ----------------------------------------------------------------------------------------------------
@query("b7_snapshot_objects", "p1_columns", sql="""
    SELECT snapshot_id, kind, schema_name, table_name, name FROM (
      SELECT snapshot_id, 'column' AS kind, schema_name, table_name, column_name AS name FROM p1_columns) WHERE schema_name = 'BUILDING'""")
def snapshot_objects(spark, sf):
    rows = search.snapshot_objects(flatten.objects(stored(spark, sf), kinds=("column",)), "BUILDING", "column")
    return rows.select("snapshot_id", "kind", "schema_name", "table_name", "name")


_FOUND = """
    , named AS (SELECT snapshot_id, 'table' AS kind, schema_name, table_name AS name FROM p1_tables
      UNION ALL SELECT snapshot_id, 'view', schema_name, name FROM p1_views
      UNION ALL SELECT snapshot_id, 'procedure', schema_name, name FROM p1_routines),
    found AS (SELECT * FROM named WHERE contains(lower(concat(schema_name, '.', name)), 'y.'))"""


@query("b12_search_objects", "p1_tables", "p1_views", "p1_routines", sql=_FOUND + " SELECT * FROM found")
def search_objects(spark, sf):
    rows = search.search_objects(search.named_objects(stored(spark, sf)), "  Y. ")
    return rows.select("snapshot_id", "kind", "schema_name", "name")


_SEARCHES = ("  Y. ", "ILDING.customer#0", "e.v_", "mer#000", "nothing of the kind", "")


@query("b12_indexed_search", "p1_tables", "p1_views", "p1_routines", sql=f"""
    , named AS (SELECT snapshot_id, 'table' AS kind, schema_name, table_name AS name FROM p1_tables
                UNION ALL SELECT snapshot_id, 'view', schema_name, name FROM p1_views
                UNION ALL SELECT snapshot_id, 'procedure', schema_name, name FROM p1_routines)
    SELECT query, snapshot_id, kind, schema_name, name
    FROM named, (SELECT unnest({list(_SEARCHES)!r}) AS query) WHERE contains(lower(concat(schema_name, '.', name)), lower(trim(query)))""")
def indexed_search(spark, sf):
    """Long, short, empty and vain queries over an index of all object names."""
    path = shared_folder(spark)
    names.write_name_index(search.named_objects(stored(spark, sf)), path)
    found = [names.search_index(spark, path, q).withColumn("query", F.lit(q)) for q in _SEARCHES]
    return reduce(DataFrame.unionByName, found).select("query", "snapshot_id", "kind", "schema_name", "name")


@query("d14_visible_counts", "p1_tables", "p1_views", "p1_routines", sql=_FOUND + """
    SELECT snapshot_id, count(*) FILTER (kind = 'table') AS table_count, count(*) FILTER (kind = 'view') AS view_count,
           count(*) FILTER (kind = 'procedure') AS procedure_count FROM found GROUP BY snapshot_id""")
def visible_counts(spark, sf):
    return search.visible_counts(search.search_objects(search.named_objects(stored(spark, sf)), "y."))


@query("h5_join_values", "p1_indexes", sql="""
    SELECT snapshot_id, schema_name, table_name, index_name,
           concat(first_column, CASE WHEN column_count > 1 THEN ', …' ELSE ', ' END) AS columns FROM p1_indexes""")
def joined_values(spark, sf):
    rows = flatten.index_details(stored(spark, sf))
    return rows.select(*_TABLE, "index_name", join_values(F.col("column_names")).alias("columns"))
