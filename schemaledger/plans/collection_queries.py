"""Queries over collection choices, attachments, assembly, the store, exports and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..operators import collect, flatten, imports, ledger, sheets
from ..session import shared_folder
from ..sources import catalogs, imports as import_files, sheets as sheet_sink, store
from ..streaming import ingest
from . import driver_tables as p1
from .registry import captured_on, landed_extracts, query, stored


# --- sources and sinks -------------------------------------------------------------------------------------------
@query("a3_key_columns_to_lists", "p1_columns", sql="""
    SELECT snapshot_id, schema_name, table_name, string_agg(column_name, ', ' ORDER BY column_name) AS key_columns
    FROM p1_columns GROUP BY snapshot_id, schema_name, table_name""")
def key_columns_to_lists(spark, sf):
    rows = p1.columns(spark, sf).select(
        "snapshot_id", "schema_name", "table_name", F.lit("PRIMARY KEY").alias("constraint_type"), F.lit("pk").alias("name"),
        F.substring("column_name", 1, 1).cast("int").alias("ordinal"), "column_name",
    )
    listed = catalogs.key_lists(rows, "PRIMARY KEY")
    return listed.select("snapshot_id", "schema_name", "table_name", F.array_join("constrained_columns", ", ").alias("key_columns"))


@query("a4_snapshot_append", "p1_tables", sql="""
    SELECT snapshot_id, data_source_id, captured_on, count(*) AS table_count FROM p1_tables GROUP BY ALL""")
def snapshot_append(spark, sf):
    """Every snapshot of the store appended to a new one in two commits, one of them sent again, and read back."""
    path, rows = shared_folder(spark), stored(spark, sf)
    early = F.year("captured_at") < 1996
    for name, part in (("early", rows.where(early)), ("late", rows.where(~early)), ("early", rows.where(early))):
        store.append_once(part, path, name)
    rows = flatten.table_history(store.read_committed(spark, path))
    return rows.groupBy("snapshot_id", "data_source_id", captured_on()).agg(F.count("*").alias("table_count"))


@query("a5_snapshot_scan", "p1_columns", "p1_sources", sql="""
    SELECT snapshot_id, any_value(name) AS source, count(*) AS column_count
    FROM p1_columns JOIN p1_sources ON id = data_source_id WHERE data_source_id = 7 GROUP BY snapshot_id""")
def snapshot_scan(spark, sf):
    """All snapshots of one source, objects included: only the folders of its bucket are read, once."""
    rows = store.snapshots_of_source(stored(spark, sf), 7)
    return rows.groupBy("snapshot_id").agg(F.max("source").alias("source"), F.sum(F.size("columns.name")).alias("column_count"))


@query("a6_import_files", "p1_incoming", sql="SELECT name, val FROM p1_incoming")
def import_files_read(spark, sf):
    """Import rows written as YAML list files of bounded size, then read back."""
    path = shared_folder(spark)
    rows = p1.incoming_rows(spark, sf).select("name", "val")
    lines = rows.select(F.concat(F.lit("- "), F.to_json(F.struct("name", "val"))).alias("value"))
    lines.write.option("maxRecordsPerFile", 20_000).text(path)
    items, _errors = import_files.read_import_files(spark, path, "connections")
    return import_files.fields(items, {"name": "string", "val": "double"}).select("name", "val")


@query("a7_export_sheets", "p1_columns", "p1_indexes", "p1_views", "p1_tables", sql="""
    SELECT 'TABLE' AS sheet, count(*) AS row_count FROM p1_tables
    UNION ALL SELECT 'COLUMN', count(*) FROM p1_columns UNION ALL SELECT 'INDEX', count(*) FROM p1_indexes
    UNION ALL SELECT 'VIEW', count(*) FROM p1_views""")
def export_sheets(spark, sf):
    """Selected sheets of all snapshots written out and counted from the files."""
    parts = stored(spark, sf)
    chosen = sheets.export_sheets(parts, collect.fingerprints(parts), {"TABLE", "COLUMN", "INDEX", "VIEW"})
    folders = sheet_sink.write_sheets(chosen, shared_folder(spark))
    counted = [
        spark.read.parquet(folder).select(F.lit(name).alias("sheet")) for name, folder in zip(chosen, folders)
    ]
    rows = counted[0]
    for more in counted[1:]:
        rows = rows.unionAll(more)
    return rows.groupBy("sheet").agg(F.count("*").alias("row_count"))


@query("a8_published_relations", "p1_columns", sql="""
    SELECT schema_name, data_type, count(*) AS column_count, count(DISTINCT snapshot_id) AS snapshot_count
    FROM p1_columns WHERE nullable GROUP BY schema_name, data_type""")
def published_relations(spark, sf):
    parts = stored(spark, sf)
    store.publish(parts, collect.fingerprints(parts))
    return spark.sql("""
        SELECT schema_name, data_type, count(*) AS column_count, count(DISTINCT snapshot_id) AS snapshot_count
        FROM integration_column_history WHERE nullable GROUP BY schema_name, data_type""")


@query("a9_snapshot_assembly", "p1_columns", sql="""
    SELECT snapshot_id, data_source_id, captured_on, schema_name, table_name, column_name, data_type, nullable FROM p1_columns""")
def snapshot_assembly(spark, sf):
    """Flat rows assembled into objects and flattened again: the same rows."""
    relations = landed_extracts(spark, sf)
    return flatten.column_history(collect.assemble(relations.pop("headers"), relations)).select(
        "snapshot_id", "data_source_id", captured_on(), "schema_name", "table_name", "column_name", "data_type", "nullable"
    )


@query("j1_incremental_ingest", "p1_growth", sql="""
    SELECT snapshot_id, schema_name, table_name, total_bytes, previous_total_bytes, growth_bytes, growth_percent
    FROM p1_growth""")
def incremental_ingest(spark, sf):
    """Extracts landed in three deliveries, the last one late and with repeated headers, and ingested by three stream runs."""
    base = shared_folder(spark)
    landing, store_folder, checkpoint = f"{base}/landing", f"{base}/store", f"{base}/checkpoint"
    relations = landed_extracts(spark, sf)
    year = F.year("captured_at")
    heads = relations.pop("headers").withColumn("delivery", F.when(year < 1996, 1).when(year >= 1998, 2).otherwise(3))
    for name, rows in relations.items():
        rows.join(heads.select("snapshot_id", "delivery"), "snapshot_id").write.partitionBy("delivery").parquet(f"{landing}/{name}")
    for delivery in (heads.where("delivery = 1"), heads.where("delivery = 2"), heads.where("delivery <> 2")):
        delivery.write.mode("append").parquet(f"{landing}/headers")
        ingest.ingest(spark, landing, store_folder, checkpoint).awaitTermination()
    rows = flatten.table_details(ingest.read_store(spark, store_folder))
    return rows.select(
        "snapshot_id", "schema_name", "table_name", "total_bytes", "previous_total_bytes", "growth_bytes", "growth_percent"
    )


# --- choices -----------------------------------------------------------------------------------------------------
def _available(spark, sf):
    key = F.col("id")
    name = (
        F.when(key % 6 == 0, "SYSIBM").when(key % 6 == 1, "Information_Schema").when(key % 6 == 2, "mysql")
        .otherwise(F.lower(F.col("c_mktsegment")))
    )
    c = p1.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    kinds = p1.connections(spark, sf).select("id", "db_type")
    return c.join(kinds, "id").select("id", "db_type", name.alias("schema_name"))


_AVAILABLE = """
    , available AS (SELECT id, db_type, CASE id % 6 WHEN 0 THEN 'SYSIBM' WHEN 1 THEN 'Information_Schema' WHEN 2 THEN 'mysql'
                                    ELSE lower(c_mktsegment) END AS schema_name FROM p1_connections)"""


@query("b1_usable_schemas", "p1_connections", sql=_AVAILABLE + """
    SELECT id, db_type, schema_name FROM available
    WHERE lower(schema_name) NOT IN ('information_schema', 'performance_schema', 'mysql', 'sys', 'pg_catalog')
      AND NOT (db_type = 'db2' AND starts_with(upper(schema_name), 'SYS'))""")
def usable_schemas(spark, sf):
    return _available(spark, sf).where(collect.is_usable_schema(F.col("schema_name"), F.col("db_type")))


@query("b2_chosen_schemas", "p1_connections", sql=_AVAILABLE + """
    SELECT DISTINCT data_source_id, unnest(names) AS schema_name FROM (
      SELECT id AS data_source_id,
             CASE WHEN id % 5 = 0 THEN ['chosen_b', 'chosen_a'] WHEN db_type = 'bigquery' AND id % 2 = 0 THEN ['dataset_1']
                  WHEN lower(schema_name) IN ('information_schema', 'mysql') OR (db_type = 'db2' AND starts_with(schema_name, 'SYS')) THEN []
                  ELSE [schema_name] END AS names FROM available)""")
def chosen_schemas(spark, sf):
    key = F.col("id")
    rows = _available(spark, sf).select(
        key.alias("data_source_id"), "db_type", "schema_name",
        F.when(key % 5 == 0, F.array(F.lit("chosen_b"), F.lit("chosen_a"))).alias("selected"),
        F.when(key % 2 == 0, "dataset_1").otherwise("").alias("dataset"),
    )
    return collect.chosen_schemas(rows)


@query("b3_collection_items", sql="""
    SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 2 THEN 'TABLE,VIEW' WHEN 3 THEN '' WHEN 4 THEN 'INDEX,SYNONYM'
             ELSE 'INDEX,PROCEDURE,SELECT PRIVILEGE,TABLE,VIEW' END AS items FROM customer""")
def collection_items(spark, sf):
    key = F.col("c_custkey")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    items = (
        F.when(key % 5 == 1, F.array().cast("array<string>")).when(key % 5 == 2, words("view", "Table"))
        .when(key % 5 == 3, words("foo")).when(key % 5 == 4, words("synonym", "foo", "INDEX"))
    )
    rows = p1.table(spark, sf, "customer").select(key.alias("id"), items.alias("items"))
    return rows.select("id", F.array_join(collect.chosen_items(F.col("items")), ",").alias("items"))


@query("b4_selected_relations", "p1_columns", "p1_indexes", "p1_views", sql="""
    SELECT 'columns' AS relation, snapshot_id, count(*) AS row_count FROM p1_columns
     WHERE (snapshot_id // 10000) % 3 <> 2 GROUP BY snapshot_id
    UNION ALL SELECT 'indexes', snapshot_id, count(*) FROM p1_indexes WHERE (snapshot_id // 10000) % 3 = 0 GROUP BY snapshot_id
    UNION ALL SELECT 'views', snapshot_id, count(*) FROM p1_views WHERE (snapshot_id // 10000) % 3 = 2 GROUP BY snapshot_id""")
def selected_relations(spark, sf):
    kind = F.col("data_source_id") % 3
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    items = F.when(kind == 0, words("INDEX", "TABLE")).when(kind == 1, words("TABLE")).otherwise(words("INDEX", "VIEW"))
    chosen = p1.snapshots(spark, sf).select(F.col("id").alias("snapshot_id"), items.alias("items"))
    given = {"columns": p1.columns(spark, sf), "indexes": p1.indexes(spark, sf), "views": p1.views(spark, sf)}
    kept = collect.selected_relations(given, chosen)
    rows = [r.groupBy(F.lit(n).alias("relation"), "snapshot_id").agg(F.count("*").alias("row_count")) for n, r in kept.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("b5_supported_kinds", "p1_connections", sql="""
    SELECT id, db_type, db_type <> 'access' AS supported,
           CASE WHEN db_type = 'access' THEN 'unsupported database kind: access' END AS reason FROM p1_connections""")
def supported_kinds(spark, sf):
    return collect.with_support(p1.connections(spark, sf).select("id", "db_type"), "docker")


@query("b6_runnable_jobs", "p1_jobs", "p1_sources", sql="""
    SELECT j.id, j.name, j.data_source_id, s.db_type FROM p1_jobs j JOIN p1_sources s ON s.id = j.data_source_id
    WHERE j.is_active AND (j.schedule_type = 'cron' OR (j.schedule_type = 'interval' AND j.interval_minutes > 0))""")
def runnable_jobs(spark, sf):
    rows = ledger.runnable_jobs(p1.jobs(spark, sf), p1.sources(spark, sf))
    return rows.select("id", "name", "data_source_id", "db_type")


@query("b15_bigquery_target", sql="""
    SELECT c_custkey AS id, regexp_full_match(project, '[a-z0-9][a-z0-9-]{4,61}[a-z0-9]')
             AND regexp_full_match(lower(coalesce(region, 'US')), '[a-z0-9-]+') AS valid
    FROM (SELECT c_custkey, concat(CASE c_custkey % 3 WHEN 0 THEN 'project-' WHEN 1 THEN 'P' ELSE '' END, CAST(c_custkey AS VARCHAR)) AS project,
                 CASE c_custkey % 4 WHEN 0 THEN 'EU' WHEN 1 THEN 'us_east' WHEN 2 THEN 'us-east1' END AS region FROM customer)""")
def bigquery_target(spark, sf):
    key = F.col("c_custkey")
    project = F.concat(F.when(key % 3 == 0, "project-").when(key % 3 == 1, "P").otherwise(""), key.cast("string"))
    region = F.when(key % 4 == 0, "EU").when(key % 4 == 1, "us_east").when(key % 4 == 2, "us-east1")
    rows = p1.table(spark, sf, "customer")
    return rows.select(key.alias("id"), imports.is_bigquery_target(project, region).alias("valid"))


@query("b16_service_account", sql="""
    SELECT c_custkey AS id, c_custkey % 5 = 0 AS valid FROM customer""")
def service_account(spark, sf):
    key = F.col("c_custkey")
    text = (
        F.when(key % 5 == 0, F.to_json(F.struct(key.cast("string").alias("project_id"), F.lit("k").alias("private_key"))))
        .when(key % 5 == 1, '{"project_id": "p"}').when(key % 5 == 2, '{"project_id": "", "private_key": "k"}')
        .when(key % 5 == 3, '["project_id", "private_key"]').otherwise("{not json")
    )
    rows = p1.table(spark, sf, "customer")
    return rows.select(key.alias("id"), imports.has_service_account(text).alias("valid"))


# --- attachments -------------------------------------------------------------------------------------------------
@query("c1_attach_grants", "p1_permissions", sql="""
    SELECT snapshot_id, schema_name, table_name, CASE WHEN granted THEN true END AS can_select,
           CASE WHEN granted THEN 'SELECT' ELSE '' END AS privileges, checked_as FROM p1_permissions""")
def attach_grants(spark, sf):
    rows = p1.tables(spark, sf).select("snapshot_id", "schema_name", "table_name")
    held = collect.attach_grants(rows, p1.grants(spark, sf))
    return held.select(
        "snapshot_id", "schema_name", "table_name", F.col("permissions.select").alias("can_select"),
        F.array_join("permissions.privileges", ",").alias("privileges"), F.col("permissions.checked_as").alias("checked_as"),
    )


@query("c2_attach_storage", "p1_tables", sql="""
    SELECT snapshot_id, schema_name, table_name, CASE WHEN column_count > 1 THEN data_bytes ELSE 0 END AS data_bytes,
           CASE WHEN column_count > 1 THEN index_bytes ELSE 0 END AS index_bytes,
           CASE WHEN column_count > 1 THEN total_bytes ELSE 0 END AS total_bytes, row_estimate FROM p1_tables""")
def attach_storage(spark, sf):
    rows = p1.tables(spark, sf)
    return collect.attach_storage(rows.select(*model.TABLE_KEY), rows.where("column_count > 1"))


@query("c14_primary_key_columns", "p1_columns", sql="""
    SELECT snapshot_id, schema_name, table_name, column_name,
           count(*) OVER w > 1 AND column_name = min(column_name) OVER w AS is_primary_key
    FROM p1_columns WINDOW w AS (PARTITION BY snapshot_id, schema_name, table_name)""")
def primary_key_columns(spark, sf):
    rows = p1.columns(spark, sf).select(*model.TABLE_KEY, "column_name")
    return collect.primary_key_flags(rows, p1.primary_keys(spark, sf))


@query("k6_error_isolation", "p1_tables", "p1_connections", sql=f"""
    SELECT * FROM (
      SELECT DISTINCT snapshot_id AS id, schema_name AS name, '{model.SKIPPED_REASON}' AS reason
      FROM p1_tables t WHERE NOT EXISTS (SELECT 1 FROM p1_tables u WHERE u.snapshot_id = t.snapshot_id
                                           AND u.schema_name = t.schema_name AND u.column_count > 2)
      UNION ALL SELECT id, name, 'unsupported database kind: access' FROM p1_connections WHERE db_type = 'access')""")
def error_isolation(spark, sf):
    """Unreadable schemas and rejected rows as reason rows; everything else goes on."""
    rows = p1.tables(spark, sf)
    readable = rows.where("column_count > 2").select("snapshot_id", "schema_name").distinct()
    skipped = ledger.skipped_schemas(rows.select("snapshot_id", "schema_name").distinct(), readable)
    marked = collect.with_support(p1.connections(spark, sf).select("id", "name", "db_type"))
    _kept, rejected = ledger.isolated(marked, F.col("reason"))
    return skipped.select(F.col("snapshot_id").alias("id"), F.col("schema_name").alias("name"), "reason").unionByName(
        rejected.select("id", "name", "reason")
    )
