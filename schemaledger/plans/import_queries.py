"""Queries over validation and bulk import."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imports, search
from . import driver_tables as p1
from .registry import query


def _source_rows(spark, sf):
    """Connections as import rows: some names too short, some authentication types unknown."""
    key = F.col("id")
    rows = p1.connections(spark, sf)
    return rows.withColumns({
        "row_no": key + 1,
        "name": F.when(key % 10 == 0, "x").when(key % 10 == 1, F.repeat(F.lit("n"), F.lit(121))).otherwise(F.col("name")),
        "ssh_auth_type": F.when(key % 4 == 0, "password").when(key % 4 == 1, "agent"),
    })


_SOURCE_ROWS = """
    , rows AS (SELECT *, id + 1 AS row_no, id % 10 < 2 AS bad_name, db_type = 'access' AS bad_kind, id % 4 = 1 AS bad_auth FROM p1_connections)"""


@query("b13_source_row_errors", "p1_connections", sql=_SOURCE_ROWS + """
    SELECT row_no, array_to_string(list_filter([CASE WHEN bad_name THEN 'name: 2 to 120 characters' END,
        CASE WHEN bad_kind THEN 'db_type: unknown kind' END, CASE WHEN bad_auth THEN 'ssh_auth_type: unknown type' END],
        lambda x: x IS NOT NULL), '; ') AS error
    FROM rows WHERE bad_name OR bad_kind OR bad_auth""")
def source_row_errors(spark, sf):
    _valid, rejected = imports.split_valid(imports.with_source_errors(_source_rows(spark, sf)))
    return rejected.select("row_no", "error")


@query("d11_preview_counts", "p1_connections", sql=_SOURCE_ROWS + """
    SELECT count(*) AS total, count(*) FILTER (NOT (bad_name OR bad_kind OR bad_auth)) AS valid FROM rows""")
def preview_counts(spark, sf):
    return imports.preview_counts(imports.with_source_errors(_source_rows(spark, sf)))


@query("b10_redacted_preview", "p1_connections", sql="""
    SELECT name, db_type, host, port, "database", username, ssh_enabled OR ssh_nested_enabled AS ssh_enabled FROM p1_connections""")
def redacted_preview(spark, sf):
    return imports.source_preview(p1.connections(spark, sf))


@query("b10_redacted_fields", "p1_connections", sql="""
    SELECT id, CASE WHEN password <> '' THEN '[REDACTED]' ELSE password END AS password,
           CASE WHEN ssh_private_key <> '' THEN '[REDACTED]' ELSE ssh_private_key END AS ssh_private_key FROM p1_connections""")
def redacted_fields(spark, sf):
    return imports.redacted(p1.connections(spark, sf)).select("id", "password", "ssh_private_key")


@query("b11_search_sources", "p1_connections", sql="""
    SELECT id FROM p1_connections WHERE contains(lower(concat(name, ' ', coalesce(host, ''), ' ', "database")), 'example db_1')""")
def search_sources(spark, sf):
    return search.search_sources(p1.connections(spark, sf), "Example DB_1").select("id")


def _job_rows(spark, sf):
    key = F.col("id")
    return p1.jobs(spark, sf).withColumns({
        "schedule_type": F.when(key % 11 == 0, "hourly").when(key % 11 == 1, None).otherwise(F.col("schedule_type")),
        "interval_minutes": F.when(key % 5 == 0, F.lit(0)).otherwise(F.col("interval_minutes")),
    })


@query("b14_job_row_errors", "p1_jobs", "p1_sources", sql="""
    SELECT id, array_to_string(list_filter([CASE WHEN id % 11 = 0 THEN 'schedule_type: unknown type' END,
        CASE WHEN id % 5 = 0 THEN 'interval_minutes: at least 1' END,
        CASE WHEN data_source_id NOT IN (SELECT id FROM p1_sources) THEN 'data_source_id: unknown source' END],
        lambda x: x IS NOT NULL), '; ') AS errors FROM p1_jobs""")
def job_row_errors(spark, sf):
    rows = imports.with_job_errors(_job_rows(spark, sf), p1.sources(spark, sf))
    return rows.select("id", F.array_join("errors", "; ").alias("errors"))


@query("c7_job_source_names", "p1_jobs", "p1_sources", sql="""
    SELECT j.id, coalesce(s.name, concat('#', CAST(j.data_source_id AS VARCHAR))) AS source_name
    FROM p1_jobs j LEFT JOIN p1_sources s ON s.id = j.data_source_id""")
def job_source_names(spark, sf):
    return imports.with_source_names(p1.jobs(spark, sf), p1.sources(spark, sf)).select("id", "source_name")


@query("c8_run_job_names", "p1_runs", "p1_jobs", sql="""
    SELECT r.id, coalesce(j.name, concat('작업 #', CAST(r.job_id AS VARCHAR))) AS job_name
    FROM p1_runs r LEFT JOIN (SELECT * FROM p1_jobs WHERE is_active) j ON j.id = r.job_id""")
def run_job_names(spark, sf):
    return imports.with_job_names(p1.runs(spark, sf), p1.jobs(spark, sf).where("is_active")).select("id", "job_name")


@query("c9_resolved_sources", "p1_jobs", "p1_sources", sql="""
    , rows AS (SELECT id, CASE WHEN id % 2 = 0 THEN data_source_id WHEN id % 4 = 1 THEN 0 END AS given,
                      CASE WHEN id % 3 <> 0 THEN concat('NATION_', CAST(id % 30 AS VARCHAR)) END AS ref FROM p1_jobs)
    SELECT r.id, coalesce(nullif(given, 0), s.id) AS data_source_id,
           CASE WHEN coalesce(given, 0) = 0 AND ref IS NOT NULL AND s.id IS NULL THEN concat('unknown data source: ', ref) END AS error
    FROM rows r LEFT JOIN p1_sources s ON s.name = r.ref""")
def resolved_sources(spark, sf):
    key = F.col("id")
    rows = p1.jobs(spark, sf).select(
        "id", F.when(key % 2 == 0, F.col("data_source_id")).when(key % 4 == 1, F.lit(0).cast("bigint")).alias("data_source_id"),
        F.when(key % 3 != 0, F.concat(F.lit("NATION_"), (key % 30).cast("string"))).alias("data_source"),
    )
    return imports.resolved_sources(rows, p1.sources(spark, sf)).select("id", "data_source_id", "error")


@query("c12_existing_names", "p1_incoming", "p1_stored", sql="""
    SELECT row_no, name FROM p1_incoming WHERE name IN (SELECT name FROM p1_stored)""")
def existing_names(spark, sf):
    return imports.existing_rows(p1.incoming_rows(spark, sf), p1.stored_names(spark, sf)).select("row_no", "name")


# --- imports -----------------------------------------------------------------------------------------------------
_RANKED = """
    , ranked AS (SELECT i.row_no, i.name, i.val, s.name IS NOT NULL AS stored,
                        row_number() OVER (PARTITION BY i.name ORDER BY row_no) AS k,
                        row_number() OVER (PARTITION BY i.name ORDER BY row_no DESC) AS back,
                        concat(i.name, ' (2)') IN (SELECT name FROM p1_stored) AS two_taken
                 FROM p1_incoming i LEFT JOIN p1_stored s ON s.name = i.name),
    renamed AS (SELECT *, CASE WHEN k = 1 AND NOT stored THEN name
                  ELSE concat(name, ' (', CAST(k - CASE WHEN stored THEN 0 ELSE 1 END + 1 + CASE WHEN two_taken THEN 1 ELSE 0 END AS VARCHAR), ')') END AS final_name
                FROM ranked)"""


def _tables(spark, sf):
    return p1.incoming_rows(spark, sf), p1.stored_names(spark, sf)


@query("e7_free_names", "p1_incoming", "p1_stored", sql=_RANKED + " SELECT row_no, name, final_name FROM renamed")
def free_names(spark, sf):
    return imports.renamed(*_tables(spark, sf))


@query("k1_import_skip", "p1_incoming", "p1_stored", sql=_RANKED + """
    SELECT row_no, name, CASE WHEN k = 1 AND NOT stored THEN 'created' ELSE 'skipped' END AS action FROM ranked""")
def import_skip(spark, sf):
    return imports.import_actions(*_tables(spark, sf), "skip").drop("final_name")


@query("k1_import_overwrite", "p1_incoming", "p1_stored", sql=_RANKED + """
    SELECT row_no, name, CASE WHEN k = 1 AND NOT stored THEN 'created' ELSE 'updated' END AS action FROM ranked""")
def import_overwrite(spark, sf):
    return imports.import_actions(*_tables(spark, sf), "overwrite").drop("final_name")


@query("k1_table_after_skip", "p1_incoming", "p1_stored", sql=_RANKED + """
    SELECT name, val FROM p1_stored UNION ALL SELECT name, val FROM ranked WHERE k = 1 AND NOT stored""")
def table_after_skip(spark, sf):
    return imports.imported(*_tables(spark, sf), "skip")


@query("k1_table_after_overwrite", "p1_incoming", "p1_stored", sql=_RANKED + """
    SELECT name, val FROM p1_stored WHERE name NOT IN (SELECT name FROM p1_incoming) UNION ALL SELECT name, val FROM ranked WHERE back = 1""")
def table_after_overwrite(spark, sf):
    return imports.imported(*_tables(spark, sf), "overwrite")


@query("k1_table_after_rename", "p1_incoming", "p1_stored", sql=_RANKED + """
    SELECT name, val FROM p1_stored UNION ALL SELECT final_name, val FROM renamed""")
def table_after_rename(spark, sf):
    return imports.imported(*_tables(spark, sf), "rename")


@query("d11_import_counts", "p1_incoming", "p1_stored", "p1_connections", sql=_RANKED + """
    SELECT count(*) FILTER (k = 1 AND NOT stored) AS created, CAST(0 AS BIGINT) AS updated,
           count(*) FILTER (k > 1 OR stored) AS skipped, (SELECT count(*) FROM p1_connections WHERE db_type = 'access') AS errors FROM ranked""")
def import_counts(spark, sf):
    actions = imports.import_actions(*_tables(spark, sf), "skip")
    return imports.import_counts(actions, p1.connections(spark, sf).where("db_type = 'access'"))


@query("e6_import_row_number", "p1_incoming", sql="""
    SELECT name, val, row_number() OVER (ORDER BY row_no) AS row_no FROM p1_incoming""")
def import_row_number(spark, sf):
    """Row numbers from 1 over all import rows, in blocks: no single task sorts the file."""
    from ..operators.ordering import number_block, numbered

    rows = p1.incoming_rows(spark, sf).withColumn("file", F.lit("import"))
    counted = numbered(rows, ["file"], [F.col("row_no")], number_block("row_no", 1000), "position")
    return counted.select("name", "val", F.col("position").alias("row_no"))


@query("k2_upsert", "p1_connections", sql="""
    SELECT id, name, CASE WHEN id % 3 = 0 THEN 'failed' ELSE status END AS status FROM p1_connections
    UNION ALL SELECT id + 1000000000, name, 'failed' FROM p1_connections WHERE id % 10 = 0""")
def upsert(spark, sf):
    rows = p1.connections(spark, sf).select("id", "name", "status")
    changed = rows.where("id % 3 = 0").withColumn("status", F.lit("failed"))
    added = rows.where("id % 10 = 0").withColumns({"id": F.col("id") + 1_000_000_000, "status": F.lit("failed")})
    return imports.upserted(rows, changed.unionByName(added))


@query("k3_secret_preserving_update", "p1_connections", sql="""
    SELECT id, host, port, username, ssh_enabled, password, ssl_ca_cert, ssh_private_key FROM p1_connections WHERE id % 2 = 1
    UNION ALL
    SELECT id, CASE WHEN db_type = 'bigquery' THEN '' ELSE 'new.example' END, CASE WHEN db_type <> 'bigquery' THEN port END,
           CASE WHEN db_type = 'bigquery' THEN '' ELSE username END, CASE WHEN db_type = 'bigquery' THEN false ELSE ssh_enabled END,
           CASE WHEN id % 4 = 0 THEN 'new' ELSE password END, CASE WHEN id % 6 = 0 THEN CASE WHEN id % 10 = 0 THEN 'newca' ELSE ssl_ca_cert END END,
           CASE WHEN id % 4 = 2 THEN 'newkey' ELSE ssh_private_key END FROM p1_connections WHERE id % 2 = 0""")
def secret_preserving_update(spark, sf):
    key = F.col("id")
    stored = p1.connections(spark, sf).drop("ssh_nested_enabled", "val", "status", "name")
    changes = stored.where(key % 2 == 0).withColumns({
        "host": F.lit("new.example"), "password": F.when(key % 4 == 0, "new"), "ssl_enabled": key % 6 == 0,
        "ssl_ca_cert": F.when(key % 10 == 0, "newca").otherwise(""), "ssh_private_key": F.when(key % 4 == 2, "newkey"),
    })
    return imports.updated_sources(stored, changes).select(
        "id", "host", "port", "username", "ssh_enabled", "password", "ssl_ca_cert", "ssh_private_key"
    )
