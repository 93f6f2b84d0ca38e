"""Queries over runs, logs, listings, cascades and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import model
from ..operators import ledger
from . import driver_tables as p1
from .registry import query


@query("b9_public_sources", "p1_connections", sql='SELECT id, name, db_type, "database", status FROM p1_connections')
def public_sources(spark, sf):
    return ledger.public_sources(p1.connections(spark, sf))


@query("d5_dashboard", "p1_connections", "p1_jobs", "p1_runs", sql="""
    SELECT (SELECT count(*) FROM p1_connections) AS sources, (SELECT count(*) FROM p1_jobs WHERE is_active) AS active_jobs,
           (SELECT CAST(coalesce(sum(object_count), 0) AS BIGINT) FROM p1_runs WHERE status = 'success') AS objects,
           (SELECT count(*) FROM p1_runs WHERE status = 'failed') AS failed_runs""")
def dashboard(spark, sf):
    return ledger.dashboard(p1.connections(spark, sf), p1.jobs(spark, sf), p1.runs(spark, sf))


@query("f1_newest_runs", "p1_runs", sql="SELECT id, job_id, status FROM p1_runs ORDER BY started_at DESC, id DESC LIMIT 8")
def dashboard_runs(spark, sf):
    return ledger.newest_runs(p1.runs(spark, sf), model.RUN_DASHBOARD_LIMIT).select("id", "job_id", "status")


@query("f2_newest_runs", "p1_runs", sql="SELECT id, job_id, status, object_count FROM p1_runs ORDER BY started_at DESC, id DESC LIMIT 100")
def newest_runs(spark, sf):
    return ledger.newest_runs(p1.runs(spark, sf), model.RUN_LIST_LIMIT).select("id", "job_id", "status", "object_count")


@query("f4_listing_order", "p1_connections", sql="SELECT id, name FROM p1_connections")
def listing_order(spark, sf):
    return ledger.listed(p1.connections(spark, sf).select("id", "name"), "name")


_PLACE = "CAST(row_number() OVER (ORDER BY {}, id) AS BIGINT) AS position"


@query("f4_listing_positions", "p1_connections", "p1_role_permissions", "p1_role_menus", sql=f"""
    , jobs AS (SELECT user_id AS id, min(ts) AS created_at FROM events GROUP BY user_id),
    users AS (SELECT c_custkey AS id, concat(c_mktsegment, '@', lower(c_name)) AS email FROM customer),
    codes AS (SELECT DISTINCT code AS id FROM p1_role_permissions),
    menus AS (SELECT DISTINCT menu_code AS id, (CAST(right(menu_code, 1) AS INT) * 7) % 10 AS place FROM p1_role_menus)
    SELECT 'source' AS listing, CAST(id AS VARCHAR) AS id, {_PLACE.format("name")} FROM p1_connections
    UNION ALL SELECT 'job', CAST(id AS VARCHAR), {_PLACE.format("created_at DESC")} FROM jobs
    UNION ALL SELECT 'user', CAST(id AS VARCHAR), {_PLACE.format("email")} FROM users
    UNION ALL SELECT 'permission', id, {_PLACE.format("id")} FROM codes
    UNION ALL SELECT 'menu', id, {_PLACE.format("place")} FROM menus""")
def listing_positions(spark, sf):
    """The five listings with the place of each row: sources, jobs (newest first), users, permissions, menus."""
    place = F.substring("menu_code", -1, 1).cast("int") * 7 % 10
    listings = {
        "source": (p1.connections(spark, sf).select("id", "name"), "name", False),
        "job": (p1.logs(spark, sf).groupBy(F.col("run_id").alias("id")).agg(F.min("created_at").alias("created_at")), "created_at", True),
        "user": (p1.table(spark, sf, "customer").select(
            F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.lit("@"), F.lower("c_name")).alias("email")), "email", False),
        "permission": (p1.role_permissions(spark, sf).select(F.col("code").alias("id")).distinct(), "id", False),
        "menu": (p1.role_menus(spark, sf).select(F.col("menu_code").alias("id"), place.alias("place")).distinct(), "place", False),
    }
    found = [
        ledger.positions(rows, order, descending).select(F.lit(name).alias("listing"), F.col("id").cast("string").alias("id"), F.col("position").cast("bigint").alias("position"))
        for name, (rows, order, descending) in listings.items()
    ]
    return reduce(DataFrame.unionByName, found)


_LOGS = """
    , logs AS (SELECT event_id AS id, user_id AS run_id, ts, event_type AS step, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
                      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events)"""
_LOGS = _LOGS.replace(", logs AS", "WITH logs AS", 1)


@query("e5_log_sequence", sql=_LOGS + " SELECT run_id, id, sequence FROM logs")
def log_sequence(spark, sf):
    return ledger.numbered_logs(p1.logs(spark, sf)).select("run_id", "id", "sequence")


@query("f5_logs_of_run", sql=_LOGS + " SELECT sequence, level, step FROM logs WHERE run_id = 7")
def logs_of_run(spark, sf):
    rows = ledger.numbered_logs(p1.logs(spark, sf).where("run_id = 7"))
    return ledger.logs_of_run(rows, 7).select("sequence", "level", "step")


@query("f6_first_active_user", sql="SELECT min(c_custkey) AS id FROM customer WHERE c_custkey % 7 = 3")
def first_active_user(spark, sf):
    key = F.col("c_custkey")
    users = p1.table(spark, sf, "customer").select(key.alias("id"), (key % 7 == 3).alias("is_active"))
    return ledger.first_active(users).select("id")


def _registry_tables(spark, sf):
    logs = p1.logs(spark, sf).withColumn("run_id", F.col("id"))
    return {
        "sources": p1.sources(spark, sf), "jobs": p1.jobs(spark, sf), "runs": p1.runs(spark, sf), "run_logs": logs,
        "snapshots": p1.snapshots(spark, sf),
    }


@query("c13_delete_cascade", "p1_sources", "p1_jobs", "p1_runs", "p1_snapshots", sql="""
    , kept AS (SELECT * FROM p1_jobs WHERE NOT (data_source_id < 25 AND data_source_id % 5 = 2)),
    runs AS (SELECT * FROM p1_runs WHERE job_id IN (SELECT id FROM kept))
    SELECT 'sources' AS relation, count(*) AS row_count FROM p1_sources WHERE id % 5 <> 2
    UNION ALL SELECT 'jobs', count(*) FROM kept UNION ALL SELECT 'runs', count(*) FROM runs
    UNION ALL SELECT 'run_logs', count(*) FROM runs UNION ALL SELECT 'snapshots', count(*) FROM p1_snapshots WHERE data_source_id % 5 <> 2""")
def delete_cascade(spark, sf):
    gone = p1.sources(spark, sf).where("id % 5 = 2")
    left = ledger.cascaded(_registry_tables(spark, sf), gone)
    rows = None
    for name, table in left.items():
        count = table.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("relation"), "row_count")
        rows = count if rows is None else rows.unionAll(count)
    return rows


def _attempts(spark, sf):
    """Events as collection attempts; errors stop at one of the steps."""
    key = F.col("event_id")
    failed = F.col("event_type") == "error"
    steps = F.array(*[F.lit(s) for s in ("connect", "collect_schema", "save_snapshot")])
    return p1.table(spark, sf, "events").select(
        key.alias("run_id"), F.col("user_id").alias("job_id"), F.col("ts").alias("started_at"), F.col("ts").alias("finished_at"),
        F.floor("value").cast("bigint").alias("object_count"), F.when(failed, F.repeat(F.col("props"), F.lit(500))).alias("error"),
        F.when(failed, F.element_at(steps, (key % 3 + 1).cast("int"))).otherwise("complete").alias("step"),
        (key % 2 == 0).alias("collect_storage"),
    )


@query("k5_run_ledger", sql="""
    SELECT event_id AS id, user_id AS job_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
           CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS object_count,
           CASE WHEN event_type = 'error' THEN repeat(props, 500) END AS error_message,
           CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'connect' WHEN 1 THEN 'collect_schema' ELSE 'save_snapshot' END END AS failed_step,
           true AS finished FROM events""")
def run_ledger(spark, sf):
    rows = ledger.run_ledger(_attempts(spark, sf))
    return rows.select(
        "id", "job_id", "status", "object_count", "error_message", "failed_step", F.col("finished_at").isNotNull().alias("finished")
    )


@query("k5_run_steps", sql="""
    WITH steps AS (SELECT event_id, event_type = 'error' AS failed,
        CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 2 = 0 THEN 5 ELSE 4 END
             ELSE CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE CASE WHEN event_id % 2 = 0 THEN 4 ELSE 3 END END END AS n FROM events)
    SELECT event_id AS run_id, CAST(n + CASE WHEN failed THEN 1 ELSE 0 END AS BIGINT) AS line_count,
           CASE WHEN failed THEN 'error' ELSE 'info' END AS last_level FROM steps""")
def run_steps(spark, sf):
    lines = ledger.run_steps(_attempts(spark, sf))
    return lines.groupBy("run_id").agg(F.max("sequence").alias("line_count"), F.max_by("level", "sequence").alias("last_level"))


@query("k5_run_step_lines", sql="""
    WITH steps AS (SELECT event_id AS run_id, event_type = 'error' AS failed, md5(repeat(props, 500)) AS error,
        CASE WHEN event_id % 2 = 0 THEN ['connect', 'collect_schema', 'storage_growth', 'save_snapshot', 'complete']
             ELSE ['connect', 'collect_schema', 'save_snapshot', 'complete'] END AS wanted,
        CASE event_id % 3 WHEN 0 THEN 'connect' WHEN 1 THEN 'collect_schema' ELSE 'save_snapshot' END AS stopped FROM events),
    numbered AS (SELECT *, unnest(range(1, CASE WHEN failed THEN list_position(wanted, stopped) ELSE len(wanted) END + 1)) AS i FROM steps)
    SELECT run_id, CAST(i AS BIGINT) AS sequence, 'info' AS level, wanted[i] AS step, NULL AS details FROM numbered
    UNION ALL SELECT run_id, CAST(list_position(wanted, stopped) + 1 AS BIGINT), 'error', stopped, error FROM steps WHERE failed""")
def run_step_lines(spark, sf):
    """Every log line of every run: its place, level, step, and the digest of its details."""
    lines = ledger.run_steps(_attempts(spark, sf))
    return lines.select("run_id", "sequence", "level", "step", F.md5(F.col("details").cast("binary")).alias("details"))


@query("k4_schema_evolution", sql="""
    SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'TABLE,INDEX,PROCEDURE,VIEW,SELECT PRIVILEGE' WHEN 1 THEN 'TABLE' ELSE NULL END AS collection_items,
           false AS collect_storage FROM customer""")
def schema_evolution(spark, sf):
    key = F.col("c_custkey")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    items = F.when(key % 3 == 0, words("TABLE", "INDEX", "PROCEDURE", "VIEW")).when(key % 3 == 1, words("TABLE"))
    rows = p1.table(spark, sf, "customer").select(key.alias("id"), items.alias("collection_items"))
    done = ledger.evolved_jobs(rows)
    return done.select("id", F.array_join("collection_items", ",").alias("collection_items"), "collect_storage")


@query("k7_key_conflicts", sql="""
    SELECT "key", CASE WHEN stored THEN 'stored' ELSE 'repeated' END AS reason FROM (
      SELECT o_custkey AS "key", count(*) AS n, o_custkey % 3 = 0 AND o_custkey < (SELECT count(*) FROM customer) AS stored
      FROM orders GROUP BY o_custkey) WHERE stored OR n > 1""")
def key_conflicts(spark, sf):
    rows = p1.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    held = p1.table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"))
    return ledger.key_conflicts(rows, held, "key")


@query("k8_protected_deletes", sql=f"""
    SELECT 'left' AS outcome, c_custkey AS id, CAST(NULL AS VARCHAR) AS reason FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey % 8 = 0
    UNION ALL SELECT 'refused', c_custkey, 'own account' FROM customer WHERE c_custkey % 8 = 0""")
def protected_deletes(spark, sf):
    """Every fourth user is to be deleted; half of those asked for it themselves."""
    key = F.col("c_custkey")
    users = p1.table(spark, sf, "customer").select(key.alias("id"))
    requests = p1.table(spark, sf, "customer").where(key % 4 == 0).select(
        key.alias("id"), F.when(key % 8 == 0, key).otherwise(key + 1).alias("requested_by")
    )
    allowed, refused = ledger.user_deletes(requests)
    left = ledger.deleted(users, allowed).select(F.lit("left").alias("outcome"), "id", F.lit(None).cast("string").alias("reason"))
    return left.unionByName(refused.select(F.lit("refused").alias("outcome"), "id", "reason"))


@query("k8_protected_roles", sql=f"""
    SELECT c_custkey AS id, c_custkey % 50 = 0 AS refused FROM customer""")
def protected_roles(spark, sf):
    key = F.col("c_custkey")
    requests = p1.table(spark, sf, "customer").select(
        key.alias("id"), F.when(key % 50 == 0, model.SYSTEM_ROLE).otherwise(F.col("c_name")).alias("name")
    )
    allowed, refused = ledger.role_deletes(requests)
    flag = lambda rows, value: rows.select("id", F.lit(value).alias("refused"))
    return flag(allowed, False).unionByName(flag(refused, True))
