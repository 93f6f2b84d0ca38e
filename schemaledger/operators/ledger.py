"""Run ledger, run logs, listings, cascades and other table-level writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import model
from ..functions.text import truncated
from ..functions.values import same_items
from .collect import is_supported
from .ordering import numbered, numbered_by_range, time_block


# --- runs and logs -----------------------------------------------------------------------------------------------
def run_ledger(attempts: DataFrame, error_chars: int | None = None) -> DataFrame:
    """Attempts -> finished runs.

    ``attempts``: run_id, job_id, started_at, finished_at, object_count, error, step (the step reached). A run with an
    error is failed and counts no objects; every run has a finish time.
    """
    failed = F.col("error").isNotNull()
    return attempts.select(
        F.col("run_id").alias("id"), "job_id", F.when(failed, "failed").otherwise("success").alias("status"),
        "started_at", F.coalesce("finished_at", F.current_timestamp().cast("timestamp_ntz")).alias("finished_at"),
        F.when(failed, F.lit(0)).otherwise(F.col("object_count")).cast("bigint").alias("object_count"),
        truncated(F.col("error"), error_chars).alias("error_message"),
        F.when(failed, F.col("step")).alias("failed_step"),
    )


RUN_STEPS = ("connect", "collect_schema", "storage_growth", "save_snapshot", "complete")


def run_steps(attempts: DataFrame, error_chars: int | None = None) -> DataFrame:
    """One log line per step a run went through, numbered from 1; a failed run ends with an error line."""
    steps = F.array(*[F.lit(s) for s in RUN_STEPS])
    failed = F.col("error").isNotNull()
    wanted = F.filter(steps, lambda s: (s != "storage_growth") | F.col("collect_storage"))
    reached = F.array_position(wanted, F.col("step")).cast("int")
    passed = F.when(failed, F.slice(wanted, F.lit(1), reached)).otherwise(wanted)
    lines = F.concat(
        F.transform(passed, lambda s: F.struct(F.lit("info").alias("level"), s.alias("step"), F.lit(None).cast("string").alias("details"))),
        F.when(
            failed,
            F.array(F.struct(F.lit("error").alias("level"), F.col("step").alias("step"),
                             truncated(F.col("error"), error_chars).alias("details"))),
        ).otherwise(F.array().cast("array<struct<level:string,step:string,details:string>>")),
    )
    return attempts.select("run_id", F.posexplode(lines).alias("_pos", "_line")).select(
        "run_id", (F.col("_pos") + 1).cast("bigint").alias("sequence"), "_line.*"
    )


def numbered_logs(logs: DataFrame) -> DataFrame:
    """Add `sequence`: the line number within its run, by time and id. Blocks are minutes of one run."""
    return numbered(logs, ["run_id"], [F.col("created_at"), F.col("id")], time_block("created_at", "minute"), "sequence")


def logs_of_run(logs: DataFrame, run_id: int) -> DataFrame:
    return logs.where(F.col("run_id") == run_id).orderBy("sequence", "created_at", "id")


def newest_runs(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest runs first, ties by id: one top-N pass if a limit is given, else all."""
    ordered = runs.orderBy(F.col("started_at").desc(), F.col("id").desc())
    return ordered if limit is None else ordered.limit(limit)


def listed(rows: DataFrame, order: str, descending: bool = False, key: str = "id") -> DataFrame:
    """A listing in its fixed order, ties by key."""
    first = F.col(order).desc() if descending else F.col(order).asc()
    return rows.orderBy(first, F.col(key))


def positions(rows: DataFrame, order: str, descending: bool = False, key: str = "id") -> DataFrame:
    """Add `position`: the place of a row in its `listed` order, from 1. No task sees the whole listing."""
    first = F.col(order).desc() if descending else F.col(order).asc()
    return numbered_by_range(rows, [], [first, F.col(key)], "position")


def first_active(users: DataFrame) -> DataFrame:
    """The active user with the lowest id."""
    return users.where("is_active").orderBy("id").limit(1)


def dashboard(sources: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Source, active job, collected object and failed run counts in one row.

    Each table gives one partial row; the rows are added up, so no join is involved.
    """
    zero = F.lit(0).cast("bigint")
    partial = [
        sources.agg(F.count("*").alias("sources")),
        jobs.agg(F.count_if("is_active").alias("active_jobs")),
        runs.agg(
            F.sum(F.when(F.col("status") == "success", F.col("object_count"))).alias("objects"),
            F.count_if(F.col("status") == "failed").alias("failed_runs"),
        ),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), partial)
    return rows.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("sources", "active_jobs", "objects", "failed_runs")])


def runnable_jobs(jobs: DataFrame, sources: DataFrame, mode: str = "local") -> DataFrame:
    """Active jobs of supported sources with a cron expression or an interval."""
    kinds = sources.where(is_supported(F.col("db_type"), mode)).select(F.col("id").alias("data_source_id"), "db_type")
    timed = (F.col("schedule_type") == "cron") | (
        (F.col("schedule_type") == "interval") & (F.coalesce("interval_minutes", F.lit(0)) > 0)
    )
    return jobs.where(F.col("is_active") & timed).join(kinds, "data_source_id")


def public_sources(sources: DataFrame) -> DataFrame:
    return sources.select("id", "name", "db_type", "database", "status")


# --- error isolation ---------------------------------------------------------------------------------------------
def isolated(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Split rows into accepted and rejected; rejected rows carry a `reason`, the rest goes on."""
    marked = rows.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def skipped_schemas(requested: DataFrame, readable: DataFrame) -> DataFrame:
    """Requested schemas that could not be read, with the fixed reason. Both: snapshot_id, schema_name."""
    missing = requested.join(readable.select("snapshot_id", "schema_name"), ["snapshot_id", "schema_name"], "left_anti")
    return missing.withColumn("reason", F.lit(model.SKIPPED_REASON))


# --- deletes -----------------------------------------------------------------------------------------------------
def cascaded(tables: dict[str, DataFrame], source_ids: DataFrame) -> dict[str, DataFrame]:
    """Tables left after deleting sources: jobs, runs, logs and snapshots of a deleted source go with it.

    ``tables``: sources(id), jobs(id, data_source_id), runs(id, job_id), run_logs(run_id), snapshots(data_source_id).
    Only ids travel from one level to the next.
    """
    gone = source_ids.select("id")
    by_source = gone.withColumnRenamed("id", "data_source_id")
    jobs = tables["jobs"].join(by_source, "data_source_id", "left_semi").select(F.col("id").alias("job_id"))
    runs = tables["runs"].join(jobs, "job_id", "left_semi").select(F.col("id").alias("run_id"))
    keys = {
        "sources": (gone, "id"), "jobs": (by_source, "data_source_id"), "runs": (jobs, "job_id"),
        "run_logs": (runs, "run_id"), "snapshots": (by_source, "data_source_id"),
    }
    return {name: rows.join(keys[name][0], keys[name][1], "left_anti") for name, rows in tables.items()}


def allowed_deletes(requests: DataFrame, protected: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """Delete requests that may run, and refused ones with the reason."""
    return isolated(requests, F.when(protected, F.lit(reason)))


def user_deletes(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``requests``: id, requested_by. The own account is protected."""
    return allowed_deletes(requests, F.col("id") == F.col("requested_by"), "own account")


def role_deletes(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``requests``: id, name. The system role is protected."""
    return allowed_deletes(requests, F.col("name") == model.SYSTEM_ROLE, "system role")


def deleted(rows: DataFrame, requests: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(requests.select(key), key, "left_anti")


# --- keys and schema evolution -----------------------------------------------------------------------------------
def key_conflicts(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Keys of the rows that are already stored or occur more than once among them, with the reason.

    Both sides are counted in one grouping, so no join is needed and a hot key is counted before the shuffle.
    """
    sides = rows.select(key, F.lit(1).alias("_new"), F.lit(0).alias("_old")).unionAll(
        stored.select(key, F.lit(0).alias("_new"), F.lit(1).alias("_old"))
    )
    counted = sides.groupBy(key).agg(F.sum("_new").alias("_new"), F.sum("_old").alias("_old")).where("_new > 0")
    reason = F.when(F.col("_old") > 0, "stored").when(F.col("_new") > 1, "repeated")
    return counted.select(key, reason.alias("reason")).where(F.col("reason").isNotNull())


def with_columns(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add the columns that are missing, filled with their defaults; present ones stay."""
    missing = {name: value for name, value in defaults.items() if name not in rows.columns}
    return rows.withColumns(missing) if missing else rows


def evolved_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs of an older layout brought up to date; the old default item list gains SELECT PRIVILEGE."""
    default = F.array(*[F.lit(i) for i in model.DEFAULT_ITEMS])
    rows = with_columns(jobs, {"collect_storage": F.lit(False), "collection_items": default})
    legacy = F.array(*[F.lit(i) for i in model.LEGACY_ITEMS])
    items = F.when(
        same_items(F.col("collection_items"), legacy),
        F.concat("collection_items", F.array(F.lit("SELECT PRIVILEGE"))),
    ).otherwise(F.col("collection_items"))
    return rows.withColumn("collection_items", items)
