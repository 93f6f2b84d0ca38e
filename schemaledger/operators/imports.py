"""Validation and bulk import of connection and job rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import model
from ..functions.text import truncated
from ..session import written
from .ordering import number_block, numbered, running_total


# --- row validation ----------------------------------------------------------------------------------------------
def _messages(*rules: tuple[Column, str]) -> Column:
    """Messages of the rules that are broken, in order."""
    broken = [F.when(bad, F.lit(message)) for bad, message in rules]
    return F.filter(F.array(*broken), lambda m: m.isNotNull())


def _bad_name() -> Column:
    low, high = model.NAME_LENGTH
    return F.col("name").isNull() | ~F.length("name").between(low, high)


def with_source_errors(rows: DataFrame) -> DataFrame:
    """Add `errors` to connection rows: name length, database kind, SSH authentication type."""
    auth = F.col("ssh_auth_type") if "ssh_auth_type" in rows.columns else F.lit(None).cast("string")
    errors = _messages(
        (_bad_name(), "name: 2 to 120 characters"),
        (F.col("db_type").isNull() | ~F.col("db_type").isin(list(model.DB_TYPES)), "db_type: unknown kind"),
        (auth.isNotNull() & ~auth.isin(list(model.AUTH_TYPES)), "ssh_auth_type: unknown type"),
    )
    return rows.withColumn("errors", errors)


def with_job_errors(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Add `errors` to job rows: name length, schedule type, interval, existing source. ``sources``: id, name."""
    known = sources.select(F.col("id").alias("data_source_id"), F.lit(True).alias("_known"))
    schedule = F.coalesce("schedule_type", F.lit("cron"))
    errors = _messages(
        (_bad_name(), "name: 2 to 120 characters"),
        (~schedule.isin(list(model.SCHEDULE_TYPES)), "schedule_type: unknown type"),
        (F.col("interval_minutes").isNotNull() & (F.col("interval_minutes") < 1), "interval_minutes: at least 1"),
        (F.col("_known").isNull(), "data_source_id: unknown source"),
    )
    return rows.join(known, "data_source_id", "left").withColumn("errors", errors).drop("_known")


def split_valid(rows: DataFrame, error_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their row number and the error text, cut only if a length is given."""
    bad = F.size("errors") > 0
    rejected = rows.where(bad).withColumn("error", truncated(F.array_join("errors", "; "), error_chars))
    return rows.where(~bad).drop("errors"), rejected


def preview_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(F.size("errors") == 0).alias("valid"))


def source_preview(rows: DataFrame) -> DataFrame:
    """Connection rows without secrets: seven fields. `ssh_nested_enabled` is the flag of a nested `ssh` object."""
    nested = F.col("ssh_nested_enabled") if "ssh_nested_enabled" in rows.columns else F.lit(False)
    enabled = F.coalesce("ssh_enabled", F.lit(False)) | F.coalesce(nested, F.lit(False))
    return rows.select("name", "db_type", "host", "port", "database", "username", enabled.alias("ssh_enabled"))


def redacted(rows: DataFrame) -> DataFrame:
    """Filled secret fields replaced by a fixed mark."""
    present = [c for c in model.SECRET_FIELDS if c in rows.columns]
    mark = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.lit(model.REDACTED)).otherwise(F.col(c))
    return rows.withColumns({c: mark(c) for c in present})


def has_service_account(document: Column) -> Column:
    """The text is a JSON object whose `project_id` and `private_key` are filled."""
    parsed = F.try_parse_json(document)

    def filled(field: str) -> Column:
        value = F.coalesce(F.to_json(F.try_variant_get(parsed, f"$.{field}", "variant")), F.lit("null"))
        return ~value.isin("null", '""', "0", "false", "[]", "{}")

    return F.coalesce(filled("project_id") & filled("private_key"), F.lit(False))


def is_bigquery_target(project: Column, region: Column) -> Column:
    whole = lambda pattern: rf"\A(?:{pattern})\z"
    return project.rlike(whole(model.BIGQUERY_PROJECT)) & F.lower(F.coalesce(region, F.lit("US"))).rlike(whole(model.BIGQUERY_REGION))


# --- references --------------------------------------------------------------------------------------------------
def with_source_names(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Add `source_name`; '#id' when the source is not known."""
    names = sources.groupBy(F.col("id").alias("data_source_id")).agg(F.min("name").alias("_source"))
    fallback = F.concat(F.lit("#"), F.col("data_source_id").cast("string"))
    return jobs.join(names, "data_source_id", "left").withColumn("source_name", F.coalesce("_source", fallback)).drop("_source")


def with_job_names(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Add `job_name`, with the id as fallback."""
    names = jobs.groupBy(F.col("id").alias("job_id")).agg(F.min("name").alias("_job"))
    fallback = F.concat(F.lit(model.LABEL_JOB), F.col("job_id").cast("string"))
    return runs.join(names, "job_id", "left").withColumn("job_name", F.coalesce("_job", fallback)).drop("_job")


def resolved_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Fill `data_source_id` from the source name `data_source` where no id is given; add `error`.

    An id of zero counts as not given.
    """
    ids = sources.groupBy(F.col("name").alias("data_source")).agg(F.min("id").alias("_found"))
    given = F.nullif(F.col("data_source_id"), F.lit(0))
    unknown = F.col("data_source").isNotNull() & given.isNull() & F.col("_found").isNull()
    error = F.when(unknown, F.concat(F.lit("unknown data source: "), F.col("data_source")))
    joined = rows.join(ids, "data_source", "left")
    return joined.withColumns({"error": error, "data_source_id": F.coalesce(given, "_found")}).drop("_found")


def existing_rows(rows: DataFrame, stored: DataFrame, key: str = "name") -> DataFrame:
    return rows.join(stored.select(key), key, "left_semi")


def new_rows(rows: DataFrame, stored: DataFrame, key: str = "name") -> DataFrame:
    return rows.join(stored.select(key), key, "left_anti")


# --- free names --------------------------------------------------------------------------------------------------
_SUFFIX = r"^(.*) \(([1-9][0-9]{0,17})\)$"
_ONE_SUFFIX = r" \([1-9][0-9]{0,17}\)"
_SUFFIXES = r"( \([1-9][0-9]{0,17}\))+$"


def name_root(name: Column) -> Column:
    """The name without any trailing ' (n)'."""
    return F.regexp_replace(name, _SUFFIXES, "")


def _depth(name: Column) -> Column:
    """How many ' (n)' trail the name."""
    return F.size(F.regexp_extract_all(F.regexp_extract(name, _SUFFIXES, 0), F.lit(_ONE_SUFFIX), F.lit(0)))


def _slots(names: DataFrame, *more: str) -> DataFrame:
    """Names of the form 'name (n)' with n from 2, as (name, slot)."""
    slot = F.regexp_extract("name", _SUFFIX, 2).try_cast("bigint")
    return names.select(F.regexp_extract("name", _SUFFIX, 1).alias("name"), slot.alias("slot"), *more).where("slot >= 2")


def free_names(demands: DataFrame, used: DataFrame) -> DataFrame:
    """(row_no, name, final_name): the k-th row asking for a taken name gets its k-th free 'name (n)', n from 2.

    ``demands``: row_no, name. ``used``: name, slot (the numbers that are taken). The k-th free number is k + 1 plus
    the used numbers before it. A used number u, the j-th used of its name, has u - 1 - j free numbers before it; so
    both kinds of rows are laid on one axis and a running total counts the used ones. Rows and used numbers of one
    name may be any number: all steps run in blocks.
    """
    ranked = numbered(demands, ["name"], [F.col("row_no")], number_block("row_no"), "_k")
    held = used.join(demands.select("name").distinct(), "name", "left_semi").select("name", "slot").distinct()
    held = numbered(held, ["name"], [F.col("slot")], number_block("slot"), "_j")

    asking = ranked.select("name", "row_no", F.col("_k").alias("_at"), F.lit(0).cast("bigint").alias("_used"))
    # Neighbouring used numbers have the same free numbers before them; they are counted to one row first.
    taken = held.groupBy("name", (F.col("slot") - 1 - F.col("_j")).alias("_at")).agg(F.count("*").alias("_used"))
    taken = taken.withColumn("row_no", F.lit(None).cast("bigint"))
    axis = running_total(
        asking.unionByName(taken), ["name"], [F.col("_at"), F.col("_used")], number_block("_at"), F.col("_used"), "_skipped"
    )
    number = F.col("_at") + 1 + F.col("_skipped")
    named = F.concat(F.col("name"), F.lit(" ("), number.cast("string"), F.lit(")"))
    return axis.where(F.col("_used") == 0).select("row_no", "name", named.alias("final_name"))


def _takers_and_demands(rows: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that get their own name, and rows that find it taken. ``taken``: names held before any of the rows."""
    first = rows.groupBy("name").agg(F.min("row_no").alias("_first"))
    state = first.join(taken.select("name").distinct().withColumn("_held", F.lit(True)), "name", "left")
    late = F.coalesce("_held", F.lit(False)) | (F.col("row_no") > F.col("_first"))
    flagged = rows.join(state, "name").withColumn("_late", late)
    kept = flagged.where(~F.col("_late")).select("row_no", "name", F.col("name").alias("final_name"))
    return kept, flagged.where("_late").select("row_no", "name")


def _contested_names(demands: DataFrame, stored: DataFrame, literals: DataFrame) -> DataFrame:
    """`free_names` where rows of the file ask for 'name (n)' themselves. ``literals``: name, row_no of the next level.

    A number asked for at row t is used from t on, unless a demand reached it before. Which numbers the demands reach
    depends only on lower numbers, so the rule is applied to all numbers at once until nothing changes: a number is
    reached by the demand whose rank is the count of free numbers up to it.
    """
    ranked = written(numbered(demands, ["name"], [F.col("row_no")], number_block("row_no"), "rank"))
    asked = _slots(literals.groupBy("name").agg(F.min("row_no").alias("since")), "since")
    slots = _slots(stored).distinct().withColumn("since", F.lit(0).cast("bigint")).unionByName(asked)
    slots = slots.groupBy("name", "slot").agg(F.min("since").alias("since")).withColumn("reached", F.lit(False))
    slots = written(slots.join(ranked.select("name").distinct(), "name", "left_semi"))

    while True:
        used = F.when(F.col("reached"), 0).otherwise(1)
        counted = running_total(slots, ["name"], [F.col("slot")], number_block("slot"), used, "_used")
        rank = F.col("slot") - 1 - (F.col("_used") - used)
        tested = counted.withColumn("rank", rank.cast("bigint")).join(ranked, ["name", "rank"], "left")
        reached = F.coalesce(F.col("row_no") < F.col("since"), F.lit(False))
        following = written(tested.select("name", "slot", "since", F.col("reached").alias("_before"), reached.alias("reached")))
        slots = following.drop("_before")
        if following.where("reached <> _before").isEmpty():
            return free_names(demands, slots.where("NOT reached"))


def _renamed_by_level(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Names without suffix first, then 'X (n)', then 'X (n) (m)': a level only depends on the one above it."""
    levels = rows.select(F.max(_depth(F.col("name"))).alias("deepest")).first()["deepest"]
    given = None
    done = []
    for level in range(levels + 1):
        here = rows.where(_depth(F.col("name")) == level)
        taken = stored.select("name")
        if given is not None:
            taken = taken.unionByName(given)
        kept, demands = _takers_and_demands(here, taken)
        moved = written(_contested_names(demands, stored, rows.where(_depth(F.col("name")) == level + 1)))
        given = moved.select(F.col("final_name").alias("name"))
        done += [kept, moved]
    return reduce(DataFrame.unionByName, done)


def renamed(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(row_no, name, final_name) under the rename policy; a row sees the rows before it.

    Names that only meet their own copies are numbered in one pass. Only where the rows hold both 'X' and 'X (n)' can
    one row's new name meet another row's own name; those roots are settled level by level, still as joins and
    running totals over all rows. Whether there are any is asked for when the plan is built.
    """
    rows = incoming.select("row_no", "name")
    roots = rows.select("name").distinct().groupBy(name_root(F.col("name")).alias("_root")).agg(F.count("*").alias("_n"))
    mixed = roots.where("_n > 1").select("_root")
    if mixed.isEmpty():
        kept, demands = _takers_and_demands(rows, stored)
        return kept.unionByName(free_names(demands, _slots(stored)))

    mixed = written(mixed)
    rooted = lambda names: names.withColumn("_root", name_root(F.col("name")))
    kept, demands = _takers_and_demands(rooted(rows).join(mixed, "_root", "left_anti").drop("_root"), stored)
    plain = kept.unionByName(free_names(demands, _slots(stored)))
    contested = written(rooted(rows).join(mixed, "_root", "left_semi").drop("_root"))
    held = written(rooted(stored.select("name")).join(mixed, "_root", "left_semi").drop("_root"))
    return plain.unionByName(_renamed_by_level(contested, held))


# --- import with a duplicate policy ------------------------------------------------------------------------------
def import_actions(incoming: DataFrame, stored: DataFrame, policy: str = "skip") -> DataFrame:
    """One row per incoming row: row_no, name, final_name, action (created, updated, skipped).

    ``incoming``: row_no, name, …; ``stored``: name, …. Copies of a name in the file are settled by its lowest row
    number, found with a partial aggregate, so a name may repeat any number of times.
    """
    if policy not in model.DUPLICATE_POLICIES:
        raise ValueError(f"policy must be one of {', '.join(model.DUPLICATE_POLICIES)}")
    if policy == "rename":
        return renamed(incoming, stored).withColumn("action", F.lit("created"))
    rows = incoming.select("row_no", "name")
    first = rows.groupBy("name").agg(F.min("row_no").alias("_first"))
    fresh = new_rows(first, stored).select("name", "_first")
    other = "skipped" if policy == "skip" else "updated"
    action = F.when(F.col("row_no") == F.col("_first"), "created").otherwise(other)
    return rows.join(fresh, "name", "left").select("row_no", "name", F.col("name").alias("final_name"), action.alias("action"))


def imported(incoming: DataFrame, stored: DataFrame, policy: str = "skip") -> DataFrame:
    """The stored table after the import."""
    values = [c for c in stored.columns if c != "name"]
    if policy == "rename":
        names = renamed(incoming, stored).select("row_no", "final_name")
        added = incoming.join(names, "row_no").select(F.col("final_name").alias("name"), *values)
        return stored.select("name", *values).unionByName(added)
    pick = F.min_by if policy == "skip" else F.max_by
    chosen = incoming.groupBy("name").agg(pick(F.struct(*values), "row_no").alias("_new"))
    old = stored.select("name", F.struct(*values).alias("_old"))
    both = old.join(chosen, "name", "full_outer")
    order = ("_old", "_new") if policy == "skip" else ("_new", "_old")
    return both.select("name", F.coalesce(*order).alias("_row")).select("name", "_row.*")


def import_counts(actions: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Counts of created, updated, skipped and rejected rows in one row."""
    rows = actions.select("action")
    if errors is not None:
        rows = rows.unionAll(errors.select(F.lit("error").alias("action")))
    names = {"created": "created", "updated": "updated", "skipped": "skipped", "error": "errors"}
    return rows.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in names.items()])


# --- upsert and secrets ------------------------------------------------------------------------------------------
def upserted(stored: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows with the changed ones replaced and the new ones added. One row per key on each side."""
    values = [c for c in stored.columns if c != key]
    old = stored.select(key, F.struct(*values).alias("_old"))
    new = changes.select(key, F.struct(*values).alias("_new"))
    both = old.join(new, key, "full_outer")
    return both.select(key, F.coalesce("_new", "_old").alias("_row")).select(key, "_row.*")


def updated_sources(stored: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Connections after an update: a secret changes only where one is given.

    TLS secrets stay only while TLS is on; an empty one does not replace. A BigQuery source has no host, port, user
    or SSH. Other fields take the new value as it is.
    """
    secrets = [c for c in ("password", "service_account_json") if c in stored.columns]
    tls = [c for c in model.TLS_SECRETS if c in stored.columns]
    ssh = [c for c in ("ssh_password", "ssh_private_key", "ssh_private_key_passphrase") if c in stored.columns]
    old, new = stored.alias("o"), changes.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    kept = F.col(f"n.{key}").isNull()
    ssh_given = F.lit(False)
    for c in [c for c in ssh if c != "ssh_private_key_passphrase"]:
        ssh_given = ssh_given | F.col(f"n.{c}").isNotNull()

    def field(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == key:
            return F.coalesce(n, o)
        if c in secrets:
            value = F.coalesce(n, o)
        elif c in tls:
            value = F.when(F.coalesce(F.col("n.ssl_enabled"), F.lit(False)), F.coalesce(F.nullif(n, F.lit("")), o))
        elif c in ssh:
            value = F.when(ssh_given, n).otherwise(o)
        else:
            value = n
        if c in ("host", "username"):
            value = F.when(F.col("n.db_type") == "bigquery", "").otherwise(value)
        if c == "port":
            value = F.when(F.col("n.db_type") == "bigquery", None).otherwise(value)
        if c == "ssh_enabled":
            value = F.when(F.col("n.db_type") == "bigquery", False).otherwise(value)
        return F.when(kept, o).otherwise(value)

    return joined.select(*[field(c).alias(c) for c in stored.columns])
