"""Text expressions over built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import model


def join_values(values: Column) -> Column:
    """Elements joined with ', '; a null element prints as empty text, a null list as empty text."""
    return F.array_join(F.coalesce(values.cast("array<string>"), F.array().cast("array<string>")), ", ", "")


def first_text(*candidates: Column) -> Column:
    """First candidate that is neither null nor empty; the last one is taken as it is."""
    *head, last = candidates
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in head], last)


def yes_no(flag: Column) -> Column:
    return F.when(flag, "YES").when(~flag, "NO")


def privilege_label(flag: Column) -> Column:
    labels = model.LABEL_PRIVILEGE
    return F.when(flag.isNull(), labels["unknown"]).when(flag, labels["allowed"]).otherwise(labels["denied"])


def byte_size(value: Column) -> Column:
    """1536 -> '1.5 KB'. Tenths are rounded half up in whole numbers, so no binary fraction is involved."""
    size = F.abs(value.cast("decimal(20,0)"))
    sign = F.when(value < 0, "-").otherwise("")
    text = F.concat(sign, size.cast("string"), F.lit(f" {model.BYTE_UNITS[0]}"))
    branches = F.when(value.isNull(), model.NO_VALUE).when(size < 1024, text)
    last = len(model.BYTE_UNITS) - 1
    for power in range(1, last + 1):
        unit = 1024**power
        tenths = F.floor((size * 20 + unit) / (2 * unit)).cast("decimal(38,0)")
        whole = F.floor(tenths / 10).cast("decimal(38,0)")
        text = F.concat(
            sign, whole.cast("string"), F.lit("."), (tenths - whole * 10).cast("decimal(38,0)").cast("string"),
            F.lit(f" {model.BYTE_UNITS[power]}"),
        )
        branches = branches.when(size < unit * 1024, text) if power < last else branches.otherwise(text)
    return branches


def growth_text(growth: Column) -> Column:
    return F.when(growth.isNotNull(), F.concat(F.when(growth > 0, "+").otherwise(""), byte_size(growth)))


def growth_direction(growth: Column) -> Column:
    return F.when(growth > 0, "up").when(growth < 0, "down").when(growth == 0, "")


def file_stem(source: Column, captured_at: Column, prefix: str = "schema_") -> Column:
    """File stem of an export: cleaned source name and capture time."""
    cleaned = F.regexp_replace(first_text(source, F.lit("schema")), model.FILE_STEM_OTHER, "_")
    cleaned = F.regexp_replace(cleaned, "^_+|_+$", "")
    return F.concat(
        F.lit(prefix), first_text(cleaned, F.lit("schema")), F.lit("_"), F.date_format(captured_at, model.FILE_STEM_TIME)
    )


def truncated(text: Column, limit: int | None = None) -> Column:
    """The first ``limit`` characters; the whole text without a limit."""
    return text if limit is None else F.substring(text, 1, limit)


def object_key(kind: str | Column, *names: Column) -> Column:
    """'column:public.users.email'; a null name prints as empty text."""
    head = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(head, F.lit(":"), F.concat_ws(".", *[F.coalesce(n, F.lit("")) for n in names]))


def schedule_text(schedule_type: Column, cron: Column, interval_minutes: Column) -> Column:
    return (
        F.when(schedule_type == "cron", cron)
        .when(schedule_type == "interval", F.concat(interval_minutes.cast("string"), F.lit(model.LABEL_EVERY)))
        .otherwise(model.LABEL_MANUAL)
    )


def endpoint_text(db_type: Column, database: Column, host: Column, port: Column) -> Column:
    address = F.concat(F.coalesce(host, F.lit("")), F.lit(":"), F.coalesce(port.cast("string"), F.lit("null")))
    return F.when(db_type == "sqlite", database).otherwise(address)


def contains_text(query: str | Column, *columns: Column, separator: str = " ") -> Column:
    """Case-insensitive substring test over joined columns."""
    needle = F.lit(query) if isinstance(query, str) else query
    joined = F.concat_ws(separator, *[F.coalesce(c, F.lit("")) for c in columns])
    return F.contains(F.lower(joined), F.lower(needle))
