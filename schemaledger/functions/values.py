"""Numbers, canonical JSON, digests and map values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys, nulls kept and arrays in order; null for text that is not JSON."""
    return F.to_json(F.try_parse_json(text))


def _quoted(text: Column) -> Column:
    """JSON string literal of a text: the inside of a one-element JSON array."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - F.lit(2))


def canonical_map(values: Column, without: tuple[str, ...] = ()) -> Column:
    """Canonical JSON text of a MAP<STRING,VARIANT>, leaving out some keys."""
    names = F.map_keys(values)
    if without:
        names = F.filter(names, lambda k: ~k.isin(list(without)))
    fields = F.transform(
        F.array_sort(names),
        lambda k: F.concat(_quoted(k), F.lit(":"), F.coalesce(F.to_json(values[k]), F.lit("null"))),
    )
    return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))


def fingerprint(payload: Column) -> Column:
    """SHA-256 hex of the canonical payload."""
    return F.sha2(canonical_json(payload), 256)


def same_json(left: Column, right: Column) -> Column:
    return canonical_json(left).eqNullSafe(canonical_json(right))


def growth_bytes(current: Column, previous: Column) -> Column:
    return current - previous


_FRACTION_BITS = 60


def round_half_even(value: Column) -> Column:
    """A double rounded to two digits, ties to even, decided on its exact binary value.

    2.675 is stored a little below the tie and gives 2.67; rounding its decimal text would give 2.68. The fraction is
    scaled to a whole number (exact, a power of two), and the rest of the division decides.
    """
    unit = F.lit(2**_FRACTION_BITS).cast("decimal(38,0)")
    size = F.abs(value)
    whole = F.floor(size)
    scaled = ((size - whole) * F.lit(float(2**_FRACTION_BITS))).cast("bigint").cast("decimal(20,0)") * 100
    hundredths = F.floor(scaled / unit).cast("bigint")
    rest = (scaled - hundredths.cast("decimal(20,0)") * unit).cast("decimal(38,0)") * 2
    up = (rest > unit) | ((rest == unit) & (hundredths % 2 == 1))
    total = whole * 100 + hundredths + F.when(up, 1).otherwise(0)
    rounded = F.signum(value) * (total.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("double")
    return F.when(size >= F.lit(float(2**52)), value).otherwise(rounded)


def growth_percent(current: Column, previous: Column) -> Column:
    """Percent against the previous total; null when there is none or it is zero."""
    base = F.nullif(previous, F.lit(0))
    return round_half_even((current - previous).cast("double") / base.cast("double") * F.lit(100.0))


def byte_count(value: Column) -> Column:
    """Whole number of bytes; null and unreadable values count as zero."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def row_estimate(value: Column) -> Column:
    return value.try_cast("bigint")


def grant_value(username: Column, default: str = "current_user") -> Column:
    """The value of one SELECT grant."""
    return F.struct(
        F.lit(True).alias("select"),
        F.array(F.lit("SELECT")).alias("privileges"),
        F.coalesce(F.nullif(username, F.lit("")), F.lit(default)).alias("checked_as"),
    )


def no_grant() -> Column:
    """The value of an object whose privileges were not collected."""
    return F.struct(
        F.lit(None).cast("boolean").alias("select"),
        F.array().cast("array<string>").alias("privileges"),
        F.lit("not_collected").alias("checked_as"),
    )


def merged_map(left: Column, right: Column) -> Column:
    """Union of two maps; the right one wins."""
    kept = F.map_filter(left, lambda k, _v: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)


def same_items(left: Column, right: Column) -> Column:
    """Set equality of two lists; null counts as empty."""
    empty = F.array().cast("array<string>")
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, empty)))
    return as_set(left) == as_set(right)


def json_text(document: Column, path: str) -> Column:
    return F.get_json_object(document, path)


def json_length(document: Column, path: str = "$") -> Column:
    """Length of a JSON array; a missing or null array counts as zero."""
    return F.coalesce(F.json_array_length(F.get_json_object(document, path)), F.lit(0))


def json_boolean(document: Column, path: str) -> Column:
    return F.get_json_object(document, path).try_cast("boolean")
