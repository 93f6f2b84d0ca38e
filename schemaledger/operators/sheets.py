"""Export datasets, one per sheet, for one snapshot or many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import model
from ..functions.text import join_values
from . import flatten, history

_ID = "snapshot_id"


def _fraction(percent: Column) -> Column:
    return percent / F.lit(100.0)


def _facts(stored: DataFrame, facts: tuple[str, ...]) -> DataFrame:
    """Facts and counts of every snapshot: one scan, one grouping."""
    return stored.groupBy(_ID).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("captured_at", *facts)], *history.total_counts())


def summary(stored: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Facts of a snapshot in long form: section, label, value."""
    facts = ("source", "db_type", "database", "storage_growth", "storage_summary")
    counted = ("schemas", "tables", "views", "columns", "indexes", "foreign_keys")
    heads = _facts(stored, facts).join(fingerprints, _ID)
    text = lambda c: c.cast("string")
    option = F.when(F.col("storage_growth"), model.LABEL_OPTION["storage"]).otherwise(model.LABEL_OPTION["plain"])
    blank = lambda c: F.coalesce(text(F.col(c)), F.lit(""))
    info = (
        blank("source"), blank("db_type"), blank("database"), F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss"),
        blank("fingerprint"), option,
    )
    counts = [text(F.col(c)) for c in counted]
    sizes = [
        text(F.col(f"storage_summary.{c}"))
        for c in ("data_bytes", "index_bytes", "total_bytes", "growth_bytes", "observed_tables", "comparable_tables")
    ]
    blocks = zip(model.SUMMARY_SECTIONS, (model.SUMMARY_INFO, model.SUMMARY_TOTALS, model.SUMMARY_STORAGE), (info, counts, sizes))
    lines = [
        F.struct(F.lit(section).alias("section"), F.lit(label).alias("label"), value.alias("value"),
                 (F.col("storage_summary").isNotNull() if section == model.SUMMARY_SECTIONS[2] else F.lit(True)).alias("_shown"))
        for section, labels, values in blocks
        for label, value in zip(labels, values)
    ]
    rows = heads.select(_ID, F.posexplode(F.array(*lines)).alias("line_no", "line"))
    return rows.where("line._shown").select(_ID, "line_no", "line.section", "line.label", "line.value")


def tables(stored: DataFrame, with_storage: bool = True) -> DataFrame:
    rows = flatten.table_details(stored)
    sizes = [
        F.col("data_bytes"), F.col("index_bytes"), F.col("total_bytes"), F.col("growth_bytes"),
        _fraction(F.col("growth_percent")).alias("growth_fraction"), F.col("row_estimate"),
    ]
    return rows.select(
        _ID, "schema_name", "table_name", "comment", "column_count", join_values(F.col("primary_key")).alias("primary_key"),
        "foreign_key_count", "index_count", *(sizes if with_storage else []),
    )


def columns(stored: DataFrame) -> DataFrame:
    return flatten.column_details(stored).select(
        _ID, "schema_name", "table_name", "ordinal", "column_name", "data_type",
        F.coalesce("nullable", F.lit(False)).alias("nullable"), "default_value", "comment", "is_primary_key",
    )


def views(stored: DataFrame) -> DataFrame:
    return flatten.views(stored).select(_ID, "schema_name", "view_name", F.coalesce("definition", F.lit("")).alias("definition"))


def indexes(stored: DataFrame) -> DataFrame:
    return flatten.index_details(stored).select(
        _ID, "schema_name", "table_name", "index_name", join_values(F.col("column_names")).alias("columns"),
        F.coalesce("is_unique", F.lit(False)).alias("is_unique"),
    )


def foreign_keys(stored: DataFrame) -> DataFrame:
    return flatten.foreign_key_details(stored).select(
        _ID, "schema_name", "table_name", "key_name", join_values(F.col("constrained_columns")).alias("local_columns"),
        "referred_schema", "referred_table", join_values(F.col("referred_columns")).alias("referred_columns"),
    )


def procedures(stored: DataFrame) -> DataFrame:
    return flatten.procedures(stored).select(_ID, "schema_name", "procedure_name", "routine_type", "definition")


def privileges(stored: DataFrame) -> DataFrame:
    return flatten.privileges(stored).select(
        _ID, "schema_name", "object_type", "object_name", "can_select", "checked_as",
        join_values(F.col("privileges")).alias("privileges"),
    )


def storage(stored: DataFrame) -> DataFrame:
    return flatten.table_details(stored).select(
        _ID, "schema_name", "table_name", "data_bytes", "index_bytes", "total_bytes", "previous_total_bytes",
        "growth_bytes", _fraction(F.col("growth_percent")).alias("growth_fraction"), "row_estimate",
    )


def export_sheets(stored: DataFrame, fingerprints: DataFrame, items: set[str] | None = None) -> dict[str, DataFrame]:
    """Datasets of the selected sheets. All nine by default; an empty set selects none, unknown names are ignored."""
    chosen = set(model.EXPORT_SHEETS) if items is None else set(items)
    makers = {
        "SUMMARY": lambda: summary(stored, fingerprints),
        "TABLE": lambda: tables(stored, "STORAGE" in chosen),
        "COLUMN": lambda: columns(stored),
        "VIEW": lambda: views(stored),
        "INDEX": lambda: indexes(stored),
        "FOREIGN KEY": lambda: foreign_keys(stored),
        "PROCEDURE": lambda: procedures(stored),
        "SELECT PRIVILEGE": lambda: privileges(stored),
        "STORAGE": lambda: storage(stored),
    }
    return {name: makers[name]() for name in model.EXPORT_SHEETS if name in chosen}
