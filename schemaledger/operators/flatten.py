"""Rows of the snapshot store -> flat relations.

Every function reads one kind of rows (a folder of the store) and names the leaves it returns, so the scan reads no
other columns. Lists are zipped from their leaves before they are exploded: a struct exploded whole would be read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import model
from ..functions import text
from ..functions.values import canonical_map
from . import collect

_HEADER = list(model.HEADER_COLUMNS)
_OBJECT_KINDS = (model.TABLE_KIND, model.VIEW_KIND, model.ROUTINE_KIND)


def of_kind(stored: DataFrame, *kinds: str) -> DataFrame:
    return stored.where(F.col("kind").isin(*kinds) if len(kinds) > 1 else F.col("kind") == kinds[0])


def _zipped(item: str, *fields: str) -> Column:
    return F.arrays_zip(*[F.col(f"{item}.{f}").alias(f) for f in fields])


def _length(item: str) -> Column:
    """Length of a list of structs, from its names alone."""
    return F.coalesce(F.size(f"{item}.name"), F.lit(0)).cast("bigint")


def snapshot_history(stored: DataFrame) -> DataFrame:
    """Header facts and schema count of every snapshot."""
    rows = of_kind(stored, model.SNAPSHOT, model.SCHEMA)
    fact = lambda c, name: F.max(c).alias(name)
    return rows.groupBy(*_HEADER).agg(
        fact("source", "source_name"), fact("db_type", "db_type"), F.count_if(F.col("kind") == model.SCHEMA).alias("schema_count"))


def schema_history(stored: DataFrame) -> DataFrame:
    """Counts of tables, views and procedures per schema; schemas without objects count zero."""
    rows = of_kind(stored, model.SCHEMA, *_OBJECT_KINDS)
    return rows.groupBy(*_HEADER, "schema_name").agg(
        *[F.count_if(F.col("kind") == kind).alias(f"{kind}_count") for kind in _OBJECT_KINDS])


def table_history(stored: DataFrame) -> DataFrame:
    return of_kind(stored, model.TABLE_KIND).select(*_HEADER, "schema_name", F.col("name").alias("table_name"), "comment")


def _under_tables(stored: DataFrame, item: str, fields: tuple[str, ...], *extra: Column) -> DataFrame:
    rows = of_kind(stored, model.TABLE_KIND).select(
        *_HEADER, "schema_name", F.col("name").alias("table_name"), *extra, F.posexplode(_zipped(item, *fields)).alias("_pos", "c"))
    return rows.withColumn("ordinal", (F.col("_pos") + 1).cast("int"))


def column_history(stored: DataFrame) -> DataFrame:
    """Columns of every snapshot."""
    return _under_tables(stored, "columns", ("name", "type", "nullable")).select(
        *_HEADER, "schema_name", "table_name", F.col("c.name").alias("column_name"),
        F.col("c.type").alias("data_type"), F.col("c.nullable").alias("nullable"),
    )


def column_details(stored: DataFrame) -> DataFrame:
    """Columns with ordinal, default, comment and primary-key membership."""
    keys = F.coalesce("primary_key.constrained_columns", F.array().cast("array<string>")).alias("_keys")
    rows = _under_tables(stored, "columns", ("name", "type", "nullable", "default", "comment"), keys)
    return rows.select(
        *_HEADER, "schema_name", "table_name", "ordinal", F.col("c.name").alias("column_name"),
        F.col("c.type").alias("data_type"), F.col("c.nullable").alias("nullable"),
        F.col("c.default").alias("default_value"), F.col("c.comment").alias("comment"),
        F.coalesce(F.array_contains("_keys", F.col("c.name")), F.lit(False)).alias("is_primary_key"),
    )


def index_details(stored: DataFrame) -> DataFrame:
    return _under_tables(stored, "indexes", ("name", "column_names", "unique")).select(
        *_HEADER, "schema_name", "table_name", "ordinal", F.col("c.name").alias("index_name"),
        F.col("c.column_names").alias("column_names"), F.col("c.unique").alias("is_unique"),
    )


def foreign_key_details(stored: DataFrame) -> DataFrame:
    fields = ("name", "constrained_columns", "referred_schema", "referred_table", "referred_columns")
    rows = _under_tables(stored, "foreign_keys", fields)
    return rows.select(*_HEADER, "schema_name", "table_name", "ordinal", "c.*").withColumnRenamed("name", "key_name")


def table_details(stored: DataFrame) -> DataFrame:
    """Per table: counts, primary key, permissions and storage."""
    return of_kind(stored, model.TABLE_KIND).select(
        *_HEADER, "schema_name", F.col("name").alias("table_name"), "comment", _length("columns").alias("column_count"),
        _length("foreign_keys").alias("foreign_key_count"), _length("indexes").alias("index_count"),
        F.col("primary_key.constrained_columns").alias("primary_key"), "permissions", "storage.*",
    )


def views(stored: DataFrame) -> DataFrame:
    return of_kind(stored, model.VIEW_KIND).select(*_HEADER, "schema_name", F.col("name").alias("view_name"), "definition", "permissions")


def procedures(stored: DataFrame) -> DataFrame:
    return of_kind(stored, model.ROUTINE_KIND).select(
        *_HEADER, "schema_name", F.col("name").alias("procedure_name"), "routine_type", "return_type", "arguments", "definition")


def skipped_schemas(stored: DataFrame) -> DataFrame:
    rows = of_kind(stored, model.SNAPSHOT).select(*_HEADER, F.explode("skipped_schemas").alias("k"))
    return rows.select(*_HEADER, F.col("k.name").alias("schema_name"), F.col("k.reason").alias("reason"))


def privileges(stored: DataFrame) -> DataFrame:
    """SELECT privilege of every table and view; repeats are kept."""
    label = F.when(F.col("kind") == model.TABLE_KIND, model.LABEL_TABLE).otherwise(model.LABEL_VIEW)
    return of_kind(stored, model.TABLE_KIND, model.VIEW_KIND).select(
        *_HEADER, "schema_name", label.alias("object_type"), F.col("name").alias("object_name"),
        F.col("permissions.select").alias("can_select"), F.col("permissions.checked_as").alias("checked_as"),
        F.col("permissions.privileges").alias("privileges"),
    )


# --- objects with lossless values --------------------------------------------------------------------------------
LEAF_KINDS = (model.SCHEMA, model.TABLE_KIND, "column", "index", model.VIEW_KIND, model.ROUTINE_KIND)
_VARIANTS = "array<map<string,variant>>"
# Keys of an object, and how its own rows are laid out: `position` is its document's order, then the place in a list.
OBJECT_KEY = ("kind", "schema_name", "table_name", "name")
PLACE = ("position", "item")


def _name(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value["name"], "$", "string"), F.lit(""))


def objects(stored: DataFrame, without: tuple[str, ...] = (), keep: tuple[str, ...] = (), kinds: tuple[str, ...] = LEAF_KINDS) -> DataFrame:
    """Objects of the asked ``kinds`` with their canonical JSON value.

    Columns: header, kind, schema_name, table_name (columns and indexes only), name, position, item, value. A table's
    value leaves out its columns and indexes, and the keys named in ``without``. Columns named in ``keep`` are carried
    along. Typed objects are printed from their fields; only those with a `raw` text are parsed, and keep unknown keys.
    """
    from_tables = tuple(k for k in kinds if k in (model.TABLE_KIND, "column", "index"))
    read = tuple(k for k in (model.SCHEMA, model.VIEW_KIND, model.ROUTINE_KIND) if k in kinds) + ((model.TABLE_KIND,) if from_tables else ())
    no_value, no_table = F.lit(None).cast("string"), F.lit(None).cast("string")
    own = F.coalesce("name", F.lit(""))
    raw = F.try_variant_get(F.try_parse_json("raw"), "$", "map<string,variant>")

    def row(kind: str, name: Column, value: Column, table: Column = no_table, item: Column | None = None) -> Column:
        place = F.lit(0) if item is None else item
        return F.struct(F.lit(kind).alias("kind"), table.alias("table_name"), name.alias("name"), place.cast("bigint").alias("item"), value.alias("value"))

    def typed_items(kind: str, listed: str, print_item) -> Column:
        items = F.transform(listed, lambda i, at: row(kind, F.coalesce(i["name"], F.lit("")), print_item(i), own, at))
        return F.coalesce(items, F.array().cast("array<struct<kind:string,table_name:string,name:string,item:bigint,value:string>>"))

    def raw_items(kind: str, listed: str) -> Column:
        items = F.coalesce(F.try_variant_get(F.try_element_at("_raw", F.lit(listed)), "$", _VARIANTS), F.array().cast(_VARIANTS))
        return F.transform(items, lambda i, at: row(kind, _name(i), canonical_map(i), own, at))

    def table_rows(own_value: Column, columns: Column, indexes: Column) -> Column:
        chosen = {model.TABLE_KIND: F.array(row(model.TABLE_KIND, own, own_value)), "column": columns, "index": indexes}
        lists = [chosen[k] for k in from_tables]
        return F.concat(*lists) if len(lists) > 1 else lists[0]

    lists = {}
    if model.SCHEMA in kinds:
        lists[model.SCHEMA] = F.array(row(model.SCHEMA, F.coalesce("schema_name", F.lit("")), no_value))
    for kind, value in ((model.VIEW_KIND, collect.view_json()), (model.ROUTINE_KIND, collect.routine_json())):
        if kind in kinds:
            lists[kind] = F.array(row(kind, own, F.coalesce("raw", value)))
    if from_tables:
        hidden = ("columns", "indexes", *without)
        lists[model.TABLE_KIND] = F.when(F.col("_raw").isNull(), table_rows(
            collect.table_json(without=hidden), typed_items("column", "columns", collect.column_json), typed_items("index", "indexes", collect.index_json),
        )).otherwise(table_rows(canonical_map(F.col("_raw"), hidden), raw_items("column", "columns"), raw_items("index", "indexes")))
    rows = None
    for kind, value in lists.items():
        rows = F.when(F.col("kind") == kind, value) if rows is None else rows.when(F.col("kind") == kind, value)
    found = of_kind(stored, *read).withColumn("_raw", raw)
    return found.select(
        *_HEADER, *keep, F.coalesce("schema_name", F.lit("")).alias("schema_name"), F.coalesce("position", F.lit(0)).cast("bigint").alias("position"), F.explode(rows).alias("o"),
    ).select(*_HEADER, *keep, "schema_name", "position", "o.*")


def printed_key() -> Column:
    """The key of an object as text."""
    name = F.col
    return (
        F.when(name("kind") == "schema", F.concat(F.lit("schema:"), name("schema_name")))
        .when(name("kind").isin("column", "index"), text.object_key(name("kind"), name("schema_name"), name("table_name"), name("name")))
        .otherwise(text.object_key(name("kind"), name("schema_name"), name("name")))
    )


def keyed_objects(rows: DataFrame) -> DataFrame:
    """One row per key and snapshot, the last one in document order, with the printed `key`."""
    last = F.max_by("value", F.struct(*PLACE)).alias("value")
    return rows.groupBy(*_HEADER, *OBJECT_KEY).agg(last).withColumn("key", printed_key())
