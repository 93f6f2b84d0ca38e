"""What to collect, attaching facets to objects, and snapshot assembly.

A snapshot is stored as rows, one for its facts and one for each schema, table, view and routine (`model.STORED`). No
row and no group is ever larger than one object, however large the snapshot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import model
from ..functions.values import no_grant
from ..session import broadcast_if_small, written

DIGEST_WORDS = 8


# --- what to collect ---------------------------------------------------------------------------------------------
def is_supported(db_type: Column, mode: str = "local") -> Column:
    kinds = [k for k in model.DB_TYPES if k not in model.EXCLUDED_DB_TYPES.get(mode, ())]
    return F.coalesce(db_type.isin(kinds), F.lit(False))


def with_support(sources: DataFrame, mode: str = "local") -> DataFrame:
    """Add `supported` and, for the others, a `reason`."""
    ok = is_supported(F.col("db_type"), mode)
    text = F.concat(F.lit("unsupported database kind: "), F.coalesce(F.col("db_type"), F.lit("")))
    return sources.withColumn("supported", ok).withColumn("reason", F.when(~ok, text))


def is_usable_schema(name: Column, db_type: Column) -> Column:
    """Not a system schema of any kind, and no `SYS…` schema of a DB2 database."""
    system = F.lower(name).isin(list(model.SYSTEM_SCHEMAS))
    return ~system & ~((db_type == "db2") & F.startswith(F.upper(name), F.lit("SYS")))


def chosen_schemas(available: DataFrame) -> DataFrame:
    """Schemas to collect per source.

    ``available``: data_source_id, db_type, schema_name, selected ARRAY<STRING>, dataset. An explicit list wins, then
    the data set of a BigQuery source, then every usable schema. Listed names are taken even when they are not
    available; the collection then reports them as skipped.
    """
    selected = F.coalesce(F.col("selected"), F.array().cast("array<string>"))
    dataset = F.when(F.col("db_type") == "bigquery", F.nullif(F.col("dataset"), F.lit("")))
    usable = is_usable_schema(F.col("schema_name"), F.col("db_type"))
    names = (
        F.when(F.size(selected) > 0, selected)
        .when(dataset.isNotNull(), F.array(dataset))
        .when(usable, F.array("schema_name"))
    )
    return available.select("data_source_id", F.explode(names).alias("schema_name")).distinct()


def chosen_items(items: Column) -> Column:
    """Known items in upper case, sorted; a null or empty list means the default items."""
    known = F.array(*[F.lit(i) for i in model.ALL_ITEMS])
    default = F.array(*[F.lit(i) for i in model.DEFAULT_ITEMS])
    raw = F.when(F.coalesce(F.size(items), F.lit(0)) > 0, items).otherwise(default)
    return F.array_sort(F.array_intersect(F.transform(raw, F.upper), known))


def has_item(items: Column, item: str) -> Column:
    return F.coalesce(F.array_contains(items, item), F.lit(False))


def selected_relations(relations: dict[str, DataFrame], items: DataFrame) -> dict[str, DataFrame]:
    """Keep only rows whose snapshot asked for them. ``items``: snapshot_id, items ARRAY<STRING> (one row each)."""
    needs = {
        "tables": "TABLE", "columns": "TABLE", "primary_keys": "TABLE", "foreign_keys": "TABLE",
        "unique_constraints": "TABLE", "storage": "TABLE", "indexes": "INDEX", "views": "VIEW",
        "routines": "PROCEDURE", "grants": "SELECT PRIVILEGE",
    }
    wanted = items.select("snapshot_id", "items")
    kept = {}
    for name, rows in relations.items():
        if name not in needs:
            kept[name] = rows
            continue
        item = has_item(F.col("items"), needs[name])
        if name == "indexes":
            item = item & has_item(F.col("items"), "TABLE")
        chosen = wanted.where(item).select("snapshot_id")
        kept[name] = rows.join(chosen, "snapshot_id", "left_semi")
    return kept


# --- attaching facets --------------------------------------------------------------------------------------------
def attach_grants(objects: DataFrame, grants: DataFrame, name: str = "table_name") -> DataFrame:
    """Add `permissions`: the grant on the name, else the grant on '*', else the not-collected value.

    ``grants``: snapshot_id, schema_name, name, permissions. One grouped join per name; the '*' rows, at most one per
    schema, are joined on their own.
    """
    one = grants.groupBy("snapshot_id", "schema_name", "name").agg(F.min_by("permissions", F.to_json("permissions")).alias("permissions"))
    exact = one.where(F.col("name") != "*").withColumnsRenamed({"name": name, "permissions": "_exact"})
    star = one.where(F.col("name") == "*").select("snapshot_id", "schema_name", F.col("permissions").alias("_star"))
    return (
        objects.join(exact, ["snapshot_id", "schema_name", name], "left")
        .join(star, ["snapshot_id", "schema_name"], "left")
        .withColumn("permissions", F.coalesce("_exact", "_star", no_grant()))
        .drop("_exact", "_star")
    )


STORAGE_FIELDS = ("data_bytes", "index_bytes", "total_bytes", "row_estimate")


def attach_storage(tables: DataFrame, storage: DataFrame) -> DataFrame:
    """Add the storage columns of a table; zeros and no estimate when there is no row."""
    joined = tables.join(
        storage.select(*model.TABLE_KEY, *STORAGE_FIELDS), list(model.TABLE_KEY), "left"
    )
    zero = F.lit(0).cast("bigint")
    return joined.withColumns({c: F.coalesce(c, zero) for c in STORAGE_FIELDS[:3]})


def primary_key_flags(columns: DataFrame, primary_keys: DataFrame) -> DataFrame:
    """Add `is_primary_key` to flat columns; ``primary_keys`` holds one list per table."""
    keys = primary_keys.select(*model.TABLE_KEY, F.explode("constrained_columns").alias("column_name")).distinct()
    flagged = columns.join(
        keys.withColumn("is_primary_key", F.lit(True)), [*model.TABLE_KEY, "column_name"], "left"
    )
    return flagged.withColumn("is_primary_key", F.coalesce("is_primary_key", F.lit(False)))


# --- assembly ----------------------------------------------------------------------------------------------------
GROWTH = ("previous_total_bytes", "growth_bytes", "growth_percent")
_KEEP_NULLS = {"ignoreNullFields": "false"}

# Per facet: the column that names the owning object, and the fields of one item.
_FACETS = {
    "tables": ("table_name", "comment STRING"),
    "columns": ("table_name", model.LISTS["columns"]),
    "primary_keys": ("table_name", "constrained_columns ARRAY<STRING>, name STRING"),
    "foreign_keys": ("table_name", model.LISTS["foreign_keys"]),
    "indexes": ("table_name", model.LISTS["indexes"]),
    "unique_constraints": ("table_name", model.LISTS["unique_constraints"]),
    "storage": (
        "table_name",
        "data_bytes BIGINT, index_bytes BIGINT, total_bytes BIGINT, row_estimate BIGINT, "
        "previous_total_bytes BIGINT, growth_bytes BIGINT, growth_percent DOUBLE",
    ),
    "views": ("name", "definition STRING"),
    "routines": ("name", "name STRING, routine_type STRING, return_type STRING, arguments STRING, definition STRING"),
    "grants": ("name", f"permissions {model.PERMISSIONS}"),
}


def _facet_type(name: str) -> T.StructType:
    return T.StructType.fromDDL("ordinal BIGINT, " + _FACETS[name][1])


def facet_ddl(name: str) -> str:
    """Columns of the flat relation of a facet."""
    key = "snapshot_id BIGINT, schema_name STRING"
    return f"{key}, {_FACETS[name][0]} STRING, {_FACETS[name][1]}" if name in _FACETS else key


def _facet_rows(name: str, rows: DataFrame) -> DataFrame:
    """One facet as (snapshot_id, schema_name, object, <facet> STRUCT<ordinal, …>); missing fields are null."""
    fields = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in _facet_type(name).fields
    ]
    return rows.select("snapshot_id", "schema_name", F.col(_FACETS[name][0]).alias("object"), F.struct(*fields).alias(name))


def stored_rows(rows: DataFrame) -> DataFrame:
    """Rows with all columns of `model.STORED`: absent ones are null, `month` and `source_bucket` follow the header."""
    placed = rows.withColumns({
        "month": F.date_format("captured_at", "yyyyMM").cast("int"),
        "source_bucket": F.pmod("data_source_id", F.lit(model.SOURCE_BUCKETS)).cast("int"),
    })
    return placed.select(*[
        (F.col(f.name) if f.name in placed.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in T.StructType.fromDDL(model.STORED).fields
    ])


def assemble(headers: DataFrame, relations: dict[str, DataFrame]) -> DataFrame:
    """Flat catalogue rows -> the rows of the snapshot store.

    ``headers``: snapshot_id, data_source_id, run_id, captured_at, source, db_type, database, items, storage_growth
    and optionally skipped_schemas, storage_summary. ``relations``: flat rows keyed by (snapshot_id, schema_name,
    table_name | name); `schemas` lists the schemas, so that empty ones are kept.

    All facets of all objects go through one shuffle on (snapshot_id, schema_name, object) and one grouping. What holds
    for a whole snapshot or schema (header, '*' grants) is one narrow relation with a row for each snapshot, joined after it.
    """
    facets = [_facet_rows(name, rows) for name, rows in relations.items() if name in _FACETS]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facets)
    absent = {n: F.lit(None).cast(_facet_type(n)) for n in _FACETS if n not in rows.columns}
    rows = rows.withColumns(absent) if absent else rows
    lists = ("columns", "foreign_keys", "indexes", "unique_constraints", "routines")
    singles = ("tables", "primary_keys", "storage", "views", "grants")
    objects = rows.where("object <> '*'").groupBy("snapshot_id", "schema_name", "object").agg(
        *[F.sort_array(F.collect_list(n)).alias(n) for n in lists],
        *[F.first(n, ignorenulls=True).alias(n) for n in singles],
    )
    context = broadcast_if_small(written(_context(headers, relations.get("grants"))))
    star = F.try_element_at("stars", F.coalesce("schema_name", F.lit("")))
    granted = F.coalesce("grants.permissions", star, no_grant())
    kinds = F.array(_table(granted), _view(granted))
    found = (
        objects.join(context, "snapshot_id")
        .select("snapshot_id", "schema_name", *_HEADER, F.explode(F.concat(kinds, F.transform("routines", _routine))).alias("o"))
        .where("o IS NOT NULL").select("snapshot_id", "schema_name", *_HEADER, "o.*")
    )
    value = F.when(F.col("kind") == model.TABLE_KIND, table_json(growth=False)).when(F.col("kind") == model.VIEW_KIND, view_json()).otherwise(routine_json())
    found = stored_rows(found)
    return (
        found.withColumn("digest", object_digest(F.col("kind"), F.col("schema_name"), value))
        .unionByName(_schema_rows(headers, relations)).unionByName(_snapshot_rows(headers))
    )


_HEADER = ("data_source_id", "run_id", "captured_at")


def _context(headers: DataFrame, grants: DataFrame | None) -> DataFrame:
    """Per snapshot: header ids, whether storage was asked for, and the '*' grant of each schema as a map."""
    heads = headers.select("snapshot_id", *_HEADER, F.coalesce("storage_growth", F.lit(False)).alias("storage_growth"))
    empty = F.lit(None).cast(f"MAP<STRING, {model.PERMISSIONS}>")
    if grants is None:
        return heads.withColumn("stars", empty)
    one = grants.where("name = '*'").groupBy("snapshot_id", F.coalesce("schema_name", F.lit("")).alias("schema_name")).agg(
        F.min_by("permissions", F.to_json("permissions")).alias("permissions"))
    stars = one.groupBy("snapshot_id").agg(F.map_from_entries(F.collect_list(F.struct("schema_name", "permissions"))).alias("stars"))
    return heads.join(stars, "snapshot_id", "left")


def _inner(name: str) -> Column:
    return F.transform(name, lambda i: i.dropFields("ordinal"))


# Columns of an object row as the kinds fill them; `F.struct`s of different kinds have to be of one type.
_OBJECT = ("kind", "name", "comment", *model.LISTS, "primary_key", "permissions", "storage", "definition", "routine_type", "return_type", "arguments")


def _object(**given: Column) -> Column:
    types = {f.name: f.dataType for f in T.StructType.fromDDL(model.STORED).fields}
    return F.struct(*[given.get(c, F.lit(None)).cast(types[c]).alias(c) for c in _OBJECT])


def _table(granted: Column) -> Column:
    none = F.lit(None)
    zero = F.lit(0).cast("bigint")
    no_key = F.struct(F.array().cast("array<string>").alias("constrained_columns"), none.cast("string").alias("name"))
    no_storage = F.struct(
        *[zero.alias(c) for c in STORAGE_FIELDS[:3]], none.cast("bigint").alias("row_estimate"),
        none.cast("bigint").alias("previous_total_bytes"), none.cast("bigint").alias("growth_bytes"),
        none.cast("double").alias("growth_percent"),
    )
    return F.when(F.col("tables").isNotNull(), _object(
        kind=F.lit(model.TABLE_KIND), name=F.col("object"), comment=F.col("tables.comment"), **{n: _inner(n) for n in model.LISTS},
        primary_key=F.coalesce(F.col("primary_keys").dropFields("ordinal"), no_key), permissions=granted,
        storage=F.when(F.col("storage_growth"), F.coalesce(F.col("storage").dropFields("ordinal"), no_storage)),
    ))


def _view(granted: Column) -> Column:
    return F.when(F.col("views").isNotNull(), _object(
        kind=F.lit(model.VIEW_KIND), name=F.col("object"), definition=F.col("views.definition"), permissions=granted,
    ))


def _routine(r: Column) -> Column:
    return _object(kind=F.lit(model.ROUTINE_KIND), **{f: r[f] for f in ("name", "routine_type", "return_type", "arguments", "definition")})


def _schema_rows(headers: DataFrame, relations: dict[str, DataFrame]) -> DataFrame:
    """Listed schemas and those of tables, views and routines. A grant or a size alone does not make a schema appear."""
    named = [relations[r].select("snapshot_id", "schema_name") for r in ("schemas", "tables", "views", "routines") if r in relations]
    names = reduce(DataFrame.unionAll, named).where("schema_name IS NOT NULL").distinct()
    heads = broadcast_if_small(headers.select("snapshot_id", *_HEADER))
    rows = names.join(heads, "snapshot_id").withColumns({"kind": F.lit(model.SCHEMA), "name": F.col("schema_name")})
    return stored_rows(rows).withColumn("digest", F.sha2("schema_name", 256))


def _snapshot_rows(headers: DataFrame) -> DataFrame:
    empty = F.array().cast(model.SKIPPED)
    skipped = F.coalesce(F.col("skipped_schemas"), empty) if "skipped_schemas" in headers.columns else empty
    rows = stored_rows(headers.withColumn("kind", F.lit(model.SNAPSHOT)).withColumn("skipped_schemas", skipped))
    return rows.withColumn("digest", snapshot_digest())


# --- canonical values and digests ----------------------------------------------------------------------------------
def _json(*fields: str | Column) -> Column:
    return F.to_json(F.struct(*fields), _KEEP_NULLS)


def _sorted_struct(value: Column, kind: T.StructType, without: tuple[str, ...] = ()) -> Column:
    """``value`` with its fields in the order of their names: printed so, JSON is canonical and needs no parsing."""
    fields = F.struct(*[value[n].alias(n) for n in sorted(kind.fieldNames()) if n not in without])
    return F.when(value.isNotNull(), fields)


def _sorted_items(listed: str) -> Column:
    kind = _typed(listed).elementType
    return F.transform(listed, lambda i: _sorted_struct(i, kind))


def _canonical_number(value: Column) -> Column:
    """A number as canonical JSON prints it: 100.0 is 100."""
    listed = F.to_json(F.array(value))
    return F.try_parse_json(F.substring(listed, F.lit(2), F.length(listed) - F.lit(2)))


def _typed(name: str) -> T.DataType:
    return T.StructType.fromDDL(model.STORED)[name].dataType


def table_json(growth: bool = True, without: tuple[str, ...] = ()) -> Column:
    """Canonical JSON of a typed table; growth follows from other snapshots and can be left out."""
    storage = F.col("storage")
    if growth:
        storage = storage.withField("growth_percent", _canonical_number(F.col("storage.growth_percent")))
    fields = {
        "name": F.col("name"), "comment": F.col("comment"),
        **{n: _sorted_items(n) for n in model.LISTS},
        "primary_key": _sorted_struct(F.col("primary_key"), _typed("primary_key")),
        "permissions": _sorted_struct(F.col("permissions"), _typed("permissions")),
        "storage": _sorted_struct(storage, _typed("storage"), () if growth else GROWTH),
    }
    return _json(*[fields[f].alias(f) for f in sorted(fields) if f not in without])


def view_json() -> Column:
    return _json("definition", "name", _sorted_struct(F.col("permissions"), _typed("permissions")).alias("permissions"))


def routine_json() -> Column:
    return _json("arguments", "definition", "name", "return_type", "routine_type")


def column_json(item: Column) -> Column:
    return _json(*[item[f].alias(f) for f in ("comment", "default", "name", "nullable", "type")])


def index_json(item: Column) -> Column:
    return _json(*[item[f].alias(f) for f in ("column_names", "name", "unique")])


def object_digest(kind: Column, schema: Column, value: Column) -> Column:
    return F.sha2(F.to_json(F.array(kind, schema, value)), 256)


def snapshot_digest() -> Column:
    options = F.struct("items", "storage_growth").alias("collection_options")
    return F.sha2(_json("source", "db_type", "database", options, "skipped_schemas"), 256)


def digest_tree(stored: DataFrame, *level: str) -> DataFrame:
    """Digest sums of ``level`` (columns that begin with snapshot_id): `w0` … `w7` and the number of `objects`.

    A digest counts as eight 32-bit numbers. Sums do not depend on any order, sums of a schema's objects add up to those
    of its snapshot, and they are partial aggregates: nothing is gathered. Only ids and digests are read.
    """
    word = lambda k: F.conv(F.substring("digest", k * 8 + 1, 8), 16, 10).cast("bigint")
    objects = stored.where(F.col("kind").isin(model.TABLE_KIND, model.VIEW_KIND, model.ROUTINE_KIND))
    return objects.groupBy("snapshot_id", *level).agg(*[F.sum(word(k)).alias(f"w{k}") for k in range(DIGEST_WORDS)], F.count("*").alias("objects"))


def fingerprints(stored: DataFrame) -> DataFrame:
    """One fingerprint per snapshot: SHA-256 of its header facts and the summed digests of its objects and schemas."""
    word = lambda k: F.conv(F.substring("digest", k * 8 + 1, 8), 16, 10).cast("bigint")
    of = lambda kinds, k: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), word(k))), F.lit(0))
    groups = ((model.SCHEMA,), (model.TABLE_KIND, model.VIEW_KIND, model.ROUTINE_KIND))
    words = [of(kinds, k).alias(f"{kinds[0]}_{k}") for kinds in groups for k in range(DIGEST_WORDS)]
    whole = stored.groupBy("snapshot_id").agg(F.max(F.when(F.col("kind") == model.SNAPSHOT, F.col("digest"))).alias("_head"), *words)
    printed = [F.format_string("%x", f"{kinds[0]}_{k}") for kinds in groups for k in range(DIGEST_WORDS)]
    return whole.where("_head IS NOT NULL").select("snapshot_id", F.sha2(F.concat_ws(",", "_head", *printed), 256).alias("fingerprint"))
