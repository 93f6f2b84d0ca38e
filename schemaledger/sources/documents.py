"""Snapshots as JSON documents: read into the store's rows, and written from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import model
from ..functions import text
from ..functions.values import canonical_json
from ..operators import collect

_HEADER = list(model.HEADER_COLUMNS)
_NAMES = {model.TABLE_KIND: "tables", model.VIEW_KIND: "views", model.ROUTINE_KIND: "procedures"}
_PERMISSIONS = f"permissions {model.PERMISSIONS}"


def _read(kind: str) -> tuple[str, dict[str, Column]]:
    """Fields to parse from one object of ``kind``, and the stored columns that follow from them (of struct `t`)."""
    t = lambda name: F.col(f"t.{name}")
    plain = lambda *names: {n: t(n) for n in names}
    if kind == model.TABLE_KIND:
        lists = {n: d.replace("BOOLEAN", "STRING") for n, d in model.LISTS.items()}
        fields = ", ".join(
            f"{n} ARRAY<STRUCT<{', '.join(f.strip().replace(' ', ': ', 1) for f in d.split(','))}>>" for n, d in lists.items())
        flag = lambda name, field: F.transform(t(name), lambda i: i.withField(field, i[field].try_cast("boolean")))
        given = plain("comment", *model.LISTS, "primary_key", "permissions", "storage")
        given |= {"columns": flag("columns", "nullable"), "indexes": flag("indexes", "unique")}
        return f"name STRING, comment STRING, {fields}, primary_key {model.PRIMARY_KEY}, {_PERMISSIONS}, storage {model.STORAGE}", given
    if kind == model.VIEW_KIND:
        return f"name STRING, definition STRING, {_PERMISSIONS}", plain("definition", "permissions")
    # Older documents name the type `type` and the text `body`.
    return "name STRING, routine_type STRING, type STRING, return_type STRING, arguments STRING, definition STRING, body STRING", {
        "routine_type": text.first_text(t("routine_type"), t("type")), "definition": text.first_text(t("definition"), t("body")),
        **plain("return_type", "arguments"),
    }


def from_documents(documents: DataFrame) -> DataFrame:
    """Rows of the store from documents: snapshot_id, data_source_id, run_id, captured_at, payload (JSON text).

    Objects with other keys or forms than the typed ones keep their text in `raw`, so that nothing of them is lost.
    Documents that are no JSON give a snapshot without objects.
    """
    tree = F.from_json("payload", (
        "source STRING, db_type STRING, database STRING, collection_options STRUCT<items: ARRAY<STRING>, storage_growth: BOOLEAN>, "
        f"skipped_schemas {model.SKIPPED}, storage_summary {model.STORAGE_SUMMARY}"))
    heads = documents.select(*_HEADER, tree.alias("t")).select(
        F.lit(model.SNAPSHOT).alias("kind"), *_HEADER, *[F.col(f"t.{c}").alias(c) for c in ("source", "db_type", "database", "skipped_schemas", "storage_summary")],
        F.col("t.collection_options.items").alias("items"), F.col("t.collection_options.storage_growth").alias("storage_growth"))
    heads = collect.stored_rows(heads).withColumn("digest", collect.snapshot_digest())

    listed = F.from_json("payload", f"schemas ARRAY<STRUCT<name: STRING, {', '.join(f'{n}: ARRAY<VARIANT>' for n in _NAMES.values())}>>")
    schemas = documents.select(*_HEADER, F.posexplode(listed["schemas"]).alias("_place", "s")).where("s IS NOT NULL")
    named = schemas.select(F.lit(model.SCHEMA).alias("kind"), *_HEADER, F.col("s.name").alias("schema_name"), F.col("s.name").alias("name")).distinct()
    rows = [heads, collect.stored_rows(named).withColumn("digest", F.sha2(F.coalesce("schema_name", F.lit("")), 256))]
    values = {model.TABLE_KIND: collect.table_json(), model.VIEW_KIND: collect.view_json(), model.ROUTINE_KIND: collect.routine_json()}
    for kind, item in _NAMES.items():
        fields, given = _read(kind)
        place = F.shiftleft(F.col("_place").cast("bigint"), 32)
        found = schemas.select(*_HEADER, F.col("s.name").alias("schema_name"), place.alias("_before"), F.posexplode(f"s.{item}").alias("_at", "_object"))
        found = found.withColumn("_text", F.to_json("_object")).withColumn("t", F.from_json("_text", fields))
        typed = collect.stored_rows(found.select(
            F.lit(kind).alias("kind"), *_HEADER, "schema_name", F.col("t.name").alias("name"), (F.col("_before") + F.col("_at")).alias("position"),
            F.col("_text").alias("raw"), *[c.alias(n) for n, c in given.items()]))
        digest = collect.object_digest(F.col("kind"), F.col("schema_name"), F.coalesce("raw", values[kind]))
        rows.append(typed.withColumn("raw", F.when(~F.col("raw").eqNullSafe(canonical_json(values[kind])), F.col("raw"))).withColumn("digest", digest))
    return reduce(DataFrame.unionByName, rows)


def to_documents(stored: DataFrame) -> DataFrame:
    """One JSON document for each snapshot: header columns and `payload`. A document holds its whole snapshot, so choose first."""
    value = F.coalesce("raw", F.when(F.col("kind") == model.TABLE_KIND, collect.table_json()).when(F.col("kind") == model.VIEW_KIND, collect.view_json()).otherwise(collect.routine_json()))
    objects = stored.where(F.col("kind") != model.SNAPSHOT).withColumn("_value", value)
    listed = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("position", "name", "_value")))), lambda o: o["_value"])
    schemas = objects.groupBy("snapshot_id", "schema_name").agg(*[listed(kind).alias(item) for kind, item in _NAMES.items()])
    as_list = lambda items: F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    name = F.when(F.col("schema_name").isNull(), F.lit("null")).otherwise(F.regexp_replace(F.to_json(F.array("schema_name")), r"^\[|\]$", ""))
    schema = F.concat(F.lit('{"name":'), name, *[part for item in _NAMES.values() for part in (F.lit(f',"{item}":'), as_list(F.col(item)))], F.lit("}"))
    whole = schemas.groupBy("snapshot_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("schema_name", schema.alias("text")))), lambda s: s["text"]).alias("_schemas"))
    head = F.to_json(F.struct("source", "db_type", "database", F.struct("items", "storage_growth").alias("collection_options"), "skipped_schemas", "storage_summary"), {"ignoreNullFields": "false"})
    heads = stored.where(F.col("kind") == model.SNAPSHOT).select(*_HEADER, head.alias("_head"))
    payload = F.concat(F.regexp_replace("_head", r"\}$", ""), F.lit(',"schemas":'), as_list(F.coalesce("_schemas", F.array().cast("array<string>"))), F.lit("}"))
    return heads.join(whole, "snapshot_id", "left").select(*_HEADER, payload.alias("payload"))
