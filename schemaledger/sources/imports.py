"""Import files: JSON or YAML lists of connection or job rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import model

_BOM = "﻿"


def _yaml_as_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """YAML texts -> JSON texts, one Arrow batch of files at a time; null where a text is not YAML."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def convert(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(yaml.load(text, Loader=loader), default=str)
        except yaml.YAMLError:
            return None

    for batch in batches:
        yield batch.assign(text=batch["text"].map(convert))


def _listed(document: Column, key: str) -> Column:
    """The array itself, or the array below the key of an object."""
    items = "array<map<string,variant>>"
    return F.coalesce(F.try_variant_get(document, "$", items), F.try_variant_get(document, f"$.{key}", items))


def read_import_files(spark: SparkSession, path: str, key: str, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (file, row_no, item MAP<STRING,VARIANT>) and errors (file, error) of the files below ``path``.

    A size limit, if given, is a filter on file metadata, so the content of larger files is not read.
    """
    files = spark.read.format("binaryFile").load(path)
    fits = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    large = files.where(~fits).select(F.col("path").alias("file"), F.lit(f"larger than {max_bytes} bytes").alias("error"))

    text = F.try_validate_utf8(F.col("content").cast("string"))
    clean = F.when(F.startswith(text, F.lit(_BOM)), F.substring(text, F.lit(2), F.length(text))).otherwise(text)
    texts = files.where(fits).select(F.col("path").alias("file"), clean.alias("text"))
    is_json = F.lower("file").endswith(".json")
    documents = texts.where(is_json).unionAll(texts.where(~is_json).mapInPandas(_yaml_as_json, texts.schema))
    parsed = documents.select("file", F.try_parse_json("text").alias("_document"))
    items = parsed.select("file", F.col("_document").isNull().alias("_unreadable"), _listed(F.col("_document"), key).alias("_items"))

    empty = F.coalesce(F.size("_items"), F.lit(0)) < 1
    reason = F.when(F.col("_unreadable"), "not UTF-8 JSON or YAML").when(empty, f"a top-level list '{key}' is needed")
    errors = items.select("file", reason.alias("error")).where(F.col("error").isNotNull())
    rows = items.where(~F.col("_unreadable")).select("file", F.posexplode("_items").alias("_pos", "item"))
    numbered = rows.select("file", (F.col("_pos") + 1).cast("bigint").alias("row_no"), "item")
    return numbered, errors.unionByName(large)


def fields(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Typed columns of the import items; a value of another type becomes null."""
    typed = [F.try_variant_get(F.try_element_at("item", F.lit(n)), "$", t).alias(n) for n, t in types.items()]
    return rows.select("file", "row_no", *typed)
