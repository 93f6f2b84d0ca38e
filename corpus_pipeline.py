"""Corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, tokens.

Each stage reads what its predecessor kept and returns the columns of documents; the last one returns the tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from schemaledger.llm.byte_bpe import byte_bpe
from schemaledger.llm.decontaminate import find_leaks
from schemaledger.llm.language_id import UNKNOWN, identify, learned
from schemaledger.llm.line_dedup import dedup_lines
from schemaledger.llm.ngram_join import ngram_jaccard_components
from schemaledger.llm.registered import vocabulary
from schemaledger.session import written

LEAST_SCORE = 0.5  # below, no language has the majority of a text's positions


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those without a language of at least half the probability, go."""
    found = identify(docs, learned(docs))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that loses all of its lines goes with them. ``n_chars`` follows the text."""
    found = dedup_lines(docs).where((F.col("n_dropped") == 0) | (F.col("text") != ""))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that of the smallest doc_id (nulls last), ties to the smaller row key.

    Rows of one doc_id and one text are copies as well, and one of them stays. Rows without words link with nothing and
    all stay. An empty table gives no rows.
    """
    found = written(ngram_jaccard_components(docs).where("component IS NOT NULL").groupBy("component", "doc_id", "row_key").agg(F.count("*").alias("held")))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row_key")
    first = found.groupBy("component").agg(F.min(order).alias("first")).select("component", F.col("first.row_key").alias("row_key"))
    copies = found.join(first, ["component", "row_key"], "left_anti").select("row_key").distinct()
    repeated = found.join(first, ["component", "row_key"], "left_semi").where("held > 1").select("row_key")
    kept = docs.withColumn("_key", F.xxhash64("doc_id", "text")).join(copies.withColumnRenamed("row_key", "_key"), "_key", "left_anti")
    more = repeated.withColumnRenamed("row_key", "_key")
    return kept.join(more, "_key", "left_anti").unionByName(kept.join(more, "_key", "left_semi").dropDuplicates(["_key"])).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("leaks") == 0).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document as little-endian unsigned 32-bit integers, with digests of ids and decoded bytes."""
    found = byte_bpe(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]
# A trained network takes the first decision, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
