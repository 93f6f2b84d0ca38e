"""Index for substring search over 'schema.name': postings of three letters, texts, and the objects that bear them.

Each distinct lower-cased text is indexed once, however many snapshots hold it. A search reads the postings of its own
three-letter runs only, keeps texts that hold all of them, compares these with the query, and reads the objects in the
folders of the texts found. Queries below three letters have no such run; they compare every distinct text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import broadcast_if_small, written

GRAM = 3
GRAM_FOLDERS, TEXT_FOLDERS = 64, 16


def searched_text() -> Column:
    """'schema.name' in lower case; null parts are empty."""
    return F.lower(F.concat_ws(".", F.coalesce("schema_name", F.lit("")), F.coalesce("name", F.lit(""))))


def grams(text: Column) -> Column:
    """Distinct runs of three letters; a shorter or null text has none."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM)))
    return F.when(F.length(text) >= GRAM, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _folder(value: Column | str, folders: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(folders)).cast("int")


def write_name_index(objects: DataFrame, path: str) -> None:
    """Index of ``objects`` (schema_name, name and more) below ``path``. Repeated rows stay; a name's postings are one each."""
    named = objects.withColumn("text", searched_text()).withColumn("text_folder", _folder("text", TEXT_FOLDERS))
    named.repartition("text_folder", "text").write.partitionBy("text_folder").parquet(f"{path}/objects")
    objects.limit(0).write.parquet(f"{path}/columns")  # an empty index has no other file that tells them
    texts = written(named.select("text").distinct())
    texts.write.parquet(f"{path}/texts")
    postings = texts.select(F.explode(grams(F.col("text"))).alias("gram"), "text").withColumn("gram_folder", _folder("gram", GRAM_FOLDERS))
    # A run of letters that many names share is spread over tasks by its texts, inside its folder.
    spread = postings.repartition("gram_folder", F.pmod(F.xxhash64("text"), F.lit(8)))
    spread.sortWithinPartitions("gram_folder", "gram", "text").write.partitionBy("gram_folder").parquet(f"{path}/postings")


def matching_texts(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Distinct indexed texts that hold the trimmed query, in any case."""
    needle = F.lower(F.lit(query.strip()))
    runs = grams(needle)
    asked = spark.sql("SELECT 1").select(runs.alias("grams"), F.transform(runs, lambda g: _folder(g, GRAM_FOLDERS)).alias("folders")).first()
    if not asked["grams"]:
        return spark.read.parquet(f"{path}/texts").where(F.contains(F.col("text"), needle))
    postings = spark.read.schema("gram STRING, text STRING, gram_folder INT").parquet(f"{path}/postings")
    read = postings.where(F.col("gram_folder").isin(sorted(set(asked["folders"]))) & F.col("gram").isin(asked["grams"]))
    held = read.groupBy("text").agg(F.count("*").alias("_held")).where(F.col("_held") == len(asked["grams"]))
    return held.select("text").where(F.contains(F.col("text"), needle))


def search_index(spark: SparkSession, path: str, query: str, schema_name: str | None = None) -> DataFrame:
    """The indexed objects whose 'schema.name' holds the trimmed query: the rows of `search.search_objects`.

    An empty query finds all objects; none found gives no rows.
    """
    texts = matching_texts(spark, path, query).withColumn("text_folder", _folder("text", TEXT_FOLDERS))
    columns = spark.read.parquet(f"{path}/columns").schema
    objects = spark.read.schema(columns.add("text", "string").add("text_folder", "integer")).parquet(f"{path}/objects")
    if schema_name:
        objects = objects.where(F.col("schema_name") == schema_name)
    return objects.join(broadcast_if_small(texts), ["text_folder", "text"], "left_semi").drop("text_folder", "text")
