"""The given tables read as schema-metadata history.

nation = data source, nation x order year = snapshot, market segment = schema, customer = table, order priority =
column, order status = index, order totals in cents = data bytes. Events are runs and log lines; customers also serve
as registered connections, as import rows and as grants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .. import model
from ..functions.values import grant_value
from ..session import written

TABLE = ["data_source_id", "yr", "snapshot_id", "captured_on", "schema_name", "table_name"]


# Columns read from the given tables; a stated schema saves a file read per use.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
        "o_orderpriority STRING"
    ),
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def _pick(number: Column, values: tuple[str, ...]) -> Column:
    """values[number % len(values)]"""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


# --- sources, snapshots and their relations ----------------------------------------------------------------------
def sources(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    key = F.col("n_nationkey")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        key.cast("bigint").alias("id"), F.col("n_name").alias("name"), _pick(key, model.DB_TYPES).alias("db_type"),
        F.concat(F.lower("n_name"), F.lit(".db.example")).alias("host"), F.col("r_name").alias("database_name"),
        _pick(key, ("connected", "failed", "unchecked")).alias("status"),
    )


def _ordered(spark: SparkSession, sf: str, *order_columns: str) -> DataFrame:
    """Orders with their customer: the base of all snapshot relations."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", *order_columns)
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_name")
    year = F.year("o_orderdate")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("c_nationkey").cast("bigint").alias("data_source_id"), year.cast("int").alias("yr"),
        (F.col("c_nationkey").cast("bigint") * 10000 + year.cast("bigint")).alias("snapshot_id"),
        F.col("c_mktsegment").alias("schema_name"), F.col("c_name").alias("table_name"), *order_columns,
    )


def columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = _ordered(spark, sf, "o_orderpriority", "o_totalprice")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    grouped = rows.groupBy(
        "data_source_id", "yr", "snapshot_id", "schema_name", "table_name", F.col("o_orderpriority").alias("column_name")
    ).agg(F.count("*").alias("_n"), F.sum(cents).alias("data_bytes"))
    return grouped.select(
        "data_source_id", "yr", "snapshot_id", F.make_date("yr", F.lit(12), F.lit(31)).alias("captured_on"),
        "schema_name", "table_name", "column_name",
        F.concat(F.lit("decimal("), _text(F.col("_n")), F.lit(")")).alias("data_type"),
        (F.col("_n") > 1).alias("nullable"), "data_bytes",
    )


def _columns(spark: SparkSession, sf: str, base: DataFrame | None) -> DataFrame:
    return columns(spark, sf) if base is None else base


def tables(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """``base``: the column relation, if it is at hand already; likewise below."""
    grouped = _columns(spark, sf, base).groupBy(*TABLE).agg(
        F.count("*").alias("column_count"), F.sum("data_bytes").alias("data_bytes")
    )
    index_bytes = F.col("column_count") * 8192
    return grouped.select(
        *TABLE, "column_count", "data_bytes", index_bytes.alias("index_bytes"),
        (F.col("data_bytes") + index_bytes).alias("total_bytes"),
        F.when(F.col("column_count") > 1, F.col("column_count")).alias("row_estimate"),
    )


def snapshots(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """One row per source and year. Without ``base`` it reads the two order columns it needs, not the column relation."""
    rows = (_ordered(spark, sf) if base is None else base).select("snapshot_id", "data_source_id", "yr").distinct()
    return rows.select(
        F.col("snapshot_id").alias("id"), "data_source_id", (F.col("snapshot_id") + 10).alias("run_id"),
        F.make_date("yr", F.lit(12), F.lit(31)).alias("captured_on"), "yr",
    )


def indexes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _ordered(spark, sf, "o_orderstatus", "o_orderpriority")
    return (
        rows.groupBy("snapshot_id", "schema_name", "table_name", "o_orderstatus")
        .agg(
            F.count("*").alias("_n"), F.min("o_orderpriority").alias("first_column"),
            F.countDistinct("o_orderpriority").alias("column_count"),
        )
        .select(
            "snapshot_id", "schema_name", "table_name",
            F.concat(F.lit("ix_"), F.lower("o_orderstatus")).alias("index_name"), (F.col("_n") == 1).alias("is_unique"),
            "first_column", "column_count",
        )
    )


def views(spark: SparkSession, sf: str, prefix: str = "v_", base: DataFrame | None = None) -> DataFrame:
    """Views; with another prefix the same rows serve as routines."""
    first = F.substring("column_name", 1, 1)
    return (
        _columns(spark, sf, base).groupBy("snapshot_id", "schema_name", first.alias("_first"))
        .agg(F.min("table_name").alias("_table"))
        .select(
            "snapshot_id", "schema_name", F.concat(F.lit(prefix), "_first").alias("name"),
            F.concat(F.lit("SELECT * FROM "), "_table").alias("definition"),
        )
    )


def routine_lines(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    first = F.substring("column_name", 1, 1)
    line = F.row_number().over(W.partitionBy("snapshot_id", "schema_name", first).orderBy("table_name"))
    return _columns(spark, sf, base).select(
        "snapshot_id", "schema_name", F.concat(F.lit("p_"), first).alias("routine_name"),
        line.cast("bigint").alias("line"), F.concat(F.lit("line "), "table_name").alias("text"),
    )


def granted_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables with a SELECT grant; a missing row means 'not collected'."""
    return table(spark, sf, "customer").where("c_acctbal > 0").select(
        F.col("c_nationkey").cast("bigint").alias("data_source_id"), F.col("c_mktsegment").alias("schema_name"),
        F.col("c_name").alias("table_name"),
    )


def primary_keys(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """First column of every table that has more than one."""
    return (
        _columns(spark, sf, base).groupBy("snapshot_id", "schema_name", "table_name")
        .agg(F.count("*").alias("_n"), F.min("column_name").alias("_first"))
        .where("_n > 1")
        .select("snapshot_id", "schema_name", "table_name", F.array("_first").alias("constrained_columns"),
                F.lit(None).cast("string").alias("name"))
    )


def foreign_keys(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """A key on every column whose bytes divide by three; its second referred column is unknown."""
    first = F.substring("column_name", 1, 1)
    return _columns(spark, sf, base).where("data_bytes % 3 = 0").select(
        "snapshot_id", "schema_name", "table_name", F.concat(F.lit("fk_"), first).alias("name"),
        F.array("column_name").alias("constrained_columns"), F.col("schema_name").alias("referred_schema"),
        F.concat(F.lit("ref_"), first).alias("referred_table"),
        F.array(F.col("column_name"), F.lit(None).cast("string")).alias("referred_columns"),
    )


def grants(spark: SparkSession, sf: str, base: DataFrame | None = None, listed: DataFrame | None = None) -> DataFrame:
    """Grants as (snapshot_id, schema_name, name, permissions): tables by name, one schema by wildcard.

    ``listed``: the table relation, if it is at hand already.
    """
    exact = (tables(spark, sf, base) if listed is None else listed).join(granted_tables(spark, sf), ["data_source_id", "schema_name", "table_name"], "left_semi")
    named = exact.select("snapshot_id", "schema_name", F.col("table_name").alias("name"),
                         grant_value(F.lit("reader")).alias("permissions"))
    star = snapshots(spark, sf, base).select(F.col("id").alias("snapshot_id"), F.lit("MACHINERY").alias("schema_name"),
                                       F.lit("*").alias("name"), grant_value(F.lit("")).alias("permissions"))
    return named.unionByName(star)


def headers(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    s = sources(spark, sf).select(F.col("id").alias("data_source_id"), F.col("name").alias("source"), "db_type",
                                  F.col("database_name").alias("database"))
    items = F.array_sort(F.array(*[F.lit(i) for i in model.DEFAULT_ITEMS]))
    return snapshots(spark, sf, base).join(s, "data_source_id").select(
        F.col("id").alias("snapshot_id"), "data_source_id", "run_id",
        F.col("captured_on").cast("timestamp_ntz").alias("captured_at"), "source", "db_type", "database",
        items.alias("items"), F.lit(True).alias("storage_growth"),
    )


def relations(spark: SparkSession, sf: str, base: DataFrame | None = None) -> dict[str, DataFrame]:
    """All flat relations of all snapshots, as `assemble` takes them. With ``base`` the table relation is written once."""
    t = tables(spark, sf) if base is None else written(tables(spark, sf, base))
    return {
        "schemas": t.select("snapshot_id", "schema_name").distinct(),
        "tables": t.select("snapshot_id", "schema_name", "table_name",
                           F.concat(F.lit("about "), "table_name").alias("comment")),
        "columns": _columns(spark, sf, base).select(
            "snapshot_id", "schema_name", "table_name", F.col("column_name").alias("name"),
            F.col("data_type").alias("type"), "nullable",
        ),
        "primary_keys": primary_keys(spark, sf, base),
        "foreign_keys": foreign_keys(spark, sf, base),
        "indexes": indexes(spark, sf).select(
            "snapshot_id", "schema_name", "table_name", F.col("index_name").alias("name"),
            F.array(F.col("first_column"), F.when(F.col("column_count") > 1, F.lit("…"))).alias("column_names"),
            F.col("is_unique").alias("unique"),
        ),
        "storage": t.drop("data_source_id", "yr", "captured_on", "column_count"),
        "views": views(spark, sf, base=base),
        "routines": views(spark, sf, "p_", base).withColumn("routine_type", F.lit("PROCEDURE")),
        "grants": grants(spark, sf, base, t),
    }


# --- registered entities -----------------------------------------------------------------------------------------
def connections(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as registered connections; some kinds are unknown, some ports and hosts missing."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("id"), F.col("c_name").alias("name"), _pick(key, (*model.DB_TYPES, "access")).alias("db_type"),
        F.when(key % 11 != 0, F.concat(F.lower("c_mktsegment"), F.lit(".db.example"))).alias("host"),
        F.when(key % 4 != 0, (key % 9000 + 1000).cast("int")).alias("port"),
        F.concat(F.lit("DB_"), _text(F.col("c_nationkey"))).alias("database"),
        F.when(key % 3 == 0, "").otherwise("reader").alias("username"),
        F.when(key % 5 == 0, "").when(key % 5 == 1, None).otherwise(F.concat(F.lit("pw"), _text(key))).alias("password"),
        F.when(key % 7 == 0, F.concat(F.lit("key"), _text(key))).alias("ssh_private_key"),
        (key % 6 == 0).alias("ssh_enabled"), (key % 9 == 0).alias("ssh_nested_enabled"),
        (key % 2 == 0).alias("ssl_enabled"),
        F.when(key % 8 == 0, F.concat(F.lit("ca"), _text(key))).alias("ssl_ca_cert"),
        _pick(key, ("connected", "failed", "unchecked")).alias("status"), F.col("c_acctbal").alias("val"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.col("ts").alias("started_at"),
        F.when(kind == "error", "failed").when(kind == "signup", "running").otherwise("success").alias("status"),
        F.floor("value").cast("bigint").alias("object_count"),
        F.when(kind == "error", F.col("props")).alias("error_message"),
    )


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("id")
    ids = table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    return ids.select(
        "id", F.concat(F.lit("job "), _text(key)).alias("name"),
        F.when(key % 7 == 0, key + 1000).otherwise(key % 25).alias("data_source_id"),
        _pick(key, model.SCHEDULE_TYPES).alias("schedule_type"),
        F.when((key % 3 == 1) & (key % 2 == 0), key.cast("int")).alias("interval_minutes"),
        (key % 4 != 0).alias("is_active"),
    )


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as log lines of the run named by the user id, not yet numbered."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"),
        F.col("event_type").alias("step"), F.col("props").alias("message"),
    )


def user_roles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.concat(F.lit("role_"), "o_orderstatus").alias("role_name")
    ).distinct()


def role_permissions(spark: SparkSession, sf: str) -> DataFrame:
    first, status = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
    code = F.when((status == "P") & (first == "1"), model.ADMIN_CODE).otherwise(F.concat(F.lit("perm:"), first))
    return (
        table(spark, sf, "orders")
        .where((status == "P") | ((F.ascii(first) + F.ascii(status)) % 2 == 0))
        .select(F.concat(F.lit("role_"), status).alias("role_name"), code.alias("code"))
        .distinct()
    )


def role_menus(spark: SparkSession, sf: str) -> DataFrame:
    """Menus of a role: the order years' last digit, so roles share menus."""
    return table(spark, sf, "orders").where("o_totalprice > 400000").select(
        F.concat(F.lit("role_"), "o_orderstatus").alias("role_name"),
        F.concat(F.lit("menu_"), (F.year("o_orderdate") % 10).cast("string")).alias("menu_code"),
    ).distinct()


def stored_names(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    name = F.concat(F.lit("name "), _text(F.col("c_custkey")))
    plain = c.where("c_custkey % 2 = 0").select(name.alias("name"), F.col("c_acctbal").alias("val"))
    taken = c.where("c_custkey % 12 = 0").select(F.concat(name, F.lit(" (2)")).alias("name"), F.col("c_acctbal").alias("val"))
    return plain.unionAll(taken)


def incoming_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    name = F.concat(F.lit("name "), _text(F.col("c_custkey")))
    first = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("row_no"), name.alias("name"),
                                                (F.col("c_acctbal") + 1).alias("val"))
    again = c.where("c_custkey % 9 = 0").select((F.col("c_custkey") * 2 + 1).alias("row_no"), name.alias("name"),
                                                (F.col("c_acctbal") + 2).alias("val"))
    return first.unionAll(again)
