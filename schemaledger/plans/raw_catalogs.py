"""Raw catalogue extracts of each dialect, derived from the given tables: inputs of the normalisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import driver_tables as p1


def _object_id() -> Column:
    return F.concat_ws(".", "schema_name", "table_name")


def _tables(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """``base``: the column relation, if it is at hand already; ``indexes`` below: the index relation."""
    return p1.tables(spark, sf, base)


def _indexes(spark: SparkSession, sf: str, indexes: DataFrame | None) -> DataFrame:
    return p1.indexes(spark, sf) if indexes is None else indexes


def _namespaces(spark: SparkSession, sf: str, key: str, name: str, base: DataFrame | None) -> DataFrame:
    return p1.tables(spark, sf, base).select("snapshot_id", F.col("schema_name").alias(key), F.col("schema_name").alias(name)).distinct()


def pg_namespace(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    return _namespaces(spark, sf, "oid", "nspname", base)


def pg_class(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    kind = F.element_at(F.array(F.lit("r"), F.lit("p"), F.lit("i")), (F.col("column_count") % 3 + 1).cast("int"))
    return _tables(spark, sf, base).select(
        "snapshot_id", _object_id().alias("oid"), F.col("table_name").alias("relname"),
        F.col("schema_name").alias("relnamespace"), kind.alias("relkind"),
        F.col("row_estimate").cast("double").alias("reltuples"), "data_bytes", "index_bytes", "total_bytes",
    )


def information_schema_tables(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    return _tables(spark, sf, base).select(
        "snapshot_id", F.col("schema_name").alias("table_schema"), "table_name",
        F.when(F.col("column_count") % 4 != 0, "BASE TABLE").otherwise("VIEW").alias("table_type"),
        F.col("data_bytes").alias("data_length"),
        F.when(F.col("row_estimate").isNotNull(), F.col("index_bytes")).alias("index_length"),
        F.col("row_estimate").alias("table_rows"),
    )


def partition_stats(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    pages = F.floor(F.col("data_bytes") / 8192)
    return (p1.columns(spark, sf) if base is None else base).select(
        "snapshot_id", _object_id().alias("object_id"), F.floor(pages / 2).alias("in_row_data_page_count"),
        F.floor(pages / 4).alias("lob_used_page_count"), F.lit(1).cast("bigint").alias("row_overflow_used_page_count"),
        (pages + 5).alias("used_page_count"), (pages + 7).alias("reserved_page_count"), F.lit(1).cast("bigint").alias("row_count"),
    )


def sys_tables(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    return _tables(spark, sf, base).select(
        "snapshot_id", _object_id().alias("object_id"), F.col("schema_name").alias("schema_id"), F.col("table_name").alias("name")
    )


def sys_schemas(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    return _namespaces(spark, sf, "schema_id", "name", base)


def all_tables(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    return _tables(spark, sf, base).select("snapshot_id", F.col("schema_name").alias("owner"), "table_name", F.col("row_estimate").alias("num_rows"))


def all_segments(spark: SparkSession, sf: str, base: DataFrame | None = None, indexes: DataFrame | None = None) -> DataFrame:
    even = _tables(spark, sf, base).where("column_count % 2 = 0")
    kinds = F.array(
        F.struct(F.lit("TABLE").alias("segment_type"), F.floor(F.col("data_bytes") / 2).alias("bytes")),
        F.struct(F.lit("TABLE PARTITION").alias("segment_type"), F.lit(1000).cast("bigint").alias("bytes")),
        F.struct(F.lit("LOBSEGMENT").alias("segment_type"), F.lit(7).cast("bigint").alias("bytes")),
    )
    tables = even.select("snapshot_id", F.col("schema_name").alias("owner"), F.col("table_name").alias("segment_name"), F.inline(kinds))
    listed = all_indexes(spark, sf, indexes).select(
        "snapshot_id", "owner", F.col("index_name").alias("segment_name"), F.lit("INDEX").alias("segment_type"), "bytes"
    )
    return tables.unionByName(listed)


def all_indexes(spark: SparkSession, sf: str, indexes: DataFrame | None = None) -> DataFrame:
    return _indexes(spark, sf, indexes).select(
        "snapshot_id", F.concat("schema_name", F.lit("_IX")).alias("owner"),
        F.concat_ws(".", "table_name", "index_name").alias("index_name"), F.col("schema_name").alias("table_owner"),
        "table_name", (F.col("column_count") * 4096).alias("bytes"),
    )


def _sqlite_name() -> Column:
    return F.when(F.col("table_name").endswith("7"), F.concat(F.lit("sqliteX"), "table_name")).otherwise(F.col("table_name"))


def sqlite_master(spark: SparkSession, sf: str, base: DataFrame | None = None, indexes: DataFrame | None = None) -> DataFrame:
    tables = _tables(spark, sf, base).select(
        "snapshot_id", "schema_name", F.lit("table").alias("type"), F.col("table_name").alias("name"), _sqlite_name().alias("tbl_name")
    )
    listed = _indexes(spark, sf, indexes).select(
        "snapshot_id", "schema_name", F.lit("index").alias("type"),
        F.concat_ws(".", "table_name", "index_name").alias("name"), _sqlite_name().alias("tbl_name"),
    )
    views = p1.views(spark, sf, base=base).select("snapshot_id", "schema_name", F.lit("view").alias("type"), "name", F.col("name").alias("tbl_name"))
    return tables.unionByName(listed).unionByName(views)


def dbstat(spark: SparkSession, sf: str, base: DataFrame | None = None, indexes: DataFrame | None = None) -> DataFrame:
    sizes = F.array(F.floor(F.col("data_bytes") / 2), F.lit(10).cast("bigint"))
    tables = _tables(spark, sf, base).select("snapshot_id", "schema_name", F.col("table_name").alias("name"), F.explode(sizes).alias("pgsize"))
    listed = _indexes(spark, sf, indexes).select(
        "snapshot_id", "schema_name", F.concat_ws(".", "table_name", "index_name").alias("name"),
        (F.col("column_count") * 4096).alias("pgsize"),
    )
    return tables.unionByName(listed)


def syscat_tables(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    pages = F.floor(F.col("data_bytes") / 4096)
    return _tables(spark, sf, base).select(
        "snapshot_id", F.col("schema_name").alias("tabschema"), F.col("table_name").alias("tabname"),
        F.when(F.col("column_count") % 4 == 0, "V").otherwise("T").alias("type"),
        F.concat(F.lit("TS"), (F.col("column_count") % 3).cast("string")).alias("tbspace"),
        F.when(F.col("row_estimate").isNull(), F.lit(-1)).otherwise(pages).alias("npages"), (pages + 3).alias("fpages"),
        F.coalesce("row_estimate", F.lit(-1).cast("bigint")).alias("card"),
    )


def syscat_tablespaces(spark: SparkSession, sf: str, snapshots: DataFrame | None = None) -> DataFrame:
    """``snapshots``: their ids as snapshot_id, if they are at hand already."""
    spaces = F.array(
        F.struct(F.lit("TS0").alias("tbspace"), F.lit(8192).alias("pagesize")),
        F.struct(F.lit("TS1").alias("tbspace"), F.lit(16384).alias("pagesize")),
    )
    known = p1.snapshots(spark, sf).select(F.col("id").alias("snapshot_id")) if snapshots is None else snapshots
    return known.select("snapshot_id", F.inline(spaces))


def table_storage(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    return _tables(spark, sf, base).select(
        "snapshot_id", F.col("schema_name").alias("table_schema"), "table_name", (F.col("column_count") % 5 == 0).alias("deleted"),
        F.when(F.col("column_count") % 4 == 0, "EXTERNAL").otherwise("BASE TABLE").alias("table_type"),
        F.col("data_bytes").alias("total_logical_bytes"), F.col("row_estimate").alias("total_rows"),
    )


# --- routines ----------------------------------------------------------------------------------------------------
def _routines(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    return p1.views(spark, sf, "p_", base).withColumn("_first", F.substring("name", 3, 1))


def _by_first(values: dict[str, str], other: str) -> Column:
    return F.coalesce(*[F.when(F.col("_first") == k, v) for k, v in values.items()], F.lit(other))


def pg_proc(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    return _routines(spark, sf, base).select(
        "snapshot_id", F.col("schema_name").alias("pronamespace"), F.col("name").alias("proname"),
        _by_first({"1": "p", "2": "f", "3": "f"}, "a").alias("prokind"), F.col("_first").alias("arguments"),
        F.lit("void").alias("return_type"), "definition",
    )


def mysql_routines(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    return _routines(spark, sf, base).select(
        "snapshot_id", F.col("schema_name").alias("routine_schema"), F.col("name").alias("routine_name"),
        F.lit("FUNCTION").alias("routine_type"), F.col("_first").alias("dtd_identifier"), F.col("definition").alias("routine_definition"),
    )


def db2_routines(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    return _routines(spark, sf, base).select(
        "snapshot_id", F.col("schema_name").alias("routineschema"), F.col("name").alias("routinename"),
        F.lit("P").alias("routinetype"), F.col("definition").alias("text"),
    )


def sys_objects(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    return _routines(spark, sf, base).select(
        "snapshot_id", F.col("schema_name").alias("schema_id"), "name",
        _by_first({"1": "P", "2": "FN", "3": "IF", "4": "U"}, "TF").alias("type"), F.lit("ROUTINE").alias("type_desc"), "definition",
    )


def all_source(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    rows = p1.routine_lines(spark, sf, base).withColumn("_first", F.substring("routine_name", 3, 1))
    return rows.select(
        "snapshot_id", F.col("schema_name").alias("owner"), F.col("routine_name").alias("name"),
        _by_first({"1": "PACKAGE BODY", "2": "FUNCTION", "5": "OTHER"}, "PROCEDURE").alias("type"), "line", "text",
    )


def all_procedures(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    return _routines(spark, sf, base).select(
        "snapshot_id", F.col("schema_name").alias("owner"), F.col("name").alias("object_name"),
        _by_first({"1": "PACKAGE", "2": "FUNCTION", "3": "TRIGGER"}, "PROCEDURE").alias("object_type"),
    )


# --- grants ------------------------------------------------------------------------------------------------------
def _granted(spark: SparkSession, sf: str) -> DataFrame:
    return p1.table(spark, sf, "customer").where("c_acctbal > 0").select(
        F.col("c_nationkey").cast("bigint").alias("snapshot_id"), F.col("c_mktsegment").alias("schema_name"),
        F.col("c_name").alias("table_name"), F.col("c_custkey").alias("_key"),
    )


def _cycle(values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("_key") % len(values) + 1).cast("int"))


def role_table_grants(spark: SparkSession, sf: str, quoted: bool = False) -> DataFrame:
    own = "'reader'" if quoted else "reader"
    return _granted(spark, sf).select(
        "snapshot_id", F.col("schema_name").alias("table_schema"), "table_name", _cycle((own, "PUBLIC", "other")).alias("grantee"),
        _cycle(("INSERT", "SELECT", "SELECT", "SELECT")).alias("privilege_type"), F.lit("reader").alias("reading_user"),
    )


def permission_objects(spark: SparkSession, sf: str) -> DataFrame:
    return _granted(spark, sf).select(
        "snapshot_id", F.col("schema_name").alias("schema_id"), F.col("table_name").alias("name"),
        _cycle(("U", "V", "P")).alias("type"), (F.col("_key") % 2).cast("int").alias("can_select"),
    )


def permission_schemas(spark: SparkSession, sf: str) -> DataFrame:
    return _granted(spark, sf).select("snapshot_id", F.col("schema_name").alias("schema_id"), F.col("schema_name").alias("name")).distinct()


def all_tab_privs(spark: SparkSession, sf: str) -> DataFrame:
    return _granted(spark, sf).select(
        "snapshot_id", F.col("schema_name").alias("owner"), "table_name", _cycle(("BUILDING", "PUBLIC", "other")).alias("grantee"),
        _cycle(("INSERT", "SELECT", "SELECT", "SELECT")).alias("privilege"), F.lit("BUILDING").alias("reading_user"),
    )


def owned_tables(spark: SparkSession, sf: str) -> DataFrame:
    return _granted(spark, sf).where("_key % 2 = 0").select(
        "snapshot_id", F.col("schema_name").alias("owner"), "table_name", F.lit("BUILDING").alias("reading_user")
    )


def owned_views(spark: SparkSession, sf: str) -> DataFrame:
    return _granted(spark, sf).where("_key % 3 = 0").select(
        "snapshot_id", F.col("schema_name").alias("owner"), F.col("table_name").alias("view_name"), F.lit("BUILDING").alias("reading_user")
    )


def tabauth(spark: SparkSession, sf: str) -> DataFrame:
    return _granted(spark, sf).select(
        "snapshot_id", F.col("schema_name").alias("tabschema"), F.col("table_name").alias("tabname"),
        _cycle(("reader", "other", "third")).alias("grantee"), F.when(F.col("_key") % 5 == 0, "P").otherwise("U").alias("granteetype"),
        _cycle(("Y", "G", "A", "N")).alias("selectauth"), F.lit("reader").alias("reading_user"),
    )
