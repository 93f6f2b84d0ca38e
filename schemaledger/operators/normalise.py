"""Raw catalogue rows of eight dialects -> common storage, routine and grant relations.

Inputs are landed extracts or JDBC scans that keep the catalogue's own column names in lower case, with a
`snapshot_id` column. Every function covers all schemas and snapshots of its input in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import byte_count, grant_value, row_estimate

PAGE_BYTES = 8192
DB2_PAGE_BYTES = 4096


def _storage(rows: DataFrame, schema: Column, name: Column, data: Column, index: Column, total: Column, estimate: Column) -> DataFrame:
    return rows.select(
        "snapshot_id", schema.alias("schema_name"), name.cast("string").alias("table_name"),
        byte_count(data).alias("data_bytes"), byte_count(index).alias("index_bytes"),
        byte_count(total).alias("total_bytes"), row_estimate(estimate).alias("row_estimate"),
    )


# --- storage -----------------------------------------------------------------------------------------------------
def storage_postgresql(pg_class: DataFrame, pg_namespace: DataFrame) -> DataFrame:
    """pg_class rows carry the three size functions as data_bytes, index_bytes, total_bytes."""
    kept = pg_class.where(F.col("relkind").isin("r", "p"))
    spaces = pg_namespace.select("snapshot_id", F.col("oid").alias("relnamespace"), "nspname")
    return _storage(
        kept.join(spaces, ["snapshot_id", "relnamespace"]), F.col("nspname"), F.col("relname"), F.col("data_bytes"),
        F.col("index_bytes"), F.col("total_bytes"), F.col("reltuples"),
    )


def storage_mysql(tables: DataFrame) -> DataFrame:
    """MySQL and MariaDB."""
    kept = tables.where(F.col("table_type") == "BASE TABLE")
    data, index = byte_count(F.col("data_length")), byte_count(F.col("index_length"))
    return _storage(kept, F.col("table_schema"), F.col("table_name"), data, index, data + index, F.col("table_rows"))


def storage_mssql(partition_stats: DataFrame, tables: DataFrame, schemas: DataFrame) -> DataFrame:
    """Page counts are added per object before the joins, so the joins see one row per table."""
    data = F.col("in_row_data_page_count") + F.col("lob_used_page_count") + F.col("row_overflow_used_page_count")
    pages = partition_stats.groupBy("snapshot_id", "object_id").agg(
        F.sum(data).alias("_data"), F.sum(F.col("used_page_count") - data).alias("_index"),
        F.sum("reserved_page_count").alias("_total"), F.sum("row_count").alias("_rows"),
    )
    named = tables.select("snapshot_id", "object_id", "schema_id", F.col("name").alias("_table"))
    owners = schemas.select("snapshot_id", "schema_id", F.col("name").alias("_schema"))
    joined = pages.join(named, ["snapshot_id", "object_id"]).join(owners, ["snapshot_id", "schema_id"])
    size = lambda c: F.col(c) * PAGE_BYTES
    return _storage(joined, F.col("_schema"), F.col("_table"), size("_data"), size("_index"), size("_total"), F.col("_rows"))


def storage_oracle(all_tables: DataFrame, all_segments: DataFrame, all_indexes: DataFrame) -> DataFrame:
    """Segment sizes are added per segment first; tables and indexes then take their own sums."""
    segments = all_segments.where(
        F.col("segment_type").startswith("TABLE") | F.col("segment_type").startswith("INDEX")
    ).groupBy("snapshot_id", "owner", "segment_name").agg(
        F.sum(F.when(F.col("segment_type").startswith("TABLE"), F.col("bytes"))).alias("_data"),
        F.sum(F.when(F.col("segment_type").startswith("INDEX"), F.col("bytes"))).alias("_index"),
    )
    table_bytes = segments.select("snapshot_id", "owner", F.col("segment_name").alias("table_name"), "_data")
    index_bytes = (
        all_indexes.join(
            segments.select("snapshot_id", "owner", F.col("segment_name").alias("index_name"), "_index"),
            ["snapshot_id", "owner", "index_name"],
        )
        .groupBy("snapshot_id", F.col("table_owner").alias("owner"), "table_name")
        .agg(F.sum("_index").alias("_index"))
    )
    keys = ["snapshot_id", "owner", "table_name"]
    joined = all_tables.join(table_bytes, keys, "left").join(index_bytes, keys, "left")
    data, index = byte_count(F.col("_data")), byte_count(F.col("_index"))
    return _storage(joined, F.col("owner"), F.col("table_name"), data, index, data + index, F.col("num_rows"))


def storage_sqlite(sqlite_master: DataFrame, dbstat: DataFrame) -> DataFrame:
    sizes = dbstat.groupBy("snapshot_id", "schema_name", "name").agg(F.sum("pgsize").alias("_bytes"))
    kept = sqlite_master.where(F.col("type").isin("table", "index") & ~F.col("tbl_name").like("sqlite_%"))
    of = lambda kind: F.sum(F.when(F.col("type") == kind, F.col("_bytes")).otherwise(0))
    grouped = (
        kept.join(sizes, ["snapshot_id", "schema_name", "name"])
        .groupBy("snapshot_id", "schema_name", "tbl_name")
        .agg(of("table").alias("_data"), of("index").alias("_index"), F.sum("_bytes").alias("_total"))
    )
    return _storage(
        grouped, F.col("schema_name"), F.col("tbl_name"), F.col("_data"), F.col("_index"), F.col("_total"),
        F.lit(None).cast("bigint"),
    )


def storage_db2(tables: DataFrame, tablespaces: DataFrame) -> DataFrame:
    """Negative statistics mean 'not collected': no bytes, no estimate."""
    kept = tables.where(F.col("type") == "T")
    joined = kept.join(tablespaces.select("snapshot_id", "tbspace", "pagesize"), ["snapshot_id", "tbspace"], "left")
    page = F.coalesce("pagesize", F.lit(DB2_PAGE_BYTES))
    known = lambda c, value, other: F.when(F.col(c) >= 0, value).otherwise(other)
    return _storage(
        joined, F.col("tabschema"), F.col("tabname"), known("npages", F.col("npages") * page, 0), F.lit(0),
        known("fpages", F.col("fpages") * page, 0), known("card", F.col("card"), None),
    )


def storage_bigquery(table_storage: DataFrame) -> DataFrame:
    kept = table_storage.where((F.col("deleted") == F.lit(False)) & (F.col("table_type") == "BASE TABLE"))
    size = F.col("total_logical_bytes")
    return _storage(kept, F.col("table_schema"), F.col("table_name"), size, F.lit(0), size, F.col("total_rows"))


# --- routines ----------------------------------------------------------------------------------------------------
def _routine(rows: DataFrame, schema: Column, name: Column, kind: Column, definition: Column,
             return_type: Column | None = None, arguments: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        "snapshot_id", schema.alias("schema_name"), name.alias("name"), kind.alias("routine_type"),
        (return_type if return_type is not None else none).alias("return_type"),
        (arguments if arguments is not None else none).alias("arguments"), definition.alias("definition"),
    )


def routines_postgresql(pg_proc: DataFrame, pg_namespace: DataFrame) -> DataFrame:
    kept = pg_proc.where(F.col("prokind").isin("f", "p"))
    spaces = pg_namespace.select("snapshot_id", F.col("oid").alias("pronamespace"), "nspname")
    kind = F.when(F.col("prokind") == "p", "PROCEDURE").otherwise("FUNCTION")
    return _routine(
        kept.join(spaces, ["snapshot_id", "pronamespace"]), F.col("nspname"), F.col("proname"), kind,
        F.col("definition"), F.col("return_type"), F.col("arguments"),
    )


def routines_mysql(routines: DataFrame) -> DataFrame:
    """MySQL and MariaDB."""
    return _routine(
        routines, F.col("routine_schema"), F.col("routine_name"), F.col("routine_type"), F.col("routine_definition"),
        F.col("dtd_identifier"),
    )


def routines_db2(routines: DataFrame) -> DataFrame:
    return _routine(routines, F.col("routineschema"), F.col("routinename"), F.col("routinetype"), F.col("text"))


def routines_mssql(objects: DataFrame, schemas: DataFrame) -> DataFrame:
    kept = objects.where(F.col("type").isin("P", "PC", "FN", "IF", "TF"))
    owners = schemas.select("snapshot_id", "schema_id", F.col("name").alias("_schema"))
    return _routine(
        kept.join(owners, ["snapshot_id", "schema_id"]), F.col("_schema"), F.col("name"), F.col("type_desc"),
        F.col("definition"),
    )


def routines_oracle(all_procedures: DataFrame, all_source: DataFrame) -> DataFrame:
    """Source lines joined with line breaks; a package takes the text of its body. One text per routine is grouped."""
    kept = all_procedures.where(F.col("object_type").isin("PROCEDURE", "FUNCTION", "PACKAGE")).select(
        "snapshot_id", "owner", "object_name", "object_type",
        F.when(F.col("object_type") == "PACKAGE", "PACKAGE BODY").otherwise(F.col("object_type")).alias("type"),
    )
    lines = all_source.select("snapshot_id", "owner", F.col("name").alias("object_name"), "type", "line", "text")
    by_line = F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("line", "text"))))
    texts = F.filter(F.transform(by_line, lambda x: x["text"]), lambda x: x.isNotNull())
    whole = (
        kept.join(lines, ["snapshot_id", "owner", "object_name", "type"], "left")
        .groupBy("snapshot_id", "owner", "object_name", "object_type")
        .agg(texts.alias("_texts"))
    )
    definition = F.when(F.size("_texts") > 0, F.array_join("_texts", "\n"))
    return _routine(whole, F.col("owner"), F.col("object_name"), F.col("object_type"), definition)


# --- SELECT grants -----------------------------------------------------------------------------------------------
def grant_rows(names: DataFrame, users: DataFrame | None = None, default: str = "current_user") -> DataFrame:
    """Granted names -> (snapshot_id, schema_name, name, permissions). ``users``: snapshot_id, username."""
    rows = names.join(users, "snapshot_id", "left") if users is not None else names
    user = F.col("username") if "username" in rows.columns else F.lit("")
    return rows.select("snapshot_id", "schema_name", "name", grant_value(user, default).alias("permissions"))


def grants_postgresql(role_table_grants: DataFrame) -> DataFrame:
    """``reading_user``: the reading user, landed with every row."""
    kept = role_table_grants.where((F.col("privilege_type") == "SELECT") & (F.col("grantee") == F.col("reading_user")))
    return kept.select("snapshot_id", F.col("table_schema").alias("schema_name"), F.col("table_name").alias("name"))


def grants_mysql(table_privileges: DataFrame) -> DataFrame:
    """MySQL and MariaDB quote the grantee, user and host apart: the user reader@% is granted as 'reader'@'%'."""
    own = F.concat(F.lit("'"), F.col("reading_user"), F.lit("'"))
    apart = F.regexp_replace(own, "@([^@]*)$", "'@'$1")
    kept = table_privileges.where((F.col("privilege_type") == "SELECT") & F.col("grantee").isin(own, apart))
    return kept.select("snapshot_id", F.col("table_schema").alias("schema_name"), F.col("table_name").alias("name"))


def grants_mssql(objects: DataFrame, schemas: DataFrame) -> DataFrame:
    """``can_select``: result of the permission function, landed with every object row."""
    kept = objects.where(F.col("type").isin("U", "V") & (F.col("can_select") == 1))
    owners = schemas.select("snapshot_id", "schema_id", F.col("name").alias("schema_name"))
    return kept.join(owners, ["snapshot_id", "schema_id"]).select("snapshot_id", "schema_name", "name")


def grants_oracle(all_tab_privs: DataFrame, all_tables: DataFrame, all_views: DataFrame) -> DataFrame:
    """Direct and PUBLIC grants, own tables and own views, each name once."""
    own = F.col("reading_user")
    direct = all_tab_privs.where((F.col("privilege") == "SELECT") & ((F.col("grantee") == own) | (F.col("grantee") == "PUBLIC")))
    pick = lambda rows, name: rows.select("snapshot_id", F.col("owner").alias("schema_name"), F.col(name).alias("name"))
    return (
        pick(direct, "table_name")
        .unionAll(pick(all_tables.where(F.col("owner") == own), "table_name"))
        .unionAll(pick(all_views.where(F.col("owner") == own), "view_name"))
        .distinct()
    )


def grants_db2(tabauth: DataFrame) -> DataFrame:
    own_or_public = (F.col("grantee") == F.col("reading_user")) | (F.col("granteetype") == "P")
    kept = tabauth.where(F.col("selectauth").isin("Y", "G", "A") & own_or_public)
    return kept.select("snapshot_id", F.col("tabschema").alias("schema_name"), F.col("tabname").alias("name"))


def grants_sqlite(schemas: DataFrame) -> DataFrame:
    """SQLite has no grants: one wildcard row per schema. ``schemas``: snapshot_id, schema_name, username."""
    return grant_rows(schemas.withColumn("name", F.lit("*")), default="sqlite")
