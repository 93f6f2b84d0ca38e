"""Catalogue relations of each kind of database as a producer lands them, derived from the given tables.

Every snapshot belongs to a source of one kind; its schemas, tables, columns and so on are put into the relations of that
kind, under the columns a scan of it would give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import broadcast_if_small, shared_folder, written
from ..sources import catalogs
from . import driver_tables as p1, raw_catalogs as raw

SYSTEM_SCHEMAS = ("information_schema", "SYS")
_TABLE = ("snapshot_id", "schema_name", "table_name")


def headers(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots with what they ask for: some list schemas (one that does not exist), items, or no sizes."""
    snapshots = p1.snapshots(spark, sf).select(F.col("id").alias("snapshot_id"), "yr")
    few = F.array(F.lit("table"), F.lit("view"), F.lit("trigger"))
    listed = F.array(F.lit("BUILDING"), F.lit("absent"))
    return p1.headers(spark, sf).drop("items", "storage_growth").join(snapshots, "snapshot_id").withColumns({
        "items": F.when(F.col("yr") % 3 == 0, few), "storage_growth": F.col("yr") % 4 != 0,
        "selected_schemas": F.when(F.col("yr") % 5 == 0, listed), "dataset": F.when(F.col("yr") % 2 == 0, "MACHINERY"),
        "username": F.when(F.col("data_source_id") % 2 == 1, "reader"),
    }).drop("yr")


def _renamed(rows: DataFrame, **names: str | Column) -> DataFrame:
    return rows.select("snapshot_id", *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in names.items()])


def _null() -> Column:
    return F.lit(None).cast("string")


def _structure(spark: SparkSession, sf: str, base: DataFrame, indexes: DataFrame) -> dict[str, DataFrame]:
    tables = p1.tables(spark, sf, base).select(*_TABLE, F.concat(F.lit("about "), "table_name").alias("comment_text"))
    of_system = F.explode(F.array(*[F.lit(s) for s in SYSTEM_SCHEMAS])).alias("schema_name")
    schemata = tables.select("snapshot_id", "schema_name").unionAll(tables.select("snapshot_id").distinct().select("snapshot_id", of_system))
    place = F.substring("column_name", 1, 1).cast("bigint")
    columns = base.select(
        *_TABLE, place.alias("ordinal"), F.col("column_name").alias("name"), F.col("data_type").alias("type"),
        F.when(F.col("nullable"), "YES").otherwise("NO").alias("is_nullable"), F.when(place == 1, "0").alias("default_text"),
        F.when(place == 2, "second").alias("comment_text"),
    )
    keys = p1.primary_keys(spark, sf, base).select(
        *_TABLE, F.explode(F.array(F.struct(F.lit("P").alias("constraint_type"), F.lit("pk").alias("name")),
                                   F.struct(F.lit("U").alias("constraint_type"), F.lit("uq").alias("name")))).alias("k"),
        F.lit(1).alias("ordinal"), F.col("constrained_columns")[0].alias("column_name"),
    ).select(*_TABLE, "k.*", "ordinal", "column_name")
    references = p1.foreign_keys(spark, sf, base).select(
        *_TABLE, F.col("name").alias("key_id"), "name", F.lit(1).alias("ordinal"), F.col("constrained_columns")[0].alias("column_name"),
        "referred_schema", "referred_table", F.col("referred_columns")[0].alias("referred_column"),
    )
    second = F.when(F.col("column_count") > 1, F.array(F.col("first_column"), F.lit("more"))).otherwise(F.array("first_column"))
    index_columns = indexes.select(
        *_TABLE, F.col("index_name").alias("name"), F.col("is_unique").cast("bigint").alias("is_unique"),
        F.posexplode(second).alias("ordinal", "column_name"),
    )
    return {
        "schemata": schemata.distinct(), "tables": tables, "columns": columns, "key_columns": keys, "reference_columns": references,
        "index_columns": index_columns, "views": p1.views(spark, sf, base=base),
    }


def _granted(spark: SparkSession, sf: str, base: DataFrame) -> DataFrame:
    keys = ["data_source_id", "schema_name", "table_name"]
    return p1.tables(spark, sf, base).join(p1.granted_tables(spark, sf), keys, "left_semi").select(*_TABLE)


def _information_schema_grants(granted: DataFrame, grantee: str, user: str) -> DataFrame:
    kinds = F.explode(F.array(F.lit("SELECT"), F.lit("INSERT")))
    return _renamed(
        granted, table_schema="schema_name", table_name="table_name", privilege_type=kinds, grantee=F.lit(grantee), reading_user=F.lit(user)
    )


def _native(
    spark: SparkSession, sf: str, kind: str, base: DataFrame, indexes: DataFrame, snapshots: DataFrame, structure: dict[str, DataFrame],
) -> dict[str, DataFrame]:
    granted = _granted(spark, sf, base)
    if kind == "postgresql":
        return {
            "pg_class": raw.pg_class(spark, sf, base), "pg_namespace": raw.pg_namespace(spark, sf, base), "pg_proc": raw.pg_proc(spark, sf, base),
            "grants": _information_schema_grants(granted, "reader", "reader"),
        }
    if kind in ("mysql", "mariadb"):
        return {
            "storage": raw.information_schema_tables(spark, sf, base), "routines": raw.mysql_routines(spark, sf, base),
            "grants": _information_schema_grants(granted, "'reader'@'%'", "reader@%"),
        }
    if kind == "mssql":
        routines = raw.sys_objects(spark, sf, base).withColumn("can_select", F.lit(1))
        tables = _renamed(
            granted, schema_id="schema_name", name="table_name", type=F.lit("U"), type_desc=F.lit("USER_TABLE"), definition=_null(),
            can_select=F.lit(1),
        )
        return {
            "partition_stats": raw.partition_stats(spark, sf, base), "sys_tables": raw.sys_tables(spark, sf, base),
            "sys_schemas": raw.sys_schemas(spark, sf, base), "sys_objects": routines.unionByName(tables),
        }
    if kind == "oracle":
        user = F.lit("BUILDING")
        tables = raw.all_tables(spark, sf, base).withColumns({
            "comment_text": F.concat(F.lit("about "), "table_name"), "reading_user": user})
        views = _renamed(structure["views"], owner="schema_name", view_name="name", definition="definition", reading_user=user)
        privileges = _renamed(
            granted, owner="schema_name", table_name="table_name", privilege=F.lit("SELECT"), grantee=F.lit("PUBLIC"), reading_user=user)
        return {
            "all_tables": tables, "all_views": views, "all_segments": raw.all_segments(spark, sf, base, indexes), "all_indexes": raw.all_indexes(spark, sf, indexes),
            "all_procedures": raw.all_procedures(spark, sf, base), "all_source": raw.all_source(spark, sf, base), "all_tab_privs": privileges,
        }
    if kind == "db2":
        auth = _renamed(
            granted, tabschema="schema_name", tabname="table_name", grantee=F.lit("reader"), granteetype=F.lit("U"), selectauth=F.lit("G"),
            reading_user=F.lit("reader"),
        )
        return {
            "syscat_tables": raw.syscat_tables(spark, sf, base).withColumn("remarks", F.concat(F.lit("about "), "tabname")),
            "tablespaces": raw.syscat_tablespaces(spark, sf, snapshots), "routines": raw.db2_routines(spark, sf, base), "tabauth": auth,
        }
    if kind == "sqlite":
        text = structure["views"].select("snapshot_id", "schema_name", "name", F.col("definition").alias("sql"))
        master = raw.sqlite_master(spark, sf, base, indexes).join(text, ["snapshot_id", "schema_name", "name"], "left")
        return {"sqlite_master": master, "dbstat": raw.dbstat(spark, sf, base, indexes)}
    return {"table_storage": raw.table_storage(spark, sf, base)}


def extracts(
    spark: SparkSession, sf: str, kinds: tuple[str, ...], heads: DataFrame, base: DataFrame, indexes: DataFrame,
) -> dict[str, dict[str, DataFrame]]:
    """Kind -> relation -> rows, with exactly the columns of a scan.

    ``heads``: snapshot_id and db_type of the snapshots; ``base`` / ``indexes``: the column and index relations of those of ``kinds``.
    """
    structure = _structure(spark, sf, base, indexes)
    found = {}
    for kind in kinds:
        ours = broadcast_if_small(heads.where(F.col("db_type") == kind).select("snapshot_id"))
        given = structure | _native(spark, sf, kind, base, indexes, ours, structure)
        found[kind] = {
            r: catalogs.conformed(given[r].join(ours, "snapshot_id", "left_semi"), kind, r) for r in catalogs.CATALOG_QUERIES[kind]
        }
    return found


def landed(spark: SparkSession, sf: str, kinds: tuple[str, ...], heads: DataFrame | None = None) -> dict[str, dict[str, DataFrame]]:
    """The extracts of these kinds, written as a producer lands them and read back.

    ``heads``: the snapshots, if they are at hand already. Orders are joined with customers once for the columns and once for
    the indexes, of the asked kinds only; all relations follow from these two.
    """
    path = shared_folder(spark)
    heads = (p1.headers(spark, sf) if heads is None else heads).select("snapshot_id", "db_type")
    asked = broadcast_if_small(heads.where(F.col("db_type").isin(list(kinds))).select("snapshot_id"))
    base, indexes = (written(rows.join(asked, "snapshot_id", "left_semi")) for rows in (p1.columns(spark, sf), p1.indexes(spark, sf)))
    for kind, relations in extracts(spark, sf, kinds, heads, base, indexes).items():
        for relation, rows in relations.items():
            rows.write.parquet(f"{path}/{kind}/{relation}")
    return {kind: catalogs.landed_relations(spark, path, kind) for kind in kinds}
