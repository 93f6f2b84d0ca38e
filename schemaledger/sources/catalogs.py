"""Catalogue relations: what is read of each kind of database, by scans or from landed extracts.

A relation is stated once, as the columns its readers get and the expressions that fill them. The select list of a scan,
the check of a landed extract and the types in Spark all follow from it, so they cannot drift apart.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any, NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .connections import jdbc_options, reader_format

# Relations that every kind gives in the same form.
STRUCTURE = {
    "schemata": "schema_name",
    "tables": "schema_name table_name comment_text",
    "columns": "schema_name table_name ordinal name type is_nullable default_text comment_text",
    "key_columns": "schema_name table_name constraint_type name ordinal column_name",
    "reference_columns": "schema_name table_name key_id name ordinal column_name referred_schema referred_table referred_column",
    "index_columns": "schema_name table_name name ordinal column_name is_unique",
    "views": "schema_name name definition",
}
_TYPES = {
    "BIGINT": "ordinal line data_bytes index_bytes total_bytes data_length index_length table_rows in_row_data_page_count "
              "lob_used_page_count row_overflow_used_page_count used_page_count reserved_page_count row_count num_rows bytes "
              "npages fpages card pagesize pgsize total_logical_bytes total_rows is_unique can_select",
    "DOUBLE": "reltuples",
    "BOOLEAN": "deleted",
}
_TYPE_OF = {name: kind for kind, names in _TYPES.items() for name in names.split()}


class Relation(NamedTuple):
    """Columns as name -> expression of the source; ``source`` is what follows FROM."""

    columns: dict[str, str]
    source: str

    def sql(self) -> str:
        return f"SELECT {', '.join(f'{e} AS {n}' for n, e in self.columns.items())} FROM {self.source}"

    def types(self) -> dict[str, str]:
        return {"snapshot_id": "BIGINT", **{name: _TYPE_OF.get(name, "STRING") for name in self.columns}}


def _structure(relation: str, source: str, *expressions: str) -> dict[str, Relation]:
    return {relation: Relation(dict(zip(STRUCTURE[relation].split(), expressions, strict=True)), source)}


def _native(relation: str, source: str, own: str = "", **computed: str) -> dict[str, Relation]:
    """``own``: columns that keep the name they have in the catalogue."""
    return {relation: Relation({**{c: c for c in own.split()}, **computed}, source)}


# --- PostgreSQL --------------------------------------------------------------------------------------------------
_PG_CLASS = "pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace"
_PG_KEY = "pg_constraint k JOIN pg_class c ON c.oid = k.conrelid JOIN pg_namespace n ON n.oid = c.relnamespace"
_PG_COLUMN = "JOIN pg_attribute a ON a.attrelid = c.oid AND a.attnum = u.attnum"
_POSTGRESQL = {
    **_structure("schemata", "pg_namespace", "nspname"),
    **_structure("tables", f"{_PG_CLASS} WHERE c.relkind IN ('r', 'p')", "n.nspname", "c.relname", "obj_description(c.oid, 'pg_class')"),
    **_structure(
        "columns",
        f"{_PG_CLASS} JOIN pg_attribute a ON a.attrelid = c.oid LEFT JOIN pg_attrdef d ON d.adrelid = c.oid AND d.adnum = a.attnum "
        "WHERE c.relkind IN ('r', 'p') AND a.attnum > 0 AND NOT a.attisdropped",
        "n.nspname", "c.relname", "a.attnum", "a.attname", "format_type(a.atttypid, a.atttypmod)",
        "CASE WHEN a.attnotnull THEN 'NO' ELSE 'YES' END", "pg_get_expr(d.adbin, d.adrelid)", "col_description(c.oid, a.attnum)",
    ),
    **_structure(
        "key_columns",
        f"{_PG_KEY} CROSS JOIN LATERAL unnest(k.conkey) WITH ORDINALITY AS u(attnum, place) {_PG_COLUMN} WHERE k.contype IN ('p', 'u')",
        "n.nspname", "c.relname", "CASE k.contype WHEN 'p' THEN 'P' ELSE 'U' END", "k.conname", "u.place", "a.attname",
    ),
    **_structure(
        "reference_columns",
        f"{_PG_KEY} CROSS JOIN LATERAL unnest(k.conkey, k.confkey) WITH ORDINALITY AS u(attnum, refnum, place) {_PG_COLUMN} "
        "JOIN pg_class rc ON rc.oid = k.confrelid JOIN pg_namespace rn ON rn.oid = rc.relnamespace "
        "JOIN pg_attribute ra ON ra.attrelid = rc.oid AND ra.attnum = u.refnum WHERE k.contype = 'f'",
        "n.nspname", "c.relname", "k.conname", "k.conname", "u.place", "a.attname", "rn.nspname", "rc.relname", "ra.attname",
    ),
    **_structure(
        "index_columns",
        f"{_PG_CLASS} JOIN pg_index i ON i.indrelid = c.oid JOIN pg_class x ON x.oid = i.indexrelid "
        "CROSS JOIN LATERAL unnest(CAST(i.indkey AS int2[])) WITH ORDINALITY AS u(attnum, place) "
        "LEFT JOIN pg_attribute a ON a.attrelid = c.oid AND a.attnum = u.attnum WHERE NOT i.indisprimary AND u.place <= i.indnkeyatts",
        "n.nspname", "c.relname", "x.relname", "u.place", "a.attname", "CASE WHEN i.indisunique THEN 1 ELSE 0 END",
    ),
    **_structure("views", f"{_PG_CLASS} WHERE c.relkind = 'v'", "n.nspname", "c.relname", "pg_get_viewdef(c.oid)"),
    **_native(
        "pg_class", "pg_class", "oid relname relnamespace relkind reltuples", data_bytes="pg_relation_size(oid)",
        index_bytes="pg_indexes_size(oid)", total_bytes="pg_total_relation_size(oid)",
    ),
    **_native("pg_namespace", "pg_namespace", "oid nspname"),
    **_native(
        "pg_proc", "pg_proc", "pronamespace proname prokind", arguments="pg_get_function_identity_arguments(oid)",
        return_type="pg_get_function_result(oid)", definition="CASE WHEN prokind IN ('f', 'p') THEN pg_get_functiondef(oid) END",
    ),
    **_native(
        "grants", "information_schema.role_table_grants", "table_schema table_name privilege_type grantee", reading_user="CURRENT_USER"
    ),
}

# --- MySQL and MariaDB -------------------------------------------------------------------------------------------
_MYSQL_FAMILY = {
    **_structure("schemata", "information_schema.schemata", "schema_name"),
    **_structure("tables", "information_schema.tables WHERE table_type = 'BASE TABLE'", "table_schema", "table_name", "table_comment"),
    **_structure(
        "columns", "information_schema.columns", "table_schema", "table_name", "ordinal_position", "column_name", "column_type",
        "is_nullable", "column_default", "column_comment",
    ),
    **_structure(
        "key_columns",
        "information_schema.key_column_usage k JOIN information_schema.table_constraints c ON c.table_schema = k.table_schema "
        "AND c.table_name = k.table_name AND c.constraint_name = k.constraint_name WHERE c.constraint_type IN ('PRIMARY KEY', 'UNIQUE')",
        "k.table_schema", "k.table_name", "c.constraint_type", "k.constraint_name", "k.ordinal_position", "k.column_name",
    ),
    **_structure(
        "reference_columns", "information_schema.key_column_usage WHERE referenced_table_name IS NOT NULL", "table_schema",
        "table_name", "constraint_name", "constraint_name", "ordinal_position", "column_name", "referenced_table_schema",
        "referenced_table_name", "referenced_column_name",
    ),
    **_structure(
        "index_columns", "information_schema.statistics WHERE index_name <> 'PRIMARY'", "table_schema", "table_name", "index_name",
        "seq_in_index", "column_name", "CASE non_unique WHEN 0 THEN 1 ELSE 0 END",
    ),
    **_structure("views", "information_schema.views", "table_schema", "table_name", "view_definition"),
    **_native("storage", "information_schema.tables", "table_schema table_name table_type data_length index_length table_rows"),
    **_native("routines", "information_schema.routines", "routine_schema routine_name routine_type dtd_identifier routine_definition"),
    **_native(
        "grants", "information_schema.table_privileges", "table_schema table_name privilege_type grantee", reading_user="CURRENT_USER()"
    ),
}

# --- SQL Server --------------------------------------------------------------------------------------------------
_MS_TABLE = "sys.tables t JOIN sys.schemas s ON s.schema_id = t.schema_id"
_MS_NOTE = "LEFT JOIN sys.extended_properties e ON e.class = 1 AND e.name = 'MS_Description' AND e.major_id = t.object_id AND e.minor_id ="
_MS_COLUMN = "sys.columns c ON c.object_id = x.object_id AND c.column_id = x.column_id"
_MSSQL = {
    **_structure("schemata", "sys.schemas", "name"),
    **_structure("tables", f"{_MS_TABLE} {_MS_NOTE} 0", "s.name", "t.name", "CAST(e.value AS NVARCHAR(MAX))"),
    **_structure(
        "columns",
        f"{_MS_TABLE} JOIN sys.columns c ON c.object_id = t.object_id JOIN sys.types y ON y.user_type_id = c.user_type_id "
        f"LEFT JOIN sys.default_constraints d ON d.object_id = c.default_object_id {_MS_NOTE} c.column_id",
        "s.name", "t.name", "c.column_id", "c.name", "y.name", "CASE c.is_nullable WHEN 1 THEN 'YES' ELSE 'NO' END", "d.definition",
        "CAST(e.value AS NVARCHAR(MAX))",
    ),
    **_structure(
        "key_columns",
        f"{_MS_TABLE} JOIN sys.key_constraints k ON k.parent_object_id = t.object_id "
        f"JOIN sys.index_columns x ON x.object_id = t.object_id AND x.index_id = k.unique_index_id JOIN {_MS_COLUMN}",
        "s.name", "t.name", "CASE k.type WHEN 'PK' THEN 'P' ELSE 'U' END", "k.name", "x.key_ordinal", "c.name",
    ),
    **_structure(
        "reference_columns",
        f"{_MS_TABLE} JOIN sys.foreign_keys k ON k.parent_object_id = t.object_id "
        "JOIN sys.foreign_key_columns x ON x.constraint_object_id = k.object_id "
        "JOIN sys.columns c ON c.object_id = x.parent_object_id AND c.column_id = x.parent_column_id "
        "JOIN sys.tables rt ON rt.object_id = x.referenced_object_id JOIN sys.schemas rs ON rs.schema_id = rt.schema_id "
        "JOIN sys.columns rc ON rc.object_id = x.referenced_object_id AND rc.column_id = x.referenced_column_id",
        "s.name", "t.name", "k.name", "k.name", "x.constraint_column_id", "c.name", "rs.name", "rt.name", "rc.name",
    ),
    **_structure(
        "index_columns",
        f"{_MS_TABLE} JOIN sys.indexes i ON i.object_id = t.object_id JOIN sys.index_columns x ON x.object_id = i.object_id "
        f"AND x.index_id = i.index_id JOIN {_MS_COLUMN} WHERE i.type <> 0 AND i.is_primary_key = 0 AND x.is_included_column = 0",
        "s.name", "t.name", "i.name", "x.key_ordinal", "c.name", "CAST(i.is_unique AS INT)",
    ),
    **_structure(
        "views", "sys.views v JOIN sys.schemas s ON s.schema_id = v.schema_id", "s.name", "v.name", "OBJECT_DEFINITION(v.object_id)"
    ),
    **_native(
        "partition_stats", "sys.dm_db_partition_stats",
        "object_id in_row_data_page_count lob_used_page_count row_overflow_used_page_count used_page_count reserved_page_count row_count",
    ),
    **_native("sys_tables", "sys.tables", "object_id schema_id name"),
    **_native("sys_schemas", "sys.schemas", "schema_id name"),
    **_native(
        "sys_objects", "sys.objects", "schema_id name type_desc", type="RTRIM(type)", definition="OBJECT_DEFINITION(object_id)",
        can_select="HAS_PERMS_BY_NAME(QUOTENAME(SCHEMA_NAME(schema_id)) + '.' + QUOTENAME(name), 'OBJECT', 'SELECT')",
    ),
}

# --- Oracle ------------------------------------------------------------------------------------------------------
_ORACLE_KEY = "all_cons_columns k JOIN all_constraints c ON c.owner = k.owner AND c.constraint_name = k.constraint_name"
_ORACLE = {
    **_structure("schemata", "all_users", "username"),
    **_structure(
        "columns",
        "all_tab_columns c LEFT JOIN all_col_comments m ON m.owner = c.owner AND m.table_name = c.table_name "
        "AND m.column_name = c.column_name",
        "c.owner", "c.table_name", "c.column_id", "c.column_name", "c.data_type", "c.nullable", "c.data_default", "m.comments",
    ),
    **_structure(
        "key_columns", f"{_ORACLE_KEY} WHERE c.constraint_type IN ('P', 'U')", "k.owner", "k.table_name", "c.constraint_type",
        "k.constraint_name", "k.position", "k.column_name",
    ),
    **_structure(
        "reference_columns",
        f"{_ORACLE_KEY} JOIN all_cons_columns r ON r.owner = c.r_owner AND r.constraint_name = c.r_constraint_name "
        "AND r.position = k.position WHERE c.constraint_type = 'R'",
        "k.owner", "k.table_name", "k.constraint_name", "k.constraint_name", "k.position", "k.column_name", "r.owner", "r.table_name",
        "r.column_name",
    ),
    **_structure(
        "index_columns",
        "all_ind_columns x JOIN all_indexes i ON i.owner = x.index_owner AND i.index_name = x.index_name "
        "LEFT JOIN all_constraints p ON p.owner = x.table_owner AND p.table_name = x.table_name AND p.constraint_type = 'P' "
        "AND p.index_name = x.index_name WHERE p.index_name IS NULL",
        "x.table_owner", "x.table_name", "x.index_name", "x.column_position", "x.column_name",
        "CASE i.uniqueness WHEN 'UNIQUE' THEN 1 ELSE 0 END",
    ),
    **_native(
        "all_tables", "all_tables t LEFT JOIN all_tab_comments m ON m.owner = t.owner AND m.table_name = t.table_name",
        owner="t.owner", table_name="t.table_name", num_rows="t.num_rows", comment_text="m.comments", reading_user="USER",
    ),
    **_native("all_views", "all_views", "owner view_name", definition="text", reading_user="USER"),
    **_native("all_segments", "all_segments", "owner segment_name segment_type bytes"),
    **_native("all_indexes", "all_indexes", "owner index_name table_owner table_name"),
    **_native("all_procedures", "all_procedures", "owner object_name object_type"),
    **_native("all_source", "all_source", "owner name type line text"),
    **_native("all_tab_privs", "all_tab_privs", "table_name privilege grantee", owner="table_schema", reading_user="USER"),
}

# --- DB2 ---------------------------------------------------------------------------------------------------------
_DB2 = {
    **_structure("schemata", "syscat.schemata", "schemaname"),
    **_structure(
        "columns", "syscat.columns", "tabschema", "tabname", "colno", "colname", "typename", "nulls", "default", "remarks"
    ),
    **_structure(
        "key_columns",
        "syscat.keycoluse k JOIN syscat.tabconst c ON c.tabschema = k.tabschema AND c.tabname = k.tabname "
        "AND c.constname = k.constname WHERE c.type IN ('P', 'U')",
        "k.tabschema", "k.tabname", "c.type", "k.constname", "k.colseq", "k.colname",
    ),
    **_structure(
        "reference_columns",
        "syscat.references r JOIN syscat.keycoluse k ON k.tabschema = r.tabschema AND k.tabname = r.tabname "
        "AND k.constname = r.constname JOIN syscat.keycoluse p ON p.tabschema = r.reftabschema AND p.tabname = r.reftabname "
        "AND p.constname = r.refkeyname AND p.colseq = k.colseq",
        "r.tabschema", "r.tabname", "r.constname", "r.constname", "k.colseq", "k.colname", "r.reftabschema", "r.reftabname", "p.colname",
    ),
    **_structure(
        "index_columns",
        "syscat.indexcoluse x JOIN syscat.indexes i ON i.indschema = x.indschema AND i.indname = x.indname WHERE i.uniquerule <> 'P'",
        "i.tabschema", "i.tabname", "i.indname", "x.colseq", "x.colname", "CASE i.uniquerule WHEN 'U' THEN 1 ELSE 0 END",
    ),
    **_structure("views", "syscat.views", "viewschema", "viewname", "text"),
    **_native("syscat_tables", "syscat.tables", "tabschema tabname type tbspace npages fpages card remarks"),
    **_native("tablespaces", "syscat.tablespaces", "tbspace pagesize"),
    **_native("routines", "syscat.routines", "routineschema routinename routinetype text"),
    **_native("tabauth", "syscat.tabauth", "tabschema tabname grantee granteetype selectauth", reading_user="CURRENT USER"),
}

# --- SQLite ------------------------------------------------------------------------------------------------------
_LITE_KEYS = "sqlite_master m JOIN pragma_index_list(m.name) l JOIN pragma_index_info(l.name) i WHERE m.type = 'table'"
_LITE_COLUMNS = "sqlite_master m JOIN pragma_table_info(m.name) c WHERE m.type = 'table'"
_SQLITE = {
    **_structure("schemata", "pragma_database_list WHERE name = 'main'", "name"),
    **_structure(
        "columns", _LITE_COLUMNS, "'main'", "m.name", "c.cid", "c.name", "c.type", "CASE c.\"notnull\" WHEN 0 THEN 'YES' ELSE 'NO' END",
        "c.dflt_value", "NULL",
    ),
    **_structure(
        "key_columns",
        f"(SELECT m.name AS tab, 'P' AS kind, NULL AS key, c.pk AS place, c.name AS col FROM {_LITE_COLUMNS} AND c.pk > 0 UNION ALL "
        f"SELECT m.name, 'U', l.name, i.seqno, i.name FROM {_LITE_KEYS} AND l.origin = 'u') k",
        "'main'", "tab", "kind", "key", "place", "col",
    ),
    **_structure(
        "reference_columns", "sqlite_master m JOIN pragma_foreign_key_list(m.name) f WHERE m.type = 'table'", "'main'", "m.name", "f.id",
        "NULL", "f.seq", "f.\"from\"", "NULL", "f.\"table\"", "f.\"to\"",
    ),
    **_structure(
        "index_columns", f"{_LITE_KEYS} AND l.origin = 'c'", "'main'", "m.name", "l.name", "i.seqno", "i.name", "l.\"unique\""
    ),
    **_native("sqlite_master", "sqlite_master", "type name tbl_name sql", schema_name="'main'"),
    **_native("dbstat", "dbstat", "name pgsize", schema_name="'main'"),
}

# --- BigQuery ----------------------------------------------------------------------------------------------------
_REGION = "`{project}`.`region-{region}`.INFORMATION_SCHEMA"
_BIGQUERY = {
    **_structure("schemata", f"{_REGION}.SCHEMATA", "schema_name"),
    **_structure(
        "tables",
        f"{_REGION}.TABLES t LEFT JOIN {_REGION}.TABLE_OPTIONS o ON o.table_schema = t.table_schema AND o.table_name = t.table_name "
        "AND o.option_name = 'description' WHERE t.table_type = 'BASE TABLE'",
        "t.table_schema", "t.table_name", "SAFE.STRING(SAFE.PARSE_JSON(o.option_value))",
    ),
    **_structure(
        "columns",
        f"{_REGION}.COLUMNS c LEFT JOIN {_REGION}.COLUMN_FIELD_PATHS p ON p.table_schema = c.table_schema "
        "AND p.table_name = c.table_name AND p.field_path = c.column_name",
        "c.table_schema", "c.table_name", "c.ordinal_position", "c.column_name", "c.data_type", "c.is_nullable", "c.column_default",
        "p.description",
    ),
    **_structure("views", f"{_REGION}.VIEWS", "table_schema", "table_name", "view_definition"),
    **_native("table_storage", f"{_REGION}.TABLE_STORAGE", "table_schema table_name deleted table_type total_logical_bytes total_rows"),
}

CATALOG_QUERIES: dict[str, dict[str, Relation]] = {
    "postgresql": _POSTGRESQL, "mysql": _MYSQL_FAMILY, "mariadb": _MYSQL_FAMILY, "mssql": _MSSQL, "oracle": _ORACLE, "db2": _DB2,
    "sqlite": _SQLITE, "bigquery": _BIGQUERY,
}
# Columns that name the schema of a row. Segments and indexes may lie in another schema than their table.
_SCHEMA_COLUMNS = ("schema_name", "table_schema", "routine_schema", "owner", "tabschema", "routineschema")
_ACROSS_SCHEMAS = ("schemata", "all_segments", "all_indexes")
SCHEMAS_PER_READ = 20


def catalog_query(source: Mapping[str, Any], relation: str) -> str:
    sql = CATALOG_QUERIES[source["db_type"]][relation].sql()
    if source["db_type"] == "bigquery":
        region = str((source.get("options") or {}).get("location", "US")).lower()
        sql = sql.format(project=source["database"], region=region)
    return sql


def conformed(rows: DataFrame, kind: str, relation: str) -> DataFrame:
    """``rows`` with exactly the columns and types of the relation; a missing column is an error, others are dropped."""
    types = CATALOG_QUERIES[kind][relation].types()
    lower = rows.toDF(*[c.lower() for c in rows.columns])
    missing = [c for c in types if c not in lower.columns]
    if missing:
        raise ValueError(f"{kind}.{relation} lacks {', '.join(missing)}")
    return lower.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


def schema_predicates(kind: str, relation: str, schemas: Sequence[str], size: int = SCHEMAS_PER_READ) -> list[str]:
    """One condition for each ``size`` schemas, so that a scan reads them at once and no others."""
    named = [c for c in _SCHEMA_COLUMNS if c in CATALOG_QUERIES[kind][relation].columns]
    if not named or relation in _ACROSS_SCHEMAS:
        return []
    quoted = ["'" + s.replace("'", "''") + "'" for s in sorted(set(schemas))]
    return [f"{named[0]} IN ({', '.join(quoted[i : i + size])})" for i in range(0, len(quoted), size)]


def scan(spark: SparkSession, source: Mapping[str, Any], relation: str, snapshot_id: int, schemas: Sequence[str] = ()) -> DataFrame:
    """One catalogue relation of one database; with ``schemas`` only these, in several reads at once."""
    kind, options, sql = source["db_type"], jdbc_options(source), catalog_query(source, relation)
    conditions = schema_predicates(kind, relation, schemas)
    if conditions and reader_format(source) == "jdbc":
        url = options.pop("url")
        rows = spark.read.jdbc(url, f"({sql}) q", predicates=conditions, properties=options)
    else:
        rows = spark.read.format(reader_format(source)).options(**options).option("query", sql).load()
    return conformed(rows.withColumn("snapshot_id", F.lit(snapshot_id)), kind, relation)


def land(
    spark: SparkSession, source: Mapping[str, Any], snapshot_id: int, folder: str, schemas: Sequence[str] = (), error_chars: int = 2000
) -> DataFrame:
    """Every relation of one database to ``folder``/kind/relation/snapshot_id=…; gives the relations that failed.

    A relation that cannot be read does not stop the others. Landing a snapshot again replaces it.
    """
    kind, failed = source["db_type"], []
    for relation in CATALOG_QUERIES[kind]:
        target = f"{folder.rstrip('/')}/{kind}/{relation}/snapshot_id={snapshot_id}"
        try:
            scan(spark, source, relation, snapshot_id, schemas).drop("snapshot_id").write.mode("overwrite").parquet(target)
        except (PySparkException, Py4JJavaError) as error:
            failed.append((snapshot_id, kind, relation, str(error)[:error_chars]))
    return spark.createDataFrame(failed, "snapshot_id BIGINT, db_type STRING, relation STRING, error STRING")


def landed(spark: SparkSession, folder: str, relation: str) -> DataFrame:
    """One flat relation landed as Parquet."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{relation}")


def landed_relations(spark: SparkSession, folder: str, kind: str) -> dict[str, DataFrame]:
    """The landed relations of one kind, all snapshots; relations that never landed are absent."""
    found = {}
    for relation, stated in CATALOG_QUERIES[kind].items():
        ddl = ", ".join(f"{c} {t}" for c, t in stated.types().items())
        try:
            found[relation] = spark.read.schema(ddl).parquet(f"{folder.rstrip('/')}/{kind}/{relation}").select(*stated.types())
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


# --- rows per column -> lists ------------------------------------------------------------------------------------
def with_boolean_nullable(columns: DataFrame) -> DataFrame:
    """Column rows with `nullable` as a boolean, from the YES/NO or Y/N text of the catalogue."""
    yes = F.upper("is_nullable").isin("YES", "Y")
    return columns.withColumns({"nullable": yes, "default": F.col("default_text")}).drop("is_nullable", "default_text")


def key_lists(key_columns: DataFrame, kind: str) -> DataFrame:
    """Rows per key column -> one row per key with `constrained_columns` in order.

    ``kind``: the catalogue's constraint type, 'PRIMARY KEY' / 'P' or 'UNIQUE' / 'U'. A key's columns are bounded by
    the database, so the list is small.
    """
    wanted = key_columns.where(F.col("constraint_type").isin(kind, kind[0]))
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "column_name")))
    return wanted.groupBy("snapshot_id", "schema_name", "table_name", "name").agg(
        F.transform(listed, lambda c: c["column_name"]).alias("constrained_columns")
    )


def reference_lists(reference_columns: DataFrame) -> DataFrame:
    """Rows per column of a foreign key -> one row per key with both column lists in order. A key may have no name."""
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "referred_column")))
    return reference_columns.groupBy("snapshot_id", "schema_name", "table_name", "key_id").agg(
        *[F.min(c).alias(c) for c in ("name", "referred_schema", "referred_table")],
        F.transform(listed, lambda c: c["column_name"]).alias("constrained_columns"),
        F.transform(listed, lambda c: c["referred_column"]).alias("referred_columns"),
    ).drop("key_id")


def index_lists(index_columns: DataFrame) -> DataFrame:
    """Rows per index column -> one row per index with `column_names` in order and `unique`."""
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "column_name")))
    return index_columns.groupBy("snapshot_id", "schema_name", "table_name", "name").agg(
        F.transform(listed, lambda c: c["column_name"]).alias("column_names"),
        F.bool_or(F.col("is_unique").cast("boolean")).alias("unique"),
    )
