"""Data model: fixed values and Spark types of the catalogue."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values. Results depend on these being exactly what they are.
# ---------------------------------------------------------------------------
DB_TYPES = ("postgresql", "mysql", "mariadb", "mssql", "oracle", "sqlite", "db2", "bigquery")
EXCLUDED_DB_TYPES = {"local": (), "docker": ()}
DEFAULT_PORTS = {"postgresql": 5432, "mysql": 3306, "mariadb": 3306, "mssql": 1433, "oracle": 1521, "db2": 50000}
SYSTEM_SCHEMAS = ("information_schema", "performance_schema", "mysql", "sys", "pg_catalog")

DEFAULT_ITEMS = ("INDEX", "TABLE", "VIEW", "PROCEDURE", "SELECT PRIVILEGE")
ALL_ITEMS = (
    "INDEX", "TABLE", "VIEW", "PROCEDURE", "SELECT PRIVILEGE", "TRIGGER", "TABLE PARTITION", "INDEX PARTITION",
    "TABLE SUBPARTITION", "INDEX SUBPARTITION", "MVIEW", "SEQUENCE", "DATABASE LINK", "SYNONYM",
)
LEGACY_ITEMS = ("INDEX", "TABLE", "VIEW", "PROCEDURE")

OBJECT_KINDS = ("schema", "table", "column", "index", "view", "procedure")
LISTED_KINDS = ("table", "column", "index", "view", "procedure")
EXPORT_SHEETS = (
    "SUMMARY", "TABLE", "COLUMN", "VIEW", "INDEX", "FOREIGN KEY", "PROCEDURE", "SELECT PRIVILEGE", "STORAGE",
)

NAME_LENGTH = (2, 120)
AUTH_TYPES = ("password", "private_key")
SCHEDULE_TYPES = ("cron", "interval", "manual")
DUPLICATE_POLICIES = ("skip", "overwrite", "rename")
SECRET_FIELDS = (
    "password", "service_account_json", "ssl_ca_cert", "ssl_cert", "ssl_key", "ssh_password", "ssh_private_key",
    "ssh_private_key_passphrase",
)
TLS_SECRETS = ("ssl_ca_cert", "ssl_cert", "ssl_key")
REDACTED = "[REDACTED]"
NOT_COLLECTED = "not_collected"
ADMIN_CODE = "admin:*"
NAVIGATION = ("dashboard", "sources", "metadata", "jobs", "users", "roles")
SYSTEM_ROLE = "시스템 관리자"

LIST_ERROR_CHARS = 300
RUN_LIST_LIMIT = 100
RUN_DASHBOARD_LIMIT = 8

# For full matches.
BIGQUERY_PROJECT = "[a-z0-9][a-z0-9-]{4,61}[a-z0-9]"
BIGQUERY_REGION = "[a-z0-9-]+"
TEMPLATE_NAME = r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}"
FILE_STEM_OTHER = "[^0-9A-Za-z가-힣_-]+"
FILE_STEM_TIME = "yyyyMMdd_HHmmss"

SKIPPED_REASON = "접근 권한이 없거나 메타데이터를 조회할 수 없습니다."
LABEL_TABLE, LABEL_VIEW = "테이블", "뷰"
LABEL_PRIVILEGE = {"unknown": "조회 권한 미수집", "allowed": "조회 가능", "denied": "조회 권한 없음"}
LABEL_OPTION = {"storage": "기본 + 스토리지 증가량", "plain": "기본 메타데이터"}
LABEL_JOB = "작업 #"
LABEL_EVERY, LABEL_MANUAL = "분마다", "수동"
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")
NO_VALUE = "—"
SUMMARY_SECTIONS = ("수집 정보", "객체 요약", "스토리지 요약 (Bytes)")
SUMMARY_INFO = ("데이터 소스", "DB 종류", "데이터베이스", "수집 시각", "Fingerprint", "수집 옵션")
SUMMARY_TOTALS = ("스키마", "테이블", "뷰", "컬럼", "인덱스", "외래 키")
SUMMARY_STORAGE = ("데이터", "인덱스", "전체", "이전 대비 증가량", "관측 테이블", "비교 가능 테이블")

# ---------------------------------------------------------------------------
# Spark types (DDL)
# ---------------------------------------------------------------------------
PERMISSIONS = "STRUCT<select: BOOLEAN, privileges: ARRAY<STRING>, checked_as: STRING>"
STORAGE_SUMMARY = (
    "STRUCT<data_bytes: BIGINT, index_bytes: BIGINT, total_bytes: BIGINT, growth_bytes: BIGINT, "
    "observed_tables: BIGINT, comparable_tables: BIGINT>"
)

HEADER_COLUMNS = ("snapshot_id", "data_source_id", "run_id", "captured_at")
TABLE_KEY = ("snapshot_id", "schema_name", "table_name")

# The snapshot store: one row per snapshot (its facts) and one per schema, table, view and routine, told apart by `kind`.
# Lists inside a table are typed, so a reader names the leaves it wants and the scan reads no others.
SNAPSHOT, SCHEMA, TABLE_KIND, VIEW_KIND, ROUTINE_KIND = "snapshot", "schema", "table", "view", "procedure"
LISTS = {
    "columns": "name STRING, type STRING, nullable BOOLEAN, default STRING, comment STRING",
    "foreign_keys": (
        "name STRING, constrained_columns ARRAY<STRING>, referred_schema STRING, referred_table STRING, "
        "referred_columns ARRAY<STRING>"
    ),
    "indexes": "name STRING, column_names ARRAY<STRING>, unique BOOLEAN",
    "unique_constraints": "name STRING, column_names ARRAY<STRING>",
}
PRIMARY_KEY = "STRUCT<constrained_columns: ARRAY<STRING>, name: STRING>"
STORAGE = (
    "STRUCT<data_bytes: BIGINT, index_bytes: BIGINT, total_bytes: BIGINT, row_estimate: BIGINT, "
    "previous_total_bytes: BIGINT, growth_bytes: BIGINT, growth_percent: DOUBLE>"
)
SKIPPED = "ARRAY<STRUCT<name: STRING, reason: STRING>>"


def _list_type(name: str) -> str:
    return f"ARRAY<STRUCT<{', '.join(f.strip().replace(' ', ': ', 1) for f in LISTS[name].split(','))}>>"


STORED = ", ".join([
    "kind STRING, snapshot_id BIGINT, data_source_id BIGINT, run_id BIGINT, captured_at TIMESTAMP_NTZ",
    # of a snapshot
    f"source STRING, db_type STRING, database STRING, items ARRAY<STRING>, storage_growth BOOLEAN, skipped_schemas {SKIPPED}",
    f"storage_summary {STORAGE_SUMMARY}",
    # of an object; `position` is its place in a document it came from
    "schema_name STRING, name STRING, position BIGINT, comment STRING",
    *[f"{n} {_list_type(n)}" for n in LISTS],
    f"primary_key {PRIMARY_KEY}, permissions {PERMISSIONS}, storage {STORAGE}",
    "definition STRING, routine_type STRING, return_type STRING, arguments STRING",
    # `raw`: the object as it was, where the fields above do not say all of it; `digest`: SHA-256 of the object
    "raw STRING, digest STRING",
    "month INT, source_bucket INT",
])
# Folders of the store; a source keeps its bucket.
PARTITIONS = ("kind", "month", "source_bucket")
SOURCE_BUCKETS = 4
