"""Reader options, catalogue queries, ledger rules and stream ingest."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from schemaledger import model
from schemaledger.operators import access, collect, ledger, normalise
from schemaledger.sources import catalogs, connections

BASE = {"host": "db", "database": "shop", "username": "reader", "password": "p@ss/word"}


@pytest.mark.parametrize("kind, url", [
    ("postgresql", "jdbc:postgresql://db:5432/shop"), ("mysql", "jdbc:mysql://db:3306/shop"),
    ("mariadb", "jdbc:mariadb://db:3306/shop"), ("mssql", "jdbc:sqlserver://db:1433;databaseName=shop"),
    ("oracle", "jdbc:oracle:thin:@//db:1521/shop"), ("db2", "jdbc:db2://db:50000/shop"), ("sqlite", "jdbc:sqlite:shop"),
])
def test_reader_options(kind, url):
    options = connections.jdbc_options({**BASE, "db_type": kind}, "docker")
    assert options["url"] == url and "p@ss/word" not in url
    if kind != "sqlite":
        assert (options["user"], options["password"]) == ("reader", "p@ss/word")


def test_reader_option_details():
    oracle = connections.jdbc_options({**BASE, "db_type": "oracle", "port": 1600, "options": {"service_name": "svc"}})
    assert oracle["url"].endswith(":1600/svc")
    assert connections.jdbc_options({**BASE, "db_type": "mssql"})["trustServerCertificate"] == "true"
    tls = connections.jdbc_options({**BASE, "db_type": "postgresql", "ssl_ca_path": "/ca", "options": {"ssl_enabled": True, "connect_args": {"sslmode": "verify-full"}}})
    assert (tls["sslrootcert"], tls["sslmode"]) == ("/ca", "verify-full")
    with pytest.raises(ValueError):
        connections.jdbc_options({**BASE, "db_type": "access"})


def test_bigquery_options():
    source = {"db_type": "bigquery", "database": "my-project-1", "service_account": {"project_id": "p"}, "options": {"dataset": "d"}}
    options = connections.jdbc_options(source)
    assert json.loads(base64.b64decode(options["credentials"])) == {"project_id": "p"} and options["dataset"] == "d"
    assert "`region-us`" in catalogs.catalog_query(source, "table_storage")
    for change in ({"database": "Bad Project"}, {"service_account": None}, {"options": {"location": "us_1"}}):
        with pytest.raises(ValueError):
            connections.jdbc_options({**source, **change})


def test_every_kind_has_catalogue_queries():
    assert set(catalogs.CATALOG_QUERIES) == set(model.DB_TYPES)


def test_supported_kinds(spark):
    rows = spark.createDataFrame([("mssql",), ("oracle",), ("postgresql",), ("access",), (None,)], "db_type STRING")
    assert [r["supported"] for r in collect.with_support(rows, "docker").collect()] == [True, True, True, False, False]


def test_index_lists(spark):
    rows = spark.createDataFrame([(1, "s", "t", "i", 2, "b", 1), (1, "s", "t", "i", 1, "a", 1)],
                                 "snapshot_id BIGINT, schema_name STRING, table_name STRING, name STRING, ordinal INT, column_name STRING, is_unique INT")
    got = catalogs.index_lists(rows).collect()[0]
    assert (got["column_names"], got["unique"]) == (["a", "b"], True)


def test_oracle_routine_text(spark):
    procedures = spark.createDataFrame([(1, "APP", "SYNC_DATA", "PROCEDURE"), (1, "APP", "NONE", "FUNCTION")], "snapshot_id BIGINT, owner STRING, object_name STRING, object_type STRING")
    source = spark.createDataFrame([(1, "APP", "SYNC_DATA", "PROCEDURE", 2, "BEGIN"), (1, "APP", "SYNC_DATA", "PROCEDURE", 1, "CREATE OR REPLACE PROCEDURE SYNC_DATA")],
                                   "snapshot_id BIGINT, owner STRING, name STRING, type STRING, line INT, text STRING")
    got = {r["name"]: r["definition"] for r in normalise.routines_oracle(procedures, source).collect()}
    assert got == {"SYNC_DATA": "CREATE OR REPLACE PROCEDURE SYNC_DATA\nBEGIN", "NONE": None}


def test_logs_in_order(spark):
    rows = spark.createDataFrame([(1, 5, 2, "info"), (2, 5, 1, "error"), (3, 6, 1, "info")], "id BIGINT, run_id BIGINT, sequence BIGINT, level STRING").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert [r["level"] for r in ledger.logs_of_run(rows, 5).collect()] == ["error", "info"]


def test_own_account_is_kept(spark):
    requests = spark.createDataFrame([(1, 1), (2, 1)], "id BIGINT, requested_by BIGINT")
    allowed, refused = ledger.user_deletes(requests)
    assert [r["id"] for r in allowed.collect()] == [2]
    assert [(r["id"], r["reason"]) for r in refused.collect()] == [(1, "own account")]


def test_effective_access_keeps_repeated_menus(spark):
    links = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "user_id BIGINT, role_name STRING")
    codes = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "role_name STRING, code STRING")
    menus = spark.createDataFrame([("a", "home"), ("b", "home")], "role_name STRING, menu_code STRING")
    got = {r["user_id"]: (r["roles"], r["permissions"], r["menus"]) for r in access.effective_access(links, codes, menus).collect()}
    assert got == {1: (["a", "b"], ["x", "y"], ["home", "home"]), 2: (["c"], [], [])}
