"""Catalogue relations: their contract, reads by schema, failures, and what a snapshot of them holds."""

import re

import pytest
from pyspark.sql import functions as F

from schemaledger import model
from schemaledger.operators import normalise
from schemaledger.plans import catalog_plan
from schemaledger.sources import catalogs

SOURCE = {"db_type": "postgresql", "host": "db", "database": "shop", "username": "reader", "password": "p"}
HEAD = (
    "snapshot_id BIGINT, data_source_id BIGINT, run_id BIGINT, captured_at TIMESTAMP_NTZ, source STRING, db_type STRING, database STRING, "
    "items ARRAY<STRING>, storage_growth BOOLEAN, username STRING, selected_schemas ARRAY<STRING>, dataset STRING"
)


def _extracts(spark, kind, **rows):
    found = {}
    for relation, stated in catalogs.CATALOG_QUERIES[kind].items():
        given = [{"snapshot_id": 1, **r} for r in rows.get(relation, [])]
        ddl = ", ".join(f"{c} {t}" for c, t in stated.types().items())
        found[relation] = spark.createDataFrame([tuple(r.get(c) for c in stated.types()) for r in given], ddl)
    return found


def _shop(spark, **more):
    return _extracts(
        spark, "postgresql", schemata=[{"schema_name": "app"}, {"schema_name": "log"}, {"schema_name": "pg_catalog"}],
        tables=[{"schema_name": s, "table_name": "t", "comment_text": "c"} for s in ("app", "log")],
        columns=[{"schema_name": "app", "table_name": "t", "ordinal": i, "name": n, "type": "int", "is_nullable": "NO"} for i, n in ((2, "b"), (1, "a"))],
        **more,
    )


def _heads(spark, items=None, schemas=None, kind="postgresql"):
    head = spark.createDataFrame([(1, 5, 9, None, "s", kind, "shop", items, False, "", schemas, None)], HEAD)
    return head.withColumn("captured_at", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


def test_a_scan_gives_the_columns_its_readers_get():
    for kind, relations in catalogs.CATALOG_QUERIES.items():
        assert set(relations) >= {"schemata", "columns"}
        for name, stated in relations.items():
            aliases = re.findall(r" AS (\w+)(?=, | FROM )", stated.sql().split(f" FROM {stated.source}")[0] + " FROM ")
            assert [a for a in aliases if a in stated.columns] == list(stated.columns), (kind, name)


def test_every_relation_has_a_reader():
    for kind, relations in catalogs.CATALOG_QUERIES.items():
        read = {r for _, reads in catalog_plan.normalisers(kind).values() for r in reads}
        assert read == set(relations), kind


def test_extract_without_a_column_is_refused(spark):
    rows = spark.createDataFrame([(1, "app", 3)], "SNAPSHOT_ID INT, SCHEMA_NAME STRING, extra INT")
    assert catalogs.conformed(rows, "mysql", "schemata").schema.simpleString() == "struct<snapshot_id:bigint,schema_name:string>"
    with pytest.raises(ValueError, match="mysql.views lacks name, definition"):
        catalogs.conformed(rows, "mysql", "views")


def test_reads_by_schema():
    got = catalogs.schema_predicates("mysql", "storage", ["b", "a", "o'x", "b"], size=2)
    assert got == ["table_schema IN ('a', 'b')", "table_schema IN ('o''x')"]
    assert catalogs.schema_predicates("oracle", "all_segments", ["A"]) == []
    assert catalogs.schema_predicates("postgresql", "pg_class", ["a"]) == []


def test_a_relation_that_fails_does_not_stop_the_others(spark, tmp_path, monkeypatch):
    readable = _shop(spark, index_columns=[{"schema_name": "app", "table_name": "t", "name": "i"}])

    def scan(spark, source, relation, snapshot_id, schemas=()):
        if relation == "index_columns":
            return readable[relation].select(F.raise_error(F.lit("no right to read")).alias("x"), "*")
        return readable[relation]

    monkeypatch.setattr(catalogs, "scan", scan)
    failures = catalogs.land(spark, SOURCE, 1, str(tmp_path)).collect()
    assert [r["relation"] for r in failures] == ["index_columns"] and "no right to read" in failures[0]["error"]
    monkeypatch.undo()
    failures = catalogs.land(spark, {**SOURCE, "db_type": "mariadb"}, 1, str(tmp_path))  # no driver here
    assert {r["relation"] for r in failures.collect()} == set(catalogs.CATALOG_QUERIES["mariadb"])
    assert catalogs.landed_relations(spark, str(tmp_path), "mariadb") == {}
    back = catalogs.landed_relations(spark, str(tmp_path), "postgresql")
    assert "index_columns" not in back or back["index_columns"].count() == 0
    assert back["columns"].schema == readable["columns"].schema and back["columns"].count() == 2


def test_listed_and_usable_schemas(spark):
    stored = catalog_plan.collected_catalogs(_heads(spark), {"postgresql": _shop(spark)})
    assert {r["name"] for r in stored.where("kind = 'schema'").collect()} == {"app", "log"}
    stored = catalog_plan.collected_catalogs(_heads(spark, schemas=["app", "gone"]), {"postgresql": _shop(spark)})
    assert [r["name"] for r in stored.where("kind = 'schema'").collect()] == ["app"]
    skipped = stored.where("kind = 'snapshot'").first()["skipped_schemas"]
    assert [(s["name"], s["reason"]) for s in skipped] == [("gone", model.SKIPPED_REASON)]
    table = stored.where("kind = 'table'").first()
    assert [c["name"] for c in table["columns"]] == ["a", "b"] and table["comment"] == "c"


@pytest.mark.parametrize("relation, items, lost", [
    ("pg_proc", None, True), ("pg_proc", ["TABLE"], False), ("index_columns", None, False), ("columns", ["VIEW"], False),
    ("schemata", ["VIEW"], True), ("pg_class", None, False),
])
def test_failed_relations_skip_schemas_only_where_asked_for(spark, relation, items, lost):
    failures = spark.createDataFrame([(1, "postgresql", relation)], "snapshot_id BIGINT, db_type STRING, relation STRING")
    stored = catalog_plan.collected_catalogs(_heads(spark, items), {"postgresql": _shop(spark)}, failures)
    assert {r["name"] for r in stored.where("kind = 'schema'").collect()} == (set() if lost else {"app", "log"})
    assert len(stored.where("kind = 'snapshot'").first()["skipped_schemas"]) == (2 if lost else 0)


def test_nothing_landed_leaves_the_facts_and_the_listed_schemas(spark):
    stored = catalog_plan.collected_catalogs(_heads(spark, schemas=["app"]), {"postgresql": {}})
    assert [(r["kind"], [s["name"] for s in r["skipped_schemas"]]) for r in stored.collect()] == [("snapshot", ["app"])]


def test_references_keep_order_and_keys_without_a_name(spark):
    rows = [
        {"schema_name": "main", "table_name": "t", "key_id": k, "ordinal": o, "column_name": c, "referred_table": r, "referred_column": x}
        for k, o, c, r, x in (("0", 1, "b", "p", "y"), ("0", 0, "a", "p", "x"), ("1", 0, "c", "q", None))
    ]
    got = catalogs.reference_lists(_extracts(spark, "sqlite", reference_columns=rows)["reference_columns"]).collect()
    assert sorted((r["constrained_columns"], r["referred_table"], r["referred_columns"]) for r in got) == [
        (["a", "b"], "p", ["x", "y"]), (["c"], "q", [None])]


def test_mysql_grantee_with_a_host(spark):
    rows = [("app", "t", "SELECT", g, "reader@10.%") for g in ("'reader'@'10.%'", "'reader@10.%'", "'other'@'10.%'", "'reader'@'%'")]
    given = spark.createDataFrame(rows, "table_schema STRING, table_name STRING, privilege_type STRING, grantee STRING, reading_user STRING")
    assert normalise.grants_mysql(given.withColumn("snapshot_id", F.lit(1))).count() == 2
