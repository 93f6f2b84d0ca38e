"""Assembly, fingerprints, flattening and sheets on small snapshots."""

import datetime as dt
import json

import pytest
from payloads import column, part, parts, payload, table
from pyspark.sql import functions as F

from schemaledger import model
from schemaledger.functions.values import fingerprint
from schemaledger.operators import collect, flatten, history, search, sheets
from schemaledger.plans.collection import collected
from schemaledger.session import written
from schemaledger.sources import documents, store

HEADER = (
    "snapshot_id BIGINT, data_source_id BIGINT, run_id BIGINT, captured_at TIMESTAMP_NTZ, source STRING, db_type STRING, "
    "database STRING, items ARRAY<STRING>, storage_growth BOOLEAN, skipped_schemas ARRAY<STRUCT<name: STRING, reason: STRING>>"
)


_WRITTEN = {}


def _relations(spark, snapshot=1):
    """Two tables, a foreign key, an index, a view and a wildcard grant."""
    if snapshot not in _WRITTEN:
        _WRITTEN[snapshot] = {n: written(r) for n, r in _rows(spark, snapshot).items()}
    return dict(_WRITTEN[snapshot])


def _rows(spark, snapshot):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1)
    s = snapshot
    return {
        "schemas": frame([(s, "main"), (s, "empty")], "snapshot_id BIGINT, schema_name STRING"),
        "tables": frame([(s, "main", "teams", None), (s, "main", "members", "people")],
                        "snapshot_id BIGINT, schema_name STRING, table_name STRING, comment STRING"),
        "columns": frame(
            [(s, "main", "members", i, n, t, True) for i, (n, t) in enumerate([("id", "INTEGER"), ("team_id", "INTEGER"), ("email", "TEXT")])]
            + [(s, "main", "teams", i, n, t, i > 0) for i, (n, t) in enumerate([("id", "INTEGER"), ("name", "TEXT")])],
            "snapshot_id BIGINT, schema_name STRING, table_name STRING, ordinal BIGINT, name STRING, type STRING, nullable BOOLEAN"),
        "primary_keys": frame([(s, "main", "teams", ["id"], None), (s, "main", "members", ["id"], None)],
                              "snapshot_id BIGINT, schema_name STRING, table_name STRING, constrained_columns ARRAY<STRING>, name STRING"),
        "foreign_keys": frame([(s, "main", "members", "fk", ["team_id"], None, "teams", ["id"])],
                              "snapshot_id BIGINT, schema_name STRING, table_name STRING, name STRING, constrained_columns ARRAY<STRING>, "
                              "referred_schema STRING, referred_table STRING, referred_columns ARRAY<STRING>"),
        "indexes": frame([(s, "main", "members", "ix_members_email", ["email"], False)],
                         "snapshot_id BIGINT, schema_name STRING, table_name STRING, name STRING, column_names ARRAY<STRING>, unique BOOLEAN"),
        "unique_constraints": frame([(s, "main", "teams", None, ["name"])],
                                    "snapshot_id BIGINT, schema_name STRING, table_name STRING, name STRING, column_names ARRAY<STRING>"),
        "storage": frame([(s, "main", "teams", 10, 5, 15, None)],
                         "snapshot_id BIGINT, schema_name STRING, table_name STRING, data_bytes BIGINT, index_bytes BIGINT, total_bytes BIGINT, row_estimate BIGINT"),
        "views": frame([(s, "main", "member_view", "SELECT 1")], "snapshot_id BIGINT, schema_name STRING, name STRING, definition STRING"),
        "routines": frame([], "snapshot_id BIGINT, schema_name STRING, name STRING, routine_type STRING, definition STRING"),
        "grants": frame([(s, "main", "*", (True, ["SELECT"], "sqlite"))],
                        f"snapshot_id BIGINT, schema_name STRING, name STRING, permissions {model.PERMISSIONS}"),
    }


def _headers(spark, *ids, storage=False):
    rows = [
        (i, 1, i + 10, dt.datetime(2024, 1, i), "sample", "sqlite", "file.db", ["TABLE"], storage, [("secret", model.SKIPPED_REASON)])
        for i in ids
    ]
    return spark.createDataFrame(rows, HEADER)


def _tree(assembled):
    return json.loads(documents.to_documents(assembled).collect()[0]["payload"])


def test_whole_snapshot(spark):
    assembled = written(collect.assemble(_headers(spark, 1), _relations(spark)))
    tree = _tree(assembled)
    assert [s["name"] for s in tree["schemas"]] == ["empty", "main"]
    main = tree["schemas"][1]
    assert [t["name"] for t in main["tables"]] == ["members", "teams"]
    members, teams = main["tables"]
    assert [c["name"] for c in members["columns"]] == ["id", "team_id", "email"]
    assert members["foreign_keys"][0]["referred_table"] == "teams"
    assert members["indexes"][0]["name"] == "ix_members_email"
    assert teams["unique_constraints"] == [{"name": None, "column_names": ["name"]}]
    assert main["views"][0]["permissions"] == {"select": True, "privileges": ["SELECT"], "checked_as": "sqlite"}
    assert main["procedures"] == []
    assert members["storage"] is None
    assert tree["skipped_schemas"] == [{"name": "secret", "reason": model.SKIPPED_REASON}]
    assert history.collected_objects(assembled).collect()[0]["object_count"] == 3
    marks = collect.fingerprints(assembled).collect()
    assert len(marks[0]["fingerprint"]) == 64


def test_a_row_holds_one_object(spark):
    assembled = written(collect.assemble(_headers(spark, 1), _relations(spark)))
    assert sorted((r["kind"], r["name"]) for r in assembled.collect()) == [
        ("schema", "empty"), ("schema", "main"), ("snapshot", None), ("table", "members"), ("table", "teams"), ("view", "member_view"),
    ]
    other = _relations(spark)
    other["columns"] = other["columns"].withColumn("type", F.concat("type", F.lit("x")))
    assert collect.fingerprints(collect.assemble(_headers(spark, 1), other)).collect() != collect.fingerprints(assembled).collect()


def test_documents_round_trip(spark):
    """Assembled rows, written as documents and read again, are the same rows, digests and fingerprints."""
    assembled = written(collect.assemble(_headers(spark, 1, storage=True), _relations(spark)))
    again = written(documents.from_documents(documents.to_documents(assembled)))
    for operator in (history.snapshot_summary, history.export_totals, flatten.snapshot_history, flatten.column_details, flatten.privileges, flatten.table_details):
        assert sorted(map(str, operator(assembled).collect())) == sorted(map(str, operator(again).collect()))
    keyed = lambda p: {(r["key"], r["value"]) for r in flatten.keyed_objects(flatten.objects(p)).collect()}
    assert keyed(assembled) == keyed(again)
    assert again.where("raw IS NOT NULL").count() == 0
    by_schema = lambda p: sorted(map(str, collect.digest_tree(p.where("kind <> 'table'"), "schema_name").collect()))
    assert by_schema(assembled) == by_schema(again)
    strange = parts(spark, part(1, payload(table("t", column("c", extra=1), comment="x"), schema='we"ird')), part(2, "not json"))
    once = written(documents.to_documents(strange))
    assert json.loads(once.where("snapshot_id = 1").collect()[0]["payload"])["schemas"][0]["tables"][0]["columns"][0]["extra"] == 1
    assert keyed(strange) == keyed(documents.from_documents(once))


def test_grants_alone_make_no_schema(spark):
    relations = _relations(spark)
    relations["grants"] = relations["grants"].withColumn("schema_name", F.lit("elsewhere"))
    assert [s["name"] for s in _tree(collect.assemble(_headers(spark, 1), relations))["schemas"]] == ["empty", "main"]


def test_empty_snapshot_keeps_its_header(spark):
    empty = {n: r.limit(0) for n, r in _relations(spark).items()}
    assembled = written(collect.assemble(_headers(spark, 1), empty))
    assert _tree(assembled)["schemas"] == []
    summary = history.snapshot_summary(assembled).collect()[0]
    assert (summary["schema_count"], summary["table_count"], len(summary["skipped_schemas"])) == (0, 0, 1)
    assert flatten.snapshot_history(assembled).collect()[0]["schema_count"] == 0


def test_only_selected_items(spark):
    items = spark.createDataFrame([(1, ["TABLE"])], "snapshot_id BIGINT, items ARRAY<STRING>")
    kept = collect.selected_relations(_relations(spark), items)
    assembled = collect.assemble(_headers(spark, 1), {**_relations(spark), **kept})
    main = _tree(assembled)["schemas"][1]
    assert main["views"] == [] and main["procedures"] == [] and main["tables"][0]["indexes"] == []
    assert main["tables"][0]["permissions"] == {"select": None, "privileges": [], "checked_as": "not_collected"}


def test_growth_between_two_collections(spark):
    first, second = _relations(spark, 1), _relations(spark, 2)
    relations = {n: first[n].unionAll(second[n]) for n in first}
    assembled = written(collected(_headers(spark, 1, 2, storage=True), relations))
    sizes = {(r["snapshot_id"], r["table_name"]): r for r in flatten.table_details(assembled).collect()}
    assert sizes[(1, "teams")]["growth_bytes"] is None
    assert (sizes[(2, "teams")]["growth_bytes"], sizes[(2, "teams")]["growth_percent"]) == (0, 0.0)
    assert (sizes[(2, "members")]["total_bytes"], sizes[(2, "members")]["growth_percent"]) == (0, None)
    summary = [r["storage_summary"] for r in assembled.where("kind = 'snapshot'").orderBy("snapshot_id").collect()]
    assert [s["comparable_tables"] for s in summary] == [0, 2] and summary[1]["total_bytes"] == 15
    marks = {r["fingerprint"] for r in collect.fingerprints(assembled).collect()}
    assert len(marks) == 1, "growth does not enter the fingerprint"


def test_fingerprint_order_rules(spark):
    texts = ['{"a":1,"b":[1,2]}', '{ "b": [1, 2], "a": 1 }', '{"a":1,"b":[2,1]}', "not json"]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select(fingerprint(F.col("t")).alias("f")).collect()
    assert rows[0] == rows[1] and rows[0] != rows[2] and rows[3]["f"] is None


def test_store_append_and_scan(spark, tmp_path):
    path = str(tmp_path / "store")
    store.append_snapshots(parts(spark, part(1, payload(table("t", column("c"))), source_id=3)), path)
    store.append_snapshots(parts(spark, part(2, payload(), source_id=4)), path)
    back = store.read_snapshots(spark, path)
    assert store.headers(back).count() == 2
    one = store.snapshot_by_id(back, 1, 3)
    assert [(r["kind"], r["name"]) for r in one.orderBy("kind").collect()] == [("schema", "public"), ("snapshot", None), ("table", "t")]
    assert "PartitionFilters: [isnotnull(source_bucket" in one._jdf.queryExecution().toString()


def test_open_payloads_read_leniently(spark):
    body = {"schemas": [{"name": "s", "tables": [{"name": "t", "columns": [{"name": "c", "type": "int", "nullable": "YES"}], "indexes": [{"name": "i", "column_names": [None, "x"], "unique": 1}]}]}, {"name": "bare"}, {"name": "n", "tables": None}]}
    rows = parts(spark, part(1, body))
    assert flatten.column_history(rows).collect()[0]["nullable"] is True
    assert [(r["schema_name"], r["table_count"]) for r in flatten.schema_history(rows).orderBy("schema_name").collect()] == [("bare", 0), ("n", 0), ("s", 1)]
    index = sheets.indexes(rows).collect()[0]
    assert (index["columns"], index["is_unique"]) == (", x", True)
    assert history.snapshot_summary(rows).collect()[0]["schema_count"] == 3


def test_sheets_with_null_entries(spark):
    body = payload(table("t", column("c"), primary_key={"constrained_columns": [None, "c"]},
                         foreign_keys=[{"name": "fk", "constrained_columns": [None], "referred_schema": None, "referred_table": "r", "referred_columns": None}]))
    body["schemas"][0]["procedures"] = [{"name": "p", "type": "FUNCTION", "routine_type": "", "body": "b", "definition": None}]
    rows = parts(spark, part(1, body))
    made = sheets.export_sheets(rows, rows.select("snapshot_id", F.lit("f").alias("fingerprint")).distinct())
    assert list(made) == list(model.EXPORT_SHEETS)
    assert made["TABLE"].collect()[0]["primary_key"] == ", c"
    assert (made["FOREIGN KEY"].collect()[0]["local_columns"], made["FOREIGN KEY"].collect()[0]["referred_columns"]) == ("", "")
    assert (made["PROCEDURE"].collect()[0]["routine_type"], made["PROCEDURE"].collect()[0]["definition"]) == ("FUNCTION", "b")
    assert made["COLUMN"].collect()[0]["is_primary_key"] is True
    assert made["SUMMARY"].count() == 12, "no storage block without a storage summary"
    assert sheets.export_sheets(rows, rows, set()) == {}
    assert "data_bytes" not in sheets.export_sheets(rows, rows, {"TABLE"})["TABLE"].columns


def test_object_listing(spark):
    rows = flatten.objects(parts(spark, part(1, payload(table("t", column("a"), column("b"))))))
    assert search.snapshot_objects(rows).count() == 3
    assert search.snapshot_objects(rows, kind="schema").count() == 0
    assert search.snapshot_objects(rows, "other").count() == 0
    with pytest.raises(ValueError):
        search.snapshot_objects(rows, kind="trigger")
