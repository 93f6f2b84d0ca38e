"""Differences between snapshots."""

import json

from payloads import column, part, parts, payload, table
from pyspark.sql import functions as F

from schemaledger.operators import diff, flatten

OLD = payload(table("users", column("id")))
NEW = payload(table("users", column("id", "bigint"), column("email", "text")), table("orders"))


def _changes(spark, before, after, without=()):
    rows = parts(spark, part(1, before), part(2, after))
    pairs = spark.createDataFrame([(1, 2)], "from_snapshot_id BIGINT, to_snapshot_id BIGINT")
    return {(r["change"], r["key"]) for r in diff.snapshot_diff(rows, pairs, without).collect()}


def test_added_removed_and_changed_objects(spark):
    assert _changes(spark, OLD, NEW) == {
        ("added", "table:public.orders"), ("added", "column:public.users.email"), ("changed", "column:public.users.id"),
    }
    assert {k for c, k in _changes(spark, NEW, OLD) if c == "removed"} == {"table:public.orders", "column:public.users.email"}
    assert _changes(spark, NEW, NEW) == set()


def test_counts_keep_zeros(spark):
    rows = spark.createDataFrame([("added",), ("added",)], "change STRING")
    assert diff.diff_counts(rows).collect()[0].asDict() == {"added": 2, "removed": 0, "changed": 0}


def test_equality_of_values(spark):
    base = payload(table("t", column("c", extra={"a": 1, "b": [1, 2]})))
    same = json.dumps(payload(table("t", column("c", extra={"b": [1, 2], "a": 1.0}))))
    assert _changes(spark, base, same) == set()
    turned = payload(table("t", column("c", extra={"a": 1, "b": [2, 1]})))
    assert _changes(spark, base, turned) == {("changed", "column:public.t.c")}
    missing = payload(table("t", column("c", extra={"a": 1, "b": [1, 2]})))
    del missing["schemas"][0]["tables"][0]["columns"][0]["comment"]
    assert _changes(spark, base, missing) == {("changed", "column:public.t.c")}


def test_table_value_holds_storage_unless_left_out(spark):
    old = payload(table("t", storage={"total_bytes": 1}))
    new = payload(table("t", storage={"total_bytes": 2}))
    assert _changes(spark, old, new) == {("changed", "table:public.t")}
    assert _changes(spark, old, new, without=("storage",)) == set()


def test_last_of_repeated_names_wins(spark):
    body = payload()
    body["schemas"][0]["procedures"] = [{"name": "p", "definition": "a"}, {"name": "p", "definition": "b"}]
    rows = flatten.keyed_objects(flatten.objects(parts(spark, part(1, body)))).where("kind = 'procedure'").collect()
    assert [(r["key"], json.loads(r["value"])["definition"]) for r in rows] == [("procedure:public.p", "b")]


def test_names_with_dots_do_not_meet(spark):
    """'a.b' + 'c' and 'a' + 'b.c' print alike but are two objects."""
    body = payload(table("b.c"), schema="a")
    body["schemas"].append({"name": "a.b", "tables": [table("c")]})
    rows = flatten.keyed_objects(flatten.objects(parts(spark, part(1, body)))).where("kind = 'table'")
    assert [r["key"] for r in rows.collect()] == ["table:a.b.c", "table:a.b.c"]


def test_quotes_in_names(spark):
    body = payload(table('we"ird\\t', column('c"')))
    rows = flatten.objects(parts(spark, part(1, body)))
    assert {r["name"] for r in rows.where("kind IN ('table', 'column')").collect()} == {'we"ird\\t', 'c"'}


def test_key_order(spark):
    rows = spark.createDataFrame([("changed", "a"), ("added", "z"), ("removed", "b"), ("added", "c")], "change STRING, key STRING")
    assert [(r["change"], r["key"]) for r in diff.in_key_order(rows).collect()] == [
        ("added", "c"), ("added", "z"), ("removed", "b"), ("changed", "a"),
    ]


def test_pairs_of_other_sources_are_refused(spark):
    heads = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "snapshot_id BIGINT, data_source_id BIGINT")
    pairs = spark.createDataFrame([(7, 1, 2), (7, 1, 3), (7, 1, 9)], "data_source_id BIGINT, from_snapshot_id BIGINT, to_snapshot_id BIGINT")
    got = {r["to_snapshot_id"]: r["reason"] for r in diff.checked_pairs(pairs, heads).collect()}
    assert got == {2: None, 3: "other source", 9: "unknown snapshot"}


def test_counting_diff_equals_full_diff(spark):
    old = spark.range(0, 500).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("value"))
    new = spark.range(100, 600).select(F.col("id").alias("k"), (F.col("id") % 5).cast("string").alias("value"))
    full = diff.diff_counts(diff.diff(old, new, ["k"])).collect()
    assert full == diff.diff_counts(diff.diff(old, new, ["k"], values=False)).collect()
    assert full[0]["added"] == full[0]["removed"] == 100
