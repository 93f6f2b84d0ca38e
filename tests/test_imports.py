"""Import files, validation and duplicate policies, against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from schemaledger.functions import templates
from schemaledger.operators import imports
from schemaledger.sources import imports as files

ROW, STORED = "row_no BIGINT, name STRING, val BIGINT", "name STRING, val BIGINT"


def _brute(rows, stored, policy):
    """One row after the other, as a person would do it."""
    table, finals = dict(stored), []
    for number, name, value in rows:
        if name not in table:
            table[name] = value
            finals.append((number, name, "created"))
        elif policy == "skip":
            finals.append((number, name, "skipped"))
        elif policy == "overwrite":
            table[name] = value
            finals.append((number, name, "updated"))
        else:
            free = next(f"{name} ({n})" for n in range(2, 10_000) if f"{name} ({n})" not in table)
            table[free] = value
            finals.append((number, free, "created"))
    return finals, table


def _check(spark, rows, stored, policy):
    incoming = spark.createDataFrame(rows, ROW).coalesce(1)
    held = spark.createDataFrame(list(stored.items()), STORED).coalesce(1)
    finals, table = _brute(rows, stored, policy)
    actions = imports.import_actions(incoming, held, policy).collect()
    assert sorted((r["row_no"], r["final_name"], r["action"]) for r in actions) == sorted(finals)
    after = {r["name"]: r["val"] for r in imports.imported(incoming, held, policy).collect()}
    assert after == table


@pytest.mark.parametrize("policy, seed", [("skip", 0), ("skip", 1), ("overwrite", 0), ("overwrite", 1), ("rename", 2)])
def test_policies_equal_row_by_row_import(spark, policy, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "a (2)", "a (3)", "b (2)", "b (2) (2)", "c (02)", "c (1)", "d (7)"]
    stored = {n: i for i, n in enumerate(rng.sample(names, 4))}
    rows = [(n, rng.choice(names), 100 + n) for n in range(1, 40)]
    _check(spark, rows, stored, policy)


def test_rename_of_one_hot_name(spark):
    stored = {"hot": 0, "hot (2)": 0, "hot (3)": 0, "hot (7)": 0, "hot (1)": 0, "hot (100)": 0}
    _check(spark, [(n, "hot", n) for n in range(1, 301)], stored, "rename")


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        imports.import_actions(spark.createDataFrame([], ROW), spark.createDataFrame([], STORED), "merge")


def test_import_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("connections:\n  - name: one\n    ssh: {host: h, port: 22}\n  - name: two\n    password: ${SECRET}\n")
    (tmp_path / "b.json").write_bytes(b"\xef\xbb\xbf" + json.dumps([{"name": "three", "port": 5}]).encode())
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.yaml").write_text("connections: []")
    (tmp_path / "e.json").write_bytes(b"\xff\xfe[]")
    (tmp_path / "f.yml").write_text("#" + "x" * (2 * 1024 * 1024))
    (tmp_path / "g.json").write_text('{"jobs": [{"name": "other"}]}')
    items, errors = files.read_import_files(spark, str(tmp_path), "connections", max_bytes=2 << 20)
    rows = files.fields(items, {"name": "string", "port": "int"}).orderBy("name").collect()
    assert [(r["name"], r["row_no"], r["port"]) for r in rows] == [("one", 1, None), ("three", 1, 5), ("two", 2, None)]
    got = {r["file"].rsplit("/", 1)[-1]: r["error"] for r in errors.collect()}
    assert sorted(got) == ["c.json", "d.yaml", "e.json", "f.yml", "g.json"]
    assert got["f.yml"] == "larger than 2097152 bytes"
    flat = items.select(templates.flattened_ssh(F.col("item")).alias("item"))
    read = flat.select(F.variant_get(F.col("item")["ssh_host"], "$", "string").alias("h"), F.variant_get(F.col("item")["ssh_enabled"], "$", "boolean").alias("e"))
    assert {(r["h"], r["e"]) for r in read.collect()} == {("h", True), (None, None)}


def test_row_errors_do_not_stop_the_rest(spark):
    rows = spark.createDataFrame([("ok", "oracle", None), ("x", "oracle", None), ("ok2", "access", "agent")], "name STRING, db_type STRING, ssh_auth_type STRING")
    valid, rejected = imports.split_valid(imports.with_source_errors(rows))
    assert [r["name"] for r in valid.collect()] == ["ok"]
    assert {r["name"]: r["error"].count(";") for r in rejected.collect()} == {"x": 0, "ok2": 1}


def test_template_lookup_is_exact(spark):
    lookup = F.create_map(F.lit("A"), F.lit("${B}$1\\2"), F.lit("B"), F.lit("b"))
    rows = spark.createDataFrame([("${A}-${B}",), ("${A}${C}",), ("$A {B} ${1}",)], "t STRING")
    got = [tuple(r) for r in rows.select(templates.resolved_text(F.col("t"), lookup), templates.missing_names(F.col("t"), lookup)).collect()]
    assert got == [("${B}$1\\2-b", []), (None, ["C"]), ("$A {B} ${1}", [])]
