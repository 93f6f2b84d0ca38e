"""What several relations follow from is worked out once, and only for the snapshots asked for."""

import datetime

import pytest
import test_assembly as small

from schemaledger.operators import collect
from schemaledger.plans import collection, driver_tables as p1, landed_catalogs
from schemaledger.session import written

_KINDS = ("postgresql", "mysql", "mariadb", "mssql", "oracle", "sqlite", "db2", "bigquery")


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """Eight sources of one kind each, three tables, two years; a customer without nation and an order without customer."""
    sf = str(tmp_path_factory.mktemp("given"))
    rows = {
        "region": [(0, "R")], "nation": [(n, f"N{n}", 0) for n in range(8)],
        "customer": [(k, f"c{k}", k % 8 if k else None, 1.0 if k % 3 else -1.0, ("BUILDING", "MACHINERY")[k % 2]) for k in range(24)],
        "orders": [(o, o % 25, "OF"[o % 2], 10.0 + o, datetime.datetime(1995 + o // 50, 3, 1), ("1-URGENT", "2-HIGH", "5-LOW")[o // 25 % 3]) for o in range(100)],
    }
    for name, own in rows.items():
        spark.createDataFrame(own, p1.SCHEMAS[name]).write.parquet(f"{sf}/{name}.parquet")
    return sf


def test_extracts_follow_from_the_column_and_index_relations(spark, given):
    heads = written(landed_catalogs.headers(spark, given))
    base, indexes = written(p1.columns(spark, given)), written(p1.indexes(spark, given))
    found = landed_catalogs.extracts(spark, given, _KINDS, heads, base, indexes)
    assert set(found) == set(_KINDS)
    read = {(kind, r): [f for f in rows.inputFiles() if "/orders.parquet/" in f] for kind, relations in found.items() for r, rows in relations.items()}
    assert not any(read.values())


def test_landed_extracts_hold_all_rows_of_their_kind_only(spark, given):
    heads = landed_catalogs.headers(spark, given)
    found = landed_catalogs.landed(spark, given, ("db2", "oracle"))
    columns = p1.columns(spark, given)
    for kind, relations in found.items():
        ours = heads.where(f"db_type = '{kind}'").select("snapshot_id")
        wanted = columns.join(ours, "snapshot_id", "left_semi").select("snapshot_id", "schema_name", "table_name", "column_name")
        got = relations["columns"].select("snapshot_id", "schema_name", "table_name", "name")
        assert sorted(got.collect()) == sorted(map(tuple, wanted.collect())) != []
    spaces = found["db2"]["tablespaces"].groupBy("snapshot_id").count().collect()
    assert sorted(map(tuple, spaces)) == sorted((r.snapshot_id, 2) for r in heads.where("db_type = 'db2'").collect())


def test_relations_share_one_table_relation(spark, given):
    base = written(p1.columns(spark, given))
    plain, shared = p1.relations(spark, given), p1.relations(spark, given, base)
    assert {n: sorted(map(str, r.collect())) for n, r in shared.items()} == {n: sorted(map(str, r.collect())) for n, r in plain.items()}
    assert sorted(p1.headers(spark, given, base).collect()) == sorted(p1.headers(spark, given).collect())
    assert "Aggregate" not in shared["storage"]._jdf.queryExecution().optimizedPlan().toString()


def test_growth_is_worked_out_once(spark):
    headers, relations = small._headers(spark, 1, storage=True), small._relations(spark)
    rows = collection.collected(headers, relations)
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
    grown = written(collection.with_growth(headers, relations))
    again = collection.collected(headers, relations, grown=grown)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    assert sorted(map(str, collect.fingerprints(again).collect())) == sorted(map(str, collect.fingerprints(rows).collect()))
