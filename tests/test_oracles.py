"""Every registered query against its oracle statement on the smallest tables."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry
from schemaledger.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
registry.load_all()
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _plain(value):
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    result = QUERIES[name](spark, SF)
    names = sorted(result.columns)
    got = [tuple(_plain(row[c]) for c in names) for row in result.collect()]
    cursor = duck.execute(ORACLES[name])
    given = [d[0] for d in cursor.description]
    assert sorted(given) == names
    places = [given.index(c) for c in names]
    wanted = [tuple(_plain(row[i]) for i in places) for row in cursor.fetchall()]
    assert got, "the query gives no rows"
    assert _sorted(got) == _sorted(wanted)


def test_entry_gives_changes(spark):
    assert set(r["change"] for r in entry.entry(spark).select("change").distinct().collect()) <= {"added", "removed", "changed"}
