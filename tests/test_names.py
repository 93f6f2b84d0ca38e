"""Name index: equal to the scan for any query, and reads only what it needs."""

import re

import pytest

from schemaledger.operators import names, search

ROWS = [
    (1, "table", "app", "Orders"), (2, "table", "app", "Orders"), (1, "view", "App", "orders"), (1, "table", "log", "aaaa"),
    (1, "table", "log", "aa"), (1, "procedure", None, "ab"), (1, "table", "", None), (1, "table", "größe", "ÄÖÜ-tab"),
    (1, "table", "x", "p" * 5000 + "needle" + "q" * 5000), (1, "table", "ord", "ers"), (1, "table", "rde", "ord ers"),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.createDataFrame(ROWS, "snapshot_id BIGINT, kind STRING, schema_name STRING, name STRING")
    path = str(tmp_path_factory.mktemp("names"))
    names.write_name_index(rows, path)
    return rows, path


@pytest.mark.parametrize("query", ["orders", " ORDERS ", "ord.ers", "aaa", "aa", ".", "", "äöü", "pneedleq", "p.orders", "gone", "rders.ord", "100%", "_"])
def test_index_equals_scan(spark, index, query):
    rows, path = index
    key = lambda found: sorted(found.select("snapshot_id", "kind", "schema_name", "name").collect(), key=str)
    assert key(names.search_index(spark, path, query)) == key(search.search_objects(rows, query))
    assert key(names.search_index(spark, path, query, "app")) == key(search.search_objects(rows, query, "app"))


def test_search_reads_the_postings_of_its_runs(spark, index):
    text = spark._jvm.PythonSQLUtils.explainString(names.matching_texts(spark, index[1], "orders")._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[.*gram_folder#\d+ (IN|INSET)", text) and re.search(r"PushedFilters: \[.*In\(gram", text)
    assert text.count("Scan parquet") == 2 and "/postings" in text and "/texts" not in text and "/objects" not in text


def test_names_are_indexed_once(spark, index):
    postings = spark.read.parquet(f"{index[1]}/postings").select("gram", "text")
    assert postings.count() == postings.distinct().count()
    assert postings.where("text = 'log.aaaa'").count() == 5  # log og. g.a .aa aaa


def test_empty_index(spark, tmp_path):
    names.write_name_index(spark.createDataFrame([], "kind STRING, schema_name STRING, name STRING"), str(tmp_path))
    for query in ("abc", "a", ""):
        found = names.search_index(spark, str(tmp_path), query)
        assert found.columns == ["kind", "schema_name", "name"] and found.count() == 0
