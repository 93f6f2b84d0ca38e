"""What the plans of store queries read: folders, columns, and how often."""

import re

import pytest

from schemaledger import model
from schemaledger.plans import registry

SF = "/root/testdata/sf0.001"
registry.load_all()


def _scans(spark, name):
    """Of every Parquet scan of a query's plan: its folder, partition filters and read schema."""
    result = registry.QUERIES[name](spark, SF)
    text = spark._jvm.PythonSQLUtils.explainString(result._jdf.queryExecution(), "formatted")
    found = re.findall(r"Scan parquet.*?\nLocation: (.*?)\n(.*?)ReadSchema: (.*?)\n", text, re.S)
    assert found
    return [(where, "".join(re.findall(r"PartitionFilters: (.*)", filters)), schema) for where, filters, schema in found]


OTHERS = {"columns", "foreign_keys", "indexes", "unique_constraints", "primary_key", "permissions", "storage", "definition", "raw", "comment", "arguments"}


@pytest.mark.parametrize("name, wanted", [
    ("g2_table_history", {"comment"}), ("d3_schema_history", set()), ("x5_index_sheet", {"indexes"}), ("g3_column_history", {"columns"}),
    ("b12_search_objects", set()), ("d14_visible_counts", set()), ("g7_flattened_objects", set()), ("d2_collected_objects", set()),
    ("x2_table_sheet", {"columns", "indexes", "foreign_keys", "primary_key", "storage", "comment"}), ("g6_privileges", {"permissions"}),
    ("d7_table_counts", {"columns", "indexes", "foreign_keys"}), ("x4_view_sheet", {"definition"}), ("x9_storage_sheet", {"storage"}),
    ("g1_snapshot_history", set()), ("d1_snapshot_summary", set()), ("d6_export_totals", {"columns", "indexes", "foreign_keys"}),
])
def test_one_scan_of_the_wanted_columns(spark, name, wanted):
    scans = _scans(spark, name)
    assert len(scans) == 1
    read = set(re.findall(r"(?:struct<|,)(\w+):", re.sub(r":(array|struct)<.*?>+(?=,\w+:|>$)", ":x", scans[0][2])))
    assert read & OTHERS == wanted


def test_leaves_of_lists(spark):
    assert "columns:array<struct<name:string,type:string,nullable:boolean>>" in _scans(spark, "g3_column_history")[0][2]
    assert "columns:array<struct<name:string>>" in _scans(spark, "x2_table_sheet")[0][2]


@pytest.mark.parametrize("name, kind", [("g2_table_history", "table"), ("x4_view_sheet", "view"), ("x7_procedure_sheet", "procedure")])
def test_only_folders_of_the_kind(spark, name, kind):
    assert re.search(rf"\(kind#\d+ = {kind}\)", _scans(spark, name)[0][1])


@pytest.mark.parametrize("name", ["e2_latest_metadata", "f3_newest_snapshots"])
def test_chosen_snapshots_prune_folders(spark, name):
    objects = [s for s in _scans(spark, name) if "dynamicpruning" in s[1]]
    assert objects and all(f"{c}#" in s[1] for s in objects for c in model.PARTITIONS[1:])


def test_source_prunes_folders(spark):
    assert all("source_bucket" in s[1] for s in _scans(spark, "a5_snapshot_scan"))
    assert all("source_bucket" in s[1] for s in _scans(spark, "f3_newest_of_source"))
