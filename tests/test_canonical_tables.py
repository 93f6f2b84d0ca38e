"""Canonical JSON of typed objects is printed from their fields, and equals the parsed and sorted form."""

from pyspark.sql import functions as F, types as T

from schemaledger import model
from schemaledger.functions.values import canonical_json
from schemaledger.operators import collect

_TYPE = (", ".join([
    "n INT", "name STRING", "comment STRING", "definition STRING", *[f"{n} {model._list_type(n)}" for n in model.LISTS],
    f"primary_key {model.PRIMARY_KEY}, permissions {model.PERMISSIONS}, storage {model.STORAGE}"]))
_ODD = 'a"\\/\n\t\x01\x7f é한😀'
_ROWS = [
    (0, "t", None, None, [], [], [], [], None, None, None),
    (1, None, "", "", None, None, None, None, ([], None), (None, None, None), (None,) * 7),
    (2, _ODD, _ODD, _ODD, [("c", "int", True, None, _ODD), None, (None,) * 5], [(_ODD, ["a", None], "s", "t", [_ODD]), None],
     [("i", None, False), ("j", [], None), None], [("u", [_ODD, None]), None], (["k", None], _ODD), (True, ["SELECT", None], _ODD),
     (1, 2, 2**62, None, -5, -(2**63), 100.0)),
    *[(3 + k, "t", None, None, [], [], [], [], None, None, (0, 0, 0, 0, 0, 0, p)) for k, p in enumerate(
        (0.0, -0.0, 12.5, -33.33, 1e7, 1.5e10, 1e-5, 5e-324, 1e300, 123456789012.34, 0.1, float("nan"), float("inf")))],
]


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_typed_objects_are_printed_in_canonical_form(spark):
    rows = spark.createDataFrame(_ROWS, _TYPE)
    order = ("name", "comment", *model.LISTS, "primary_key", "permissions", "storage")
    keep = {"ignoreNullFields": "false"}
    for growth in (True, False):
        for without in ((), ("columns", "indexes"), ("storage", "name")):
            own = F.col("storage") if growth else F.col("storage").dropFields(*collect.GROWTH)
            parsed = canonical_json(F.to_json(F.struct(*[own.alias(f) if f == "storage" else f for f in order if f not in without]), keep))
            for r in rows.select("n", parsed.alias("e"), collect.table_json(growth, without).alias("g")).collect():
                assert r["g"] == r["e"], (r["n"], growth, without)
    parsed = canonical_json(F.to_json(F.struct("definition", "name", "permissions"), keep))
    for r in rows.select("n", parsed.alias("e"), collect.view_json().alias("g")).collect():
        assert r["g"] == r["e"], r["n"]


def test_digests_parse_no_printed_object(spark):
    rows = spark.createDataFrame(_ROWS, _TYPE)
    assert "parse_json" not in _plan(rows.select(collect.table_json(growth=False).alias("t"), collect.view_json().alias("v"))).lower()
