"""Templates: every part of a text is worked out once."""

from pyspark.sql import functions as F

from schemaledger.functions import templates


def _lookup():
    return F.create_map(*[F.lit(x) for x in ("A", "one ${B}", "B", 'q"\n', "C", "")])


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_once(spark):
    """Each mention in the plan is one more pass over the text, and within a lambda one for every piece."""
    rows = spark.createDataFrame([("x",)], "t STRING")
    assert _plan(rows.select(templates.resolved_text(F.col("t"), _lookup()).alias("r"))).count("regexp_extract_all") == 1
    assert _plan(rows.select(templates.resolved_json(F.col("t"), _lookup()).alias("r"))).count("regexp_extract_all") == 2


def test_resolved_values(spark):
    long = "[" + ",".join(['"${A}-${B}"', "7", '"k${A}":1', '"${C}"'] * 100) + "]"
    cases = {
        '{"${A}" : "${A}${B}${C}","n":[1,"${B}"]}': '{"${A}" : "one ${B}q\\"\\n","n":[1,"q\\"\\n"]}',
        '{"a":"${D}"}': None, '"${D}":"${A}"': '"${D}":"one ${B}"', "": "", "[1, 2]": "[1, 2]", '"\\"${A}"': '"\\"one ${B}"', None: "",
        long: long.replace('"k${A}":1', "\0").replace("${A}", "one ${B").replace("${B}", 'q\\"\\n').replace("one ${B", "one ${B}").replace("${C}", "").replace("\0", '"k${A}":1'),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t STRING")
    assert {r[0]: r[1] for r in rows.select("t", templates.resolved_json(F.col("t"), _lookup())).collect()} == cases
    texts = {"${A}${A}x${B}": 'one ${B}one ${B}xq"\n', "x${D}${A}": None, "": "", "${C}": "", "$x": "$x", None: ""}
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert {r[0]: r[1] for r in rows.select("t", templates.resolved_text(F.col("t"), _lookup())).collect()} == texts
