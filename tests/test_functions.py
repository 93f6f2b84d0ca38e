"""Scalar expressions against plain Python."""

import random

from pyspark.sql import functions as F

from schemaledger.functions import secrets, text, values


def test_two_digit_rounding_equals_python(spark):
    rng = random.Random(1)
    numbers = [rng.uniform(-1e6, 1e6) for _ in range(20_000)] + [k / 1000 for k in range(-50_000, 50_000, 5)]
    numbers += [k / 8 for k in range(-200, 200)] + [2.675, 0.125, 0.375, 1e17, -0.004, 0.005, 5e-324, 123456789012.345]
    rows = spark.createDataFrame([(n,) for n in numbers], "x DOUBLE")
    for r in rows.select("x", values.round_half_even(F.col("x")).alias("y")).collect():
        assert r["y"] == round(r["x"], 2), r["x"]


def test_byte_sizes(spark):
    cases = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.3 KB", 1536: "1.5 KB", -1536: "-1.5 KB", 1048575: "1024.0 KB",
             1024**2: "1.0 MB", 5 * 1024**4: "5.0 TB", 3000 * 1024**4: "3000.0 TB", 2**62: "4194304.0 TB"}
    rows = spark.createDataFrame([(n,) for n in [*cases, None]], "n BIGINT")
    got = {r["n"]: r["s"] for r in rows.select("n", text.byte_size(F.col("n")).alias("s")).collect()}
    assert got == {**cases, None: "—"}


def test_secrets_hide_and_open(spark):
    rows = spark.createDataFrame([('{"password":"top","private_key":"k"}',), ("{}",), (None,)], "v STRING")
    sealed = rows.select("v", secrets.encrypted_json(F.col("v"), F.lit("pass")).alias("c"))
    opened = sealed.select("v", "c", secrets.decrypted_json(F.col("c"), F.lit("pass")).alias("o"), secrets.decrypted_json(F.lit("garbage"), F.lit("pass")).alias("g")).collect()
    assert opened[0]["o"] == opened[0]["v"] and "top" not in opened[0]["c"]
    assert [(r["c"], r["o"]) for r in opened[1:]] == [("", "{}"), ("", "{}")]
    assert opened[0]["g"] is None


def test_file_stem(spark):
    at = F.lit("2024-02-03 04:05:06").cast("timestamp_ntz")
    rows = spark.createDataFrame([("__운영 DB/1__",), ("///",), (None,)], "s STRING")
    got = [r[0] for r in rows.select(text.file_stem(F.col("s"), at)).collect()]
    assert got == ["schema_운영_DB_1_20240203_040506", "schema_schema_20240203_040506", "schema_schema_20240203_040506"]
