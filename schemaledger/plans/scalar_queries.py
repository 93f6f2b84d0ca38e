"""Queries over the scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import secrets, templates, text, values
from . import driver_tables as p1
from .oracle_blocks import rounded
from .registry import query

def _cents():
    return F.round(F.col("c_acctbal") * 100).cast("bigint")


def _customers(spark, sf):
    return p1.table(spark, sf, "customer")


@query("h1_canonical_json", sql="""
    SELECT event_id AS id, concat('{"a":[', CAST(event_id AS VARCHAR), ',null],"m":{"x":"', event_type, '","y":null},"z":true}') AS canonical,
           true AS same_object, false AS same_as_reordered_array FROM events""")
def canonical_json(spark, sf):
    """Key order does not matter, array order and null keys do."""
    number, kind = F.col("event_id").cast("string"), F.col("event_type")
    first = F.concat(F.lit('{"z": true, "m": {"y": null, "x": "'), kind, F.lit('"}, "a": ['), number, F.lit(', null]}'))
    second = F.concat(F.lit('{"a":['), number, F.lit(',null],"m":{"x":"'), kind, F.lit('","y":null},"z":true}'))
    turned = F.concat(F.lit('{"a":[null,'), number, F.lit('],"m":{"x":"'), kind, F.lit('","y":null},"z":true}'))
    return p1.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), values.canonical_json(first).alias("canonical"),
        values.same_json(first, second).alias("same_object"), values.same_json(first, turned).alias("same_as_reordered_array"),
    )


@query("h2_digest", sql="""
    SELECT event_id AS id, sha256(concat('{"k":', CAST(event_id AS VARCHAR), ',"t":"', event_type, '"}')) AS fingerprint FROM events""")
def digest(spark, sf):
    document = F.concat(F.lit('{ "t": "'), F.col("event_type"), F.lit('", "k": '), F.col("event_id").cast("string"), F.lit(" }"))
    return p1.table(spark, sf, "events").select(F.col("event_id").alias("id"), values.fingerprint(document).alias("fingerprint"))


@query("h3_growth", sql="""
    SELECT c_custkey AS id, cur - old AS growth_bytes,
           CASE WHEN old <> 0 THEN """ + rounded("(CAST(cur - old AS DOUBLE) / CAST(old AS DOUBLE) * 100)") + """ END AS growth_percent
    FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cur,
                 CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 0 ELSE c_custkey * 37 END AS old FROM customer)""")
def growth(spark, sf):
    key = F.col("c_custkey")
    old = F.when(key % 5 == 0, None).when(key % 5 == 1, F.lit(0).cast("bigint")).otherwise(key * 37)
    rows = _customers(spark, sf).select(key.alias("id"), _cents().alias("cur"), old.cast("bigint").alias("old"))
    cur, old = F.col("cur"), F.col("old")
    return rows.select("id", values.growth_bytes(cur, old).alias("growth_bytes"), values.growth_percent(cur, old).alias("growth_percent"))


@query("h4_round_half_even", sql=f"SELECT c_custkey AS id, {rounded('(c_acctbal / 8.0::DOUBLE)')} AS rounded FROM customer")
def round_half_even(spark, sf):
    return _customers(spark, sf).select(F.col("c_custkey").alias("id"), values.round_half_even(F.col("c_acctbal") / F.lit(8.0)).alias("rounded"))


@query("h6_first_text", "p1_connections", sql="""
    SELECT id, CASE WHEN coalesce(password, '') <> '' THEN password WHEN username <> '' THEN username ELSE host END AS value FROM p1_connections""")
def first_text(spark, sf):
    return p1.connections(spark, sf).select("id", text.first_text(F.col("password"), F.col("username"), F.col("host")).alias("value"))


@query("h7_yes_no", "p1_connections", sql="""
    SELECT id, CASE WHEN host IS NULL THEN NULL WHEN ssh_enabled THEN 'YES' ELSE 'NO' END AS flag FROM p1_connections""")
def yes_no(spark, sf):
    flag = F.when(F.col("host").isNotNull(), F.col("ssh_enabled"))
    return p1.connections(spark, sf).select("id", text.yes_no(flag).alias("flag"))


@query("h8_privilege_label", "p1_connections", sql=f"""
    SELECT id, CASE WHEN host IS NULL THEN '{model.LABEL_PRIVILEGE["unknown"]}' WHEN ssh_enabled THEN '{model.LABEL_PRIVILEGE["allowed"]}'
                    ELSE '{model.LABEL_PRIVILEGE["denied"]}' END AS label FROM p1_connections""")
def privilege_label(spark, sf):
    flag = F.when(F.col("host").isNotNull(), F.col("ssh_enabled"))
    return p1.connections(spark, sf).select("id", text.privilege_label(flag).alias("label"))


def _sizes(name: str) -> str:
    """Oracle text of a byte size: tenths rounded half up in whole numbers."""
    units = "".join(
        f" WHEN abs({name}) < {1024 ** (p + 1)} OR {p} = 4 THEN concat(CAST((abs({name})::HUGEINT * 20 + {1024 ** p}) // {2 * 1024 ** p} // 10 AS VARCHAR),"
        f" '.', CAST((abs({name})::HUGEINT * 20 + {1024 ** p}) // {2 * 1024 ** p} % 10 AS VARCHAR), ' {model.BYTE_UNITS[p]}')"
        for p in range(1, 5)
    )
    return (
        f"CASE WHEN {name} IS NULL THEN '{model.NO_VALUE}' ELSE concat(CASE WHEN {name} < 0 THEN '-' ELSE '' END, "
        f"CASE WHEN abs({name}) < 1024 THEN concat(CAST(abs({name}) AS VARCHAR), ' B'){units} END) END"
    )


_BYTES_SQL = """
    FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN NULL
            ELSE CAST(round(c_acctbal * 100) AS BIGINT) * CAST(pow(1000, c_custkey % 5) AS BIGINT) END AS b FROM customer)"""
def _bytes():
    return F.when(F.col("c_custkey") % 13 != 0, _cents() * F.pow(F.lit(1000), F.col("c_custkey") % 5).cast("bigint"))


@query("h9_byte_size", sql=f"SELECT id, {_sizes('b')} AS size {_BYTES_SQL}")
def byte_size(spark, sf):
    return _customers(spark, sf).select(F.col("c_custkey").alias("id"), text.byte_size(_bytes()).alias("size"))


@query("h10_growth_text", sql=f"""
    SELECT id, CASE WHEN b IS NOT NULL THEN concat(CASE WHEN b > 0 THEN '+' ELSE '' END, {_sizes('b')}) END AS growth,
           CASE WHEN b > 0 THEN 'up' WHEN b < 0 THEN 'down' WHEN b = 0 THEN '' END AS direction {_BYTES_SQL}""")
def growth_text(spark, sf):
    return _customers(spark, sf).select(
        F.col("c_custkey").alias("id"), text.growth_text(_bytes()).alias("growth"), text.growth_direction(_bytes()).alias("direction")
    )


@query("h11_file_stem", sql="""
    SELECT event_id AS id, concat('schema_', CASE WHEN event_id % 7 = 0 THEN 'schema'
             ELSE trim(regexp_replace(concat('#', event_type, ' / 가.', props), '[^0-9A-Za-z가-힣_-]+', '_', 'g'), '_') END,
           '_', strftime(ts, '%Y%m%d_%H%M%S')) AS stem FROM events""")
def file_stem(spark, sf):
    source = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit("#"), F.col("event_type"), F.lit(" / 가."), F.col("props")))
    return p1.table(spark, sf, "events").select(F.col("event_id").alias("id"), text.file_stem(source, F.col("ts")).alias("stem"))


@query("h12_truncated", sql="SELECT doc_id AS id, substr(text, 1, 300) AS shown, sha256(text) AS whole FROM documents")
def truncated(spark, sf):
    return p1.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.truncated(F.col("text"), model.LIST_ERROR_CHARS).alias("shown"), F.sha2(text.truncated(F.col("text")), 256).alias("whole"))


_LOOKUP = {"HOST": "db ${USER}", "USER": "reader", "QUOTED": 'a"b'}


def _lookup():
    return F.create_map(*[F.lit(x) for pair in _LOOKUP.items() for x in pair])


@query("h13_templates", sql="""
    SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 3 THEN concat('h=db ${USER};u=reader;n=', CAST(c_custkey AS VARCHAR), ';$x') END AS resolved,
           CASE WHEN c_custkey % 4 = 3 THEN 'ABSENT' ELSE '' END AS missing FROM customer""")
def template_values(spark, sf):
    """A replaced value is not scanned again; a missing name makes the row an error."""
    key = F.col("c_custkey")
    user = F.when(key % 4 == 3, "${ABSENT}").otherwise("${USER}")
    source = F.concat(F.lit("h=${HOST};u="), user, F.lit(";n="), key.cast("string"), F.lit(";$x"))
    rows = _customers(spark, sf).select(key.alias("id"), source.alias("source"))
    return rows.select(
        "id", templates.resolved_text(F.col("source"), _lookup()).alias("resolved"),
        F.array_join(templates.missing_names(F.col("source"), _lookup()), ",").alias("missing"),
    )


@query("h13_nested_templates", sql="""
    SELECT c_custkey AS id, concat('{"${USER}":"reader","list":["reader",', CAST(c_custkey AS VARCHAR), '],"q":"a\\"b"}') AS resolved FROM customer""")
def nested_templates(spark, sf):
    key = F.col("c_custkey")
    document = F.concat(F.lit('{"${USER}" : "${USER}", "q":"${QUOTED}","list":["${USER}",'), key.cast("string"), F.lit("]}"))
    resolved = templates.resolved_json(document, _lookup())
    return _customers(spark, sf).select(key.alias("id"), values.canonical_json(resolved).alias("resolved"))


@query("h14_flattened_ssh", sql="""
    SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'bastion' END AS ssh_host, CASE WHEN c_custkey % 3 = 0 THEN 22 END AS ssh_port,
           CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 = 0 WHEN c_custkey % 3 = 1 THEN true END AS ssh_enabled FROM customer""")
def flattened_ssh(spark, sf):
    key = F.col("c_custkey")
    enabled = F.when(key % 2 == 0, "true").otherwise("false")
    document = (
        F.when(key % 3 == 0, F.concat(F.lit('{"name":"n","ssh":{"host":"bastion","port":22,"enabled":'), enabled, F.lit("}}")))
        .when(key % 3 == 1, '{"name":"n","ssh":{}}').otherwise('{"name":"n"}')
    )
    rows = _customers(spark, sf).select(key.alias("id"), F.from_json(document, "MAP<STRING,VARIANT>").alias("item"))
    flat = rows.select("id", templates.flattened_ssh(F.col("item")).alias("item"))
    read = lambda n, t: F.try_variant_get(F.try_element_at("item", F.lit(n)), "$", t).alias(n)
    return flat.select("id", read("ssh_host", "string"), read("ssh_port", "int"), read("ssh_enabled", "boolean"))


@query("g8_merged_options", sql="""
    SELECT c_custkey AS id, concat('a=', CAST(c_custkey AS VARCHAR), ',ssl_enabled=', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END) AS options
    FROM customer""")
def merged_options(spark, sf):
    key = F.col("c_custkey")
    left = F.create_map(F.lit("a"), key.cast("string"), F.lit("ssl_enabled"), F.lit("old"))
    right = F.create_map(F.lit("ssl_enabled"), (key % 2 == 0).cast("string"))
    entries = F.array_sort(F.map_entries(values.merged_map(left, right)))
    listed = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return _customers(spark, sf).select(key.alias("id"), F.array_join(listed, ",").alias("options"))


@query("g9_same_items", sql="""
    SELECT c_custkey AS id, c_custkey % 3 = 0 AS same FROM customer""")
def same_items(spark, sf):
    key = F.col("c_custkey")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    items = F.when(key % 3 == 0, words("VIEW", "INDEX", "TABLE", "PROCEDURE", "VIEW")).when(key % 3 == 1, words("VIEW"))
    return _customers(spark, sf).select(key.alias("id"), values.same_items(items, words(*model.LEGACY_ITEMS)).alias("same"))


@query("h15_object_key", "p1_columns", sql="""
    SELECT snapshot_id, concat('column:', schema_name, '.', table_name, '.', CASE WHEN nullable THEN '' ELSE column_name END) AS "key" FROM p1_columns""")
def object_key(spark, sf):
    name = F.when(~F.col("nullable"), F.col("column_name"))
    return p1.columns(spark, sf).select(
        "snapshot_id", text.object_key("column", F.col("schema_name"), F.col("table_name"), name).alias("key")
    )


@query("h17_json_reads", sql="""
    SELECT event_id AS id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END AS items,
           CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM events""")
def json_reads(spark, sf):
    key = F.col("event_id")
    items = F.when(key % 2 == 0, '{"list":[1,null,"x"]}').otherwise('{"list":null}')
    flag = F.when(key % 3 == 0, '{"f":true}').when(key % 3 == 1, '{"f":"false"}').otherwise('{"f":"maybe"}')
    return p1.table(spark, sf, "events").select(
        key.alias("id"), values.json_text(F.col("props"), "$.k").alias("k"), values.json_length(items, "$.list").alias("items"),
        values.json_boolean(flag, "$.f").alias("flag"),
    )


@query("h18_schedule_text", "p1_jobs", sql=f"""
    SELECT id, CASE schedule_type WHEN 'cron' THEN '0 2 * * *' WHEN 'interval' THEN CAST(interval_minutes AS VARCHAR) || '{model.LABEL_EVERY}'
                    ELSE '{model.LABEL_MANUAL}' END AS schedule FROM p1_jobs""")
def schedule_text(spark, sf):
    return p1.jobs(spark, sf).select(
        "id", text.schedule_text(F.col("schedule_type"), F.lit("0 2 * * *"), F.col("interval_minutes")).alias("schedule")
    )


@query("h19_endpoint_text", "p1_connections", sql="""
    SELECT id, CASE WHEN db_type = 'sqlite' THEN "database"
                    ELSE concat(coalesce(host, ''), ':', coalesce(CAST(port AS VARCHAR), 'null')) END AS endpoint FROM p1_connections""")
def endpoint_text(spark, sf):
    c = F.col
    return p1.connections(spark, sf).select("id", text.endpoint_text(c("db_type"), c("database"), c("host"), c("port")).alias("endpoint"))


@query("h20_secrets", "p1_connections", sql="""
    SELECT id, CASE WHEN password IS NULL THEN '{}' ELSE concat('{"password":"', password, '"}') END AS opened,
           password IS NOT NULL AS hidden, CASE WHEN password IS NULL THEN '{}' END AS with_wrong_key FROM p1_connections""")
def encrypted_secrets(spark, sf):
    """Cipher texts hide the secret, open with their own key and not with another."""
    plain = F.to_json(F.struct("password"))
    cipher = secrets.encrypted_json(plain, F.lit("passphrase"))
    rows = p1.connections(spark, sf).select("id", "password", cipher.alias("cipher"))
    return rows.select(
        "id", secrets.decrypted_json(F.col("cipher"), F.lit("passphrase")).alias("opened"),
        (F.col("password").isNotNull() & ~F.contains("cipher", F.lit("password"))).alias("hidden"),
        secrets.decrypted_json(F.col("cipher"), F.lit("another")).alias("with_wrong_key"),
    )


@query("h21_null_keeping_casts", sql="""
    SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN c_custkey ELSE 0 END AS bytes,
           CASE c_custkey % 3 WHEN 0 THEN c_custkey END AS row_estimate FROM customer""")
def null_keeping_casts(spark, sf):
    key = F.col("c_custkey")
    read = F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, "n/a")
    rows = _customers(spark, sf).select(key.alias("id"), read.alias("read"))
    return rows.select("id", values.byte_count(F.col("read")).alias("bytes"), values.row_estimate(F.col("read")).alias("row_estimate"))
