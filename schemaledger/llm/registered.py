"""Queries of the training-corpus operators, with production parameters over whole tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder, written
from .byte_bpe import byte_bpe
from .decontaminate import find_leaks
from .exact_dedup import exact_dedup
from .importance import importance_resample
from .language_id import identify, learned
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .ngram_join import ngram_jaccard_components
from .page_text import extract_main_text
from .source_audit import audit_sources
from .token_counts import TokenRollup, counted
from .token_files import token_files
from .url_rules import judge_urls, mined_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary(name: str) -> bytes:
    """Content of a public vocabulary file, about a megabyte; it travels with the tasks."""
    return Path(public_tokenizers.path(name)).read_bytes()


@_query("op1_exact_dedup", r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""")
def op1_exact_dedup(spark, sf):
    found = exact_dedup(spark, f"{sf}/documents.parquet", shared_folder(spark))
    return found.withColumnRenamed("digest", "text_sha256")


@_query("op2_token_files")
def op2_token_files(spark, sf):
    found = token_files(_table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query("op3_byte_bpe")
def op3_byte_bpe(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    found = byte_bpe(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op4_ngram_jaccard_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS grams FROM w),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.grams) + len(y.grams) - n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT node AS doc_id, CAST(any_value(len(grams)) AS BIGINT) AS n_shingles, min(seen) AS component_id
FROM r JOIN s ON s.doc_id = node GROUP BY node""")
def op4_ngram_jaccard_join(spark, sf):
    return ngram_jaccard_components(_table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@_query("op5_decontamination")
def op5_decontamination(spark, sf):
    """One row per document and test item that it holds; documents without a leak have none."""
    found = find_leaks(_table(spark, sf, "documents").select("doc_id", "text"), _table(spark, sf, "benchmark"))
    return found.select("doc_id", F.inline("leaks"))


@_query("op6_url_rules")
def op6_url_rules(spark, sf):
    pages = _table(spark, sf, "pages").select("page_id", "url")
    bad = _table(spark, sf, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    rules = mined_rules(pages.join(bad, "page_id").select("url", "bad"))
    return judge_urls(pages, rules, allow=("com/", "www.example.com/en/"), block=("example.com/en/", "net/es/", "net/fr/"))


@_query("op7_language_id")
def op7_language_id(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = learned(docs.where(~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


@_query("op8_page_text")
def op8_page_text(spark, sf):
    return extract_main_text(_table(spark, sf, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@_query("op9_token_counts")
def op9_token_counts(spark, sf):
    """Estimates at arrival, revised to exact counts; a second tokenizer version; toxic documents taken out; one batch sent twice."""
    first, second = "byte_bpe_50k", "byte_bpe_multi_50k"
    docs = _table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    files = {name: vocabulary(f"{name}.tiktoken") for name in (first, second)}
    exact = written(counted(docs, files, public_tokenizers.PATTERN).drop("text"))
    change = lambda op, version, n: exact.select(F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(version).alias("version"), n.alias("n_tokens"))
    toxic = _table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct()
    counts = change("revise", first, F.col(first)).union(change("insert", second, F.col(second)))
    rollup = TokenRollup(spark, shared_folder(spark))
    rollup.commit(1, change("insert", first, F.ceil(F.col("n_chars") / 4)))
    rollup.commit(2, counts)
    rollup.commit(3, counts.join(toxic, "doc_id", "left_semi").withColumn("op", F.lit("delete")))
    rollup.commit(2, counts)
    return rollup.totals()


@_query("op10_line_dedup", r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS lost FROM k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(lost AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM o GROUP BY doc_id""")
def op10_line_dedup(spark, sf):
    found = dedup_lines(_table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@_query("op11_importance_resampling", rf"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
t AS (SELECT true AS corpus, row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents UNION ALL SELECT false, row_number() OVER (), item_id, {_WORDS} FROM benchmark),
g AS (SELECT corpus, r, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS gram FROM t),
b AS (SELECT gram, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(gram)) + 1), lambda i: CAST('0x' || substr(hex(encode(gram)), 2 * i - 1, 2) AS BIGINT))),
    lambda a, x: xor(a >> 8, crc[CAST((xor(a, x) & 255) + 1 AS BIGINT)]))) % 10000 AS bucket FROM (SELECT DISTINCT gram FROM g) CROSS JOIN tab),
f AS (SELECT corpus, r, bucket FROM g JOIN b USING (gram)),
c AS (SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t FROM f GROUP BY bucket),
w AS (SELECT bucket, floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM c) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT sum(t) FROM c) + 10000) AS DOUBLE))) AS gain FROM c),
d AS (SELECT r, CAST(floor(sum(CAST(gain AS HUGEINT)) / count(*)) AS BIGINT) AS weight, count(*) AS n FROM f JOIN w USING (bucket) WHERE corpus GROUP BY r),
x AS (SELECT doc_id, len(words) >= 20 AS eligible, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM t LEFT JOIN d USING (r) WHERE corpus),
o AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS place FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= (SELECT count(*) FROM x WHERE eligible) * 25 // 100 THEN place END AS rank FROM o""")
def op11_importance_resampling(spark, sf):
    found = importance_resample(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


# The names of licences that every scan looks for.
LICENSE_NAMES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Further names, and notices of public licences as their publishers word them.
LICENSE_PHRASES = (
    ("cc by 4 0", "cc-by"), ("cc by sa 4 0", "cc-by-sa"), ("cc by nc 4 0", "cc-by-nc"), ("cc by nd 4 0", "cc-by-nd"), ("cc0 1 0", "cc0"),
    ("gnu lesser general public license", "lgpl"), ("gnu affero general public license", "agpl"), ("gnu free documentation license", "gfdl"),
    ("mozilla public license", "mpl"), ("eclipse public license", "epl"), ("bsd 2 clause", "bsd"), ("bsd 3 clause", "bsd"), ("isc license", "isc"),
)
LICENSE_NOTICES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "apache"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "creative-commons"),
)
LICENSE_SHARE = 0.8


def _license_sql() -> str:
    base = [t.split() for t, _ in LICENSE_NAMES]
    rows = [(label, "true", text) for text, label in (*LICENSE_NAMES, *LICENSE_PHRASES)] + [(label, "false", text) for text, label in LICENSE_NOTICES]
    values = ", ".join(f"({i}, {i < len(base)}, '{label}', {exact}, '{text}')" for i, (label, exact, text) in enumerate(rows))
    return rf"""
WITH p AS (SELECT id, base, label, exact, {_WORDS} AS seq FROM (VALUES {values}) AS v(id, base, label, exact, text)),
q AS (SELECT *, len(seq) AS size, len(list_distinct(seq)) AS own, CASE WHEN exact THEN len(list_distinct(seq)) ELSE ceil({LICENSE_SHARE} * len(list_distinct(seq)) - 1e-9) END AS needed FROM p),
d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS words FROM documents),
v AS (SELECT DISTINCT id, unnest(seq) AS word FROM p),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
h AS (SELECT r, id, pos, lag(pos) OVER (PARTITION BY r, id, word ORDER BY pos) AS before FROM w JOIN v USING (word)),
e AS (SELECT r, id, greatest(pos - size + 1, coalesce(before + 1, 0), 0) AS lo, least(pos, greatest(0, len(words) - size)) + 1 AS hi FROM h JOIN q USING (id) JOIN d USING (r)),
k AS (SELECT r, id, place, sum(sum(step)) OVER (PARTITION BY r, id ORDER BY place) AS held FROM (
    SELECT r, id, lo AS place, 1 AS step FROM e WHERE lo < hi UNION ALL SELECT r, id, hi, -1 FROM e WHERE lo < hi) GROUP BY r, id, place),
m AS (SELECT r, id, place, held, needed, own, exact, base, label FROM k JOIN q USING (id) WHERE held >= needed AND NOT exact),
x AS (SELECT DISTINCT r, id, s AS place FROM (SELECT r, pos AS s, word FROM w) JOIN (SELECT id, seq, size FROM q WHERE exact) z ON word = seq[1] JOIN d USING (r) WHERE words[s + 1 : s + size] = seq),
f AS (SELECT r, place, base, label, 1.0::DOUBLE AS share FROM x JOIN q USING (id) UNION ALL SELECT r, place, false, label, held / own::DOUBLE FROM m)
SELECT doc_id, CAST(len(any_value(words)) AS BIGINT) AS n_words, CAST(count(*) FILTER (base) AS BIGINT) AS n_base, CAST(min(place) FILTER (base) AS BIGINT) AS first_word,
  CAST(max(place) FILTER (base) AS BIGINT) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0)::DOUBLE AS score
FROM d LEFT JOIN f USING (r) GROUP BY r, doc_id"""


@_query("op12_license_scan", _license_sql())
def op12_license_scan(spark, sf):
    """Score: the best containment among the matches of a document, 0 without one."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    found = scan_licenses(docs, (*LICENSE_NAMES, *LICENSE_PHRASES), LICENSE_NOTICES, LICENSE_SHARE)
    names = F.array(*[F.lit(label) for _, label in LICENSE_NAMES])
    base = F.filter("matches", lambda m: m["exact"] & F.array_contains(names, m["label"]))
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")
    starts = F.transform("base", lambda m: m["start"])
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"),
    )


@_query("op13_source_audit", r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + l.v) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (k.total + 1)) // (l.n + l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, 'pair' AS part, item, value FROM y UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM z)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 200""")
def op13_source_audit(spark, sf):
    return audit_sources(_table(spark, sf, "documents"))
