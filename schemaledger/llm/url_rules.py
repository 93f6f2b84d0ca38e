"""URL filters: stated host and path rules first, else association rules mined by FP-growth.

A URL is a set of tokens: its host, the host's ends and first label, path segments and query keys. FP-growth runs over
the tokens of all labelled URLs, with one more item for a bad label; rules that end in this item and pass the support and
confidence limits block what they match. Matching is an inverted index: a rule is posted under its rarest token only, and
a URL that holds this token is tested for the others. DataFrame functions throughout.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written

MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.9
MIN_ROWS = 5  # labelled URLs behind a rule, however few there are in all
_BAD = "label:bad"


def lowered(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return lowered(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """Between the host and ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def stated_rule(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest of ``rules`` (``host/path``) that fits, else null: the rule's host or a subdomain, and a path that starts with the rule's."""
    found = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        found.append(F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest), F.lit(rule)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL; digits are one token. Empty for null and for texts without ``://``."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    parts = lambda text, cut: F.filter(F.split(text, cut), lambda x: x != "")
    tagged = lambda tag, items: F.transform(items, lambda x: F.concat(F.lit(tag), x))
    plain = lambda items: F.transform(items, lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    keys = F.transform(parts(query, "&"), lambda x: F.substring_index(x, "=", 1))
    tokens = F.array_distinct(F.concat(
        F.array(F.concat(F.lit("host:"), host), F.concat(F.lit("domain:"), F.substring_index(host, ".", -2)),
                F.concat(F.lit("top:"), F.substring_index(host, ".", -1)), F.concat(F.lit("first:"), F.substring_index(host, ".", 1))),
        tagged("path:", plain(parts(path, "/"))), tagged("key:", keys),
    ))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(tokens)


def mined_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS
) -> DataFrame:
    """``antecedent, posted, confidence, support`` of the rules for bad URLs from all rows of ``url, bad``.

    A rule rests on at least ``min_support`` of the rows and on ``min_rows`` of them, so a few labels do not make rules of
    single URLs. ``posted`` is the rarest token of the antecedent (ties: the smallest). Rows without tokens or label are left out; no
    rows, fewer than ``min_rows`` or no bad one give no rules.
    """
    items = written(
        labelled.select(url_tokens(F.col("url")).alias("tokens"), "bad").where(F.col("bad").isNotNull() & (F.size("tokens") > 0))
        .select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(_BAD)))).otherwise(F.col("tokens")).alias("items"))
    )
    n = items.count()
    if n < max(min_rows, 1):
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, posted string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, (min_rows - 0.5) / n), minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(_BAD))).select(
        F.sort_array("antecedent").alias("antecedent"), "confidence", "support"
    )
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    posted = (
        rules.select("antecedent", F.explode("antecedent").alias("token")).join(single, "token")
        .groupBy("antecedent").agg(F.min(F.struct("freq", "token")).alias("least"))
        .select("antecedent", F.col("least.token").alias("posted"))
    )
    return rules.join(posted, "antecedent").select("antecedent", "posted", "confidence", "support")


def matched_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``url`` that at least one mined rule matches."""
    tokens = url_tokens(F.col("url"))
    posted = rules.select(F.col("posted").alias("token"), "antecedent")
    return (
        urls.where(F.col("url").isNotNull()).select("url", tokens.alias("tokens"), F.explode(tokens).alias("token"))
        .join(posted, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0).select("url").distinct()
    )


def judge_urls(pages: DataFrame, rules: DataFrame, allow: Sequence[str], block: Sequence[str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``.

    The longest stated rule decides; without one a mined rule blocks and all else is allowed. Null and scheme-less URLs
    have empty host and path and are allowed. Repeated rows come back as often as they came; other columns are not read.
    """
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    matched = matched_urls(given.select("url"), rules).withColumn("hit", F.lit(True))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule = stated_rule(F.col("host"), F.col("path"), [*allow, *block])
    said = F.when(F.col("rule").isin(list(allow)), "allow").when(F.col("rule").isNotNull(), "block").when(F.col("hit"), "block").otherwise("allow")
    return (
        given.join(matched, "url", "left").select("page_id", host.alias("host"), path.alias("path"), "hit")
        .withColumn("rule", rule).select("page_id", "host", "path", "rule", said.alias("verdict"))
    )
