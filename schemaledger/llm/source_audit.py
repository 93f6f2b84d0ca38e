"""Source divergence audit: how far the term distributions of the sources of each language lie apart.

The smoothed share of a term in a group (language and source) depends on its count there only. So the divergence of two
groups is a sum over their joint table: how many terms have count a in the one and count b in the other. With one
indicator column for each group and count level, all joint tables of a language are the product of the indicator matrix
with its transpose. The product is exact and made in blocks of terms: a row has one entry for each group, so each block
is multiplied in sparse form, in whole numbers. Level 0, nearly all of the matrix, is not stored: its cells follow from
the margins.

Shuffles: one of the terms, counted before in every task, then sums of one number for each pair of sources. Each block's
tables are priced where they arise. Terms of a hot group spread over all tasks by their own hash.

Edge cases: null text, language or source count as empty ones. Groups without terms take part, with counts 0. A language
without kept terms has values 0 and no row of part ``term``; with a single source it has none of part ``pair``. Repeated
rows count each. An empty table gives an empty result. Only the named columns are read, so others never clash. The
number of ``pair`` rows is the square of a language's sources by definition.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import broadcast_if_small, written
from .byte_words import LETTERS, word_blocks

UNIT = 1_000_000_000  # shares are whole numbers of this part
_HELD = 1 << 20  # counted terms that a task holds before it hands them on
_WORDS_HELD = 1 << 32  # words, likewise
_ONE_DOCUMENT = 1 << 36  # a document and its occurrences in one number: documents above, occurrences below
_BLOCK_PAIRS = 1 << 21  # entries of one block's product before equal ones are added up
_SUM = "decimal(38,0)"
_IN_LONG = 9_000_000_000  # below this count, UNIT * (count + 1) is a long


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, term, source, n, docs`` of the columns ``lang, source, text``: counted in parts, so keys repeat."""

    def reduced(held: dict[tuple, dict[bytes, int]]) -> pa.RecordBatch:
        sizes = [len(counts) for counts in held.values()]
        both = np.concatenate([np.fromiter(counts.values(), np.int64, len(counts)) for counts in held.values()])
        terms = pa.concat_arrays([pa.array(list(counts), pa.binary()) for counts in held.values()])
        group = pa.array(np.repeat(np.arange(len(held)), sizes))
        lang, source = (pa.array([key[k] for key in held], pa.string()).take(group) for k in (0, 1))
        return pa.RecordBatch.from_arrays([lang, terms, source, pa.array(both % _ONE_DOCUMENT), pa.array(both // _ONE_DOCUMENT)], ["lang", "term", "source", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[bytes, int]] = {}
        terms = words = 0
        for batch in batches:
            for lang, source, text in zip(*(column.to_pylist() for column in batch.columns)):
                own: Counter = Counter()
                for block in word_blocks(text, LETTERS):
                    own.update(block)
                    words += len(block)
                counts = held.setdefault((lang, source), {})
                terms -= len(counts)
                known = counts.get
                for term, n in own.items():
                    counts[term] = known(term, 0) + n + _ONE_DOCUMENT
                terms += len(counts)
                if terms > _HELD or words > _WORDS_HELD:
                    yield reduced(held)
                    held, terms, words = {}, 0, 0
        if held:
            yield reduced(held)

    rows = docs.select("lang", "source", F.col("text").cast("binary"))
    return rows.mapInArrow(run, "lang string, term binary, source string, n long, docs long").withColumn("term", F.col("term").cast("string"))


def joint_tables(terms: DataFrame) -> DataFrame:
    """Joint tables, in parts: ``lang, a, b`` (sources, a < b) and ``cells`` (count in a, count in b, terms), without level 0.

    ``terms``: lang, groups (source, n; one entry for each source, counts above 0).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            of_row = lang.indices.to_numpy(zero_copy_only=False)
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            entries = batch.column(1).flatten()
            source = entries.field("source").dictionary_encode()
            names = source.dictionary.to_pylist()
            place = np.empty(len(names), np.int64)  # numbers in the order of the names
            place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
            sources, counts = place[source.indices.to_numpy(zero_copy_only=False)], entries.field("n").to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            for code, name in enumerate(lang.dictionary.to_pylist()):
                mine = of_row[row] == code
                for left, right, cells in level_products(row[mine], sources[mine], counts[mine]):
                    yield _parts(name, sorted(names), left, right, cells)

    shape = "lang string, a string, b string, cells array<struct<a: long, b: long, n: long>>"
    return terms.select("lang", "groups").mapInArrow(run, shape)


def level_products(row: np.ndarray, group: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indicator matrix times its transpose, above the diagonal of groups, in blocks of bounded size.

    ``row`` ascends; an entry of the matrix is (row, (group, count)). Gives (group a, group b, cells): cells have the
    columns count in a, count in b, number of rows; those of one block are distinct and ordered by groups.
    """
    if not len(row):
        return
    order = np.lexsort((group, row))
    row, group, count = row[order], group[order], count[order]
    values, value = np.unique(count, return_inverse=True)
    code, column = np.unique(group * len(values) + value, return_inverse=True)  # columns by group, then count
    level = np.stack((code // len(values), values[code % len(values)]))
    begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    end = np.concatenate((begin[1:], [len(row)]))
    partners = np.repeat(end, end - begin) - np.arange(len(row)) - 1  # entries of the same row in later groups
    borders = np.searchsorted(np.cumsum(partners), np.arange(0, int(partners.sum()) + _BLOCK_PAIRS, _BLOCK_PAIRS))
    borders[0], borders[-1] = 0, len(row)
    for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist()):
        many = partners[lo:hi]
        left = np.repeat(np.arange(lo, hi), many)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
        pair, rows = np.unique(column[left].astype(np.int64) * level.shape[1] + column[right], return_counts=True)
        if not len(pair):
            continue
        one, other = pair // level.shape[1], pair % level.shape[1]
        by_groups = np.lexsort((other, one, level[0][other], level[0][one]))
        one, other, rows = one[by_groups], other[by_groups], rows[by_groups]
        yield level[0][one], level[0][other], np.stack((level[1][one], level[1][other], rows))


def _parts(lang: str, names: list[str], left: np.ndarray, right: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
    new = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1]))))
    inner = pa.StructArray.from_arrays([pa.array(c) for c in cells], ["a", "b", "n"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(left)), pa.int32()), inner)
    sides = [pa.array([names[i] for i in side[new].tolist()], pa.string()) for side in (left, right)]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(new), pa.string()), *sides, lists], ["lang", "a", "b", "cells"])


def share(count: Column, total: Column, kept: Column) -> Column:
    """Smoothed share in units, above 0: 1 + floor(UNIT * (count + 1) / (total + kept)), exact for any count."""
    over = F.greatest(total + kept, F.lit(1))
    exact = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)"), over.cast("decimal(19,0)"))
    in_long = F.call_function("div", F.lit(UNIT).cast("long") * (count + 1), over)
    return F.when(count < _IN_LONG, in_long).otherwise(exact) + 1


def penalty(p: Column, q: Column) -> Column:
    """floor((p - q)² / q) of two shares, exact: shares are at most UNIT + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit_sources(
    docs: DataFrame, least_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """``lang, source, part, item, value, rank``: the divergence of each source from others and from its language.

    Part ``pair``: every other source of the language, by the sum of penalties of all kept terms (those in at least
    ``least_docs`` documents of the language), all ranks. Part ``term``: the ``top`` kept terms that are more frequent in
    the source than in its language, by their penalty. Ties of a rank go by the item's UTF-8 bytes.
    """
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    # One shuffle by (lang, term) serves both groupings.
    counted = term_counts(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = written(
        counted.groupBy("lang", "term")
        .agg(F.collect_list(F.struct("source", "n")).alias("groups"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= least_docs).drop("docs")
    )
    entries = terms.select("lang", "term", "total", F.inline("groups"))
    levels = written(entries.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")))
    groups = _groups(rows, terms, levels)
    return _pairs(terms, levels, groups).unionByName(_terms(entries, groups, top))


def _groups(rows: DataFrame, terms: DataFrame, levels: DataFrame) -> DataFrame:
    """Every group of the documents: ``lang, source, size`` (occurrences of kept terms), ``lang_size, kept`` of the language, ``absent``: share of count 0."""
    sizes = levels.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("size"))
    langs = terms.groupBy("lang").agg(F.sum("total").alias("lang_size"), F.count("*").alias("kept"))
    zero = F.lit(0).cast("long")
    return written(
        rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("size", "lang_size", "kept")])
        .withColumn("absent", share(zero, F.col("size"), F.col("kept")))
    )


def _pairs(terms: DataFrame, levels: DataFrame, groups: DataFrame) -> DataFrame:
    """Price of every joint table. With f the penalty, a and b counts in source and item, 0 the absent level:

    sum f(a, b) = sum over cells n * (f(a, b) - f(a, 0) - f(0, b) + f(0, 0))
                + sum over levels of source (f(a, 0) - f(0, 0)) + sum over levels of item (f(0, b) - f(0, 0)) + kept * f(0, 0).
    """
    side = lambda of: groups.select("lang", F.col("source").alias(of), F.col("size").alias(f"{of}_size"), F.col("absent").alias(f"{of}_absent"), "kept")
    a, b = broadcast_if_small(side("source")), broadcast_if_small(side("item").drop("kept"))
    p = lambda count, of: share(F.col(count), F.col(f"{of}_size"), F.col("kept"))
    p0, q0 = F.col("source_absent"), F.col("item_absent")
    both = side("source").join(b, "lang").where(F.col("source") != F.col("item"))
    f00 = penalty(p0, q0)

    cells = joint_tables(terms).select("lang", "a", "b", F.inline("cells").alias("in_a", "in_b", "n"))
    turned = cells.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("in_a").alias("x"), F.col("in_b").alias("y"), "n"),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("in_b").alias("x"), F.col("in_a").alias("y"), "n"),
    )).alias("cell")).select("lang", "cell.*")
    priced = turned.join(a, ["lang", "source"]).join(b, ["lang", "item"]).select("lang", "source", "item", "n", p("x", "source").alias("p"), p("y", "item").alias("q"), p0.alias("p0"), q0.alias("q0"))
    f = lambda x, y: penalty(F.col(x), F.col(y))
    inner = priced.select("lang", "source", "item", (F.col("n").cast(_SUM) * (f("p", "q") - f("p", "q0") - f("p0", "q") + f("p0", "q0")).cast("decimal(19,0)")).cast(_SUM).alias("value"))

    margin = lambda level, of, price: (
        both.join(levels.withColumnsRenamed({"source": of, "n": "x"}), ["lang", of])
        .select("lang", "source", "item", (F.col("terms").cast("decimal(18,0)") * (price - f00).cast("decimal(19,0)")).cast(_SUM).alias("value"))
    )
    outer = margin(levels, "source", penalty(p("x", "source"), q0)).unionByName(margin(levels, "item", penalty(p0, p("x", "item"))))
    base = both.select("lang", "source", "item", (F.col("kept").cast("decimal(18,0)") * f00.cast("decimal(19,0)")).cast(_SUM).alias("value"))
    value = inner.unionByName(outer).unionByName(base).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return value.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(entries: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    p, q = share(F.col("n"), F.col("size"), F.col("kept")), share(F.col("total"), F.col("lang_size"), F.col("kept"))
    found = (
        entries.join(broadcast_if_small(groups), ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), "item", penalty(F.col("p"), F.col("q")).alias("value"))
    )
    # Spark keeps at most ``top`` rows of a group in each task before the shuffle.
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
