"""N-gram Jaccard join by filters under several global token orders.

Two texts link if 100 * |A and B| >= percent * |A or B| for their sets of distinct word runs. Under any global order of
the runs, two linked sets share a run within their prefixes of ``n - ceil(percent * n / 100) + 1`` runs. So

1. order 1 puts rare runs first: a fixed-size count sketch over all texts gives each run a frequency level. Its prefixes
   make the candidate groups: all texts that hold a shared prefix run meet under the smallest of them (their hub), so a
   group of near copies meets once and not once for every run they share; groups are cut by set size;
2. first each text goes only to the group with whose hub it shares most of its prefix. Such a group is cut into blocks of
   bounded rows and bytes, each of which meets by itself with the hub and a few anchors of the group. Links are joined to
   components, which unites most near copies at the price of one visit for each text;
3. then all groups meet, but only pairs of different components are looked at: a group of one component is done. In a
   group of several, the texts outside its largest component meet each other and that component, in pairs of blocks;
   the texts of the largest component need not meet each other;
4. texts meet first as counts: runs per cell of a small hash table, whose cell-wise minima bound the intersection from
   above. What it lets pass meets as counts once more, in a table that grows with the texts of the group, since a small
   one bounds nothing for long texts. Only texts with a partner that both bounds allow are fetched;
5. inside a task, candidates must also share prefix runs under two more orders and fit in size; the filters are
   intersected, and what is left is verified on the whole sets. A task gives back a spanning forest of its links, never
   its pairs; links are joined to components.

Equal sets are one class from the start: a task signs each set once, and classes are merged before groups are built.
Run hashes have 64 bits, set digests 128.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import broadcast_if_small, written
from . import words as W
from .components import connected_components

CELL_BITS = 18          # cells of the count sketch: 2**18, whatever the input
BLOCK_ROWS = 128        # texts of one block of a group
BLOCK_RUNS = 1 << 18    # runs of one block of a group
ANCHORS = 4             # texts of a group, besides its hub, that meet all its blocks
BOUND_ROWS = 2048       # texts that meet as counts in one task
BOUND_CELLS = 256       # cells of the counts that bound an intersection
SEEN = 200_000          # set digests that a task remembers to sign a set once
_ORDER_1, _ORDER_2, _ORDER_3, _DIGESTS = 7, 8, 9, (5, 6)
_FULL = 255  # a count that bounds nothing


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n + (-percent * n) // 100 + 1


def index_length(n: Column, percent: int) -> Column:
    """Length of the prefix that is enough for the smaller set of a linked pair."""
    return n - F.ceil(n * (2 * percent) / (100 + percent)) + 1


def frequency_levels(texts: DataFrame, size: int) -> np.ndarray:
    """Level of every sketch cell: twice the binary logarithm of its run count, over all texts. A fixed-size array."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for block in W.in_blocks(batch.column(0).to_pylist()):
                hashes, _ = W.hashed_runs(block, size)
                total += np.bincount((hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    cells = texts.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << CELL_BITS)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return np.floor(2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def signed(rows: DataFrame, level: np.ndarray, size: int, percent: int) -> DataFrame:
    """``doc_id, key, digest, n, node, prefix, counts`` of each row of ``doc_id, key, text``.

    ``node``, ``prefix`` (the first runs under order 1) and ``counts`` are null where the same task has signed the set before.
    """
    fields = [f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", "key long", "digest binary", "n long", "node long", "prefix array<long>", "counts binary"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, seen = TaskContext.get().partitionId() << 33, set()
        for batch in batches:
            at = 0
            for block in W.in_blocks(batch.column("text").to_pylist()):
                hashes, n = W.shingle_sets(block, size)
                text = np.repeat(np.arange(len(block)), n)
                ends = np.cumsum(n)
                halves = np.empty((len(block), 2), np.uint64)
                for k, seed in enumerate(_DIGESTS):
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mixed(hashes, seed))))
                    halves[:, k] = W.mixed(sums[ends] - sums[ends - n], seed)
                digest = [h.tobytes() for h in halves]
                fresh = np.zeros(len(block), bool)
                for i, (d, k) in enumerate(zip(digest, n.tolist())):
                    if k and d not in seen:
                        fresh[i] = True
                        seen.add(d)
                if len(seen) > SEEN:
                    seen.clear()
                of = fresh[text]
                hashes, text = hashes[of], text[of]
                counts = np.bincount(text * BOUND_CELLS + (hashes % np.uint64(BOUND_CELLS)).astype(np.int64), minlength=len(block) * BOUND_CELLS)
                counts = np.minimum(counts, _FULL).astype(np.uint8).reshape(len(block), BOUND_CELLS)
                cell = level[(hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                order = np.lexsort((W.mixed(hashes, _ORDER_1), cell, text))
                own = np.where(fresh, n, 0)
                rank = np.arange(len(hashes)) - np.repeat(np.cumsum(own) - own, own)
                wanted = np.where(fresh, prefix_length(n, percent), 0)
                prefix = hashes[order][rank < wanted[text]].view(np.int64)
                nodes = node + np.cumsum(fresh) - 1
                node += int(fresh.sum())
                offsets = pa.array(np.concatenate(([0], np.cumsum(wanted))).astype(np.int32), mask=np.append(~fresh, False))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(block)), batch.column("key").slice(at, len(block)), pa.array(digest, pa.binary()),
                     pa.array(n.astype(np.int64)), pa.array(nodes, mask=~fresh),
                     pa.ListArray.from_arrays(offsets, pa.array(prefix)),
                     pa.array([c.tobytes() if new else None for c, new in zip(counts, fresh.tolist())], pa.binary())],
                    ["doc_id", "key", "digest", "n", "node", "prefix", "counts"],
                )
                at += len(block)

    return rows.select("doc_id", "key", "text").mapInArrow(sign, ", ".join(fields))


def wanted_pairs(n: np.ndarray, sides: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that a task looks at: each once, of fitting sizes and of different ``sides``, which is one row or several."""
    m = len(n)
    wanted = np.triu(np.ones((m, m), bool), 1)
    for side in np.atleast_2d(sides):
        wanted &= side[:, None] != side[None, :]
    return wanted & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))


def possible_pairs(n: np.ndarray, sides: np.ndarray, counts: np.ndarray, percent: int, own: np.ndarray | None = None) -> np.ndarray:
    """Which of the wanted pairs may link, by the upper bound of the intersections; one of the two must be ``own``."""
    wanted = wanted_pairs(n, sides, percent)
    if own is not None:
        wanted &= own[:, None] | own[None, :]
    counts = np.where(counts == _FULL, np.int64(1) << 40, counts)
    for i in np.flatnonzero(wanted.any(1)).tolist():
        others = np.flatnonzero(wanted[i])
        most = np.minimum(counts[i], counts[others]).sum(1)
        wanted[i, others] = (100 + percent) * most >= percent * (n[i] + n[others])
    return wanted


def fine_cells(upper: int, percent: int) -> int:
    """Cells of the finer counts in the groups of size band ``upper``: about a quarter of the largest set."""
    return max(BOUND_CELLS, 1 << max(0, int((1.01 * 100 / percent) ** (upper + 1) / 4).bit_length() - 1))


def fine_counts(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows with ``upper`` and ``text``: the text is replaced by ``counts``, the runs of its set per cell."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 64):
            part = batch.slice(begin, 64)
            texts = part.column("text").to_pylist()
            made = []
            for text, upper in zip(texts, part.column("upper").to_pylist()):
                hashes, _ = W.shingle_sets([W.canonical(text)], size)
                cells = fine_cells(upper, percent)
                counts = np.bincount((hashes % np.uint64(cells)).astype(np.int64), minlength=cells)
                made.append(np.minimum(counts, _FULL).astype(np.uint8).tobytes())
            names = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(made, pa.binary())], [*names, "counts"])


def with_partner(n: np.ndarray, sides: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """Which sets may link with another one."""
    pairs = possible_pairs(n, sides, counts, percent)
    return pairs.any(0) | pairs.any(1)


def cells_of_pairs(pairs: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Pairs of blocks of bounded rows and runs that hold a pair, and the rows in them that have a partner there."""
    _, part = np.unique(np.stack((np.arange(len(n)) // BLOCK_ROWS, (np.cumsum(n) - n) // BLOCK_RUNS)), axis=1, return_inverse=True)
    edges = np.searchsorted(part.ravel(), np.arange(part.max() + 2))
    for i in range(len(edges) - 1):
        for j in range(i, len(edges) - 1):
            a, b = slice(edges[i], edges[i + 1]), slice(edges[j], edges[j + 1])
            cell = pairs[a, b]
            if cell.any():
                rows = np.concatenate((edges[i] + np.flatnonzero(cell.any(1)), edges[j] + np.flatnonzero(cell.any(0))))
                yield i, j, np.unique(rows)


def _shared(tokens: np.ndarray, owner: np.ndarray, m: int, columns: int = 4096) -> np.ndarray:
    """How many tokens each two owners share: products of blocks of the incidence matrix."""
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    owner, column = owner[common], column[common]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((m, m), np.float32)
    for lo in range(0, int(column.max()) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, (lo, lo + columns))
        block = np.zeros((m, columns), np.float32)
        block[owner[a:b], column[a:b] - lo] = 1
        out += block @ block.T
    return out


def forest_of_links(nodes: np.ndarray, sides: np.ndarray, texts: list[str | None], size: int, percent: int) -> list[tuple[int, int]]:
    """Links between the texts of one task as pairs (node, smaller node), a forest with the same components.

    ``sides``: only pairs that differ in each of its rows are wanted, the others meet elsewhere.
    """
    m = len(nodes)
    hashes, n = W.shingle_sets([W.canonical(t) for t in texts], size)
    owner = np.repeat(np.arange(m), n)
    wanted = wanted_pairs(n, sides, percent)
    length, begin = prefix_length(n, percent), np.repeat(np.cumsum(n) - n, n)
    for seed in (_ORDER_2, _ORDER_3):
        if not wanted.any():
            return []
        order = np.lexsort((W.mixed(hashes, seed), owner))
        head = order[(np.arange(len(hashes)) - begin) < length[owner]]
        wanted &= _shared(hashes[head], owner[head], m) > 0
    held = wanted.any(0) | wanted.any(1)
    if not held.any():
        return []
    of = held[owner]
    place = np.cumsum(held) - 1
    both = np.zeros((m, m), np.float32)
    both[np.ix_(held, held)] = _shared(hashes[of], place[owner[of]], int(held.sum()))
    wanted &= 100 * both >= percent * (n[:, None] + n[None, :] - both)
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*(x.tolist() for x in np.nonzero(wanted))):
        i, j = find(i), find(j)
        if i != j:
            if nodes[j] < nodes[i]:
                i, j = j, i
            root[j] = i
    return [(int(nodes[i]), int(nodes[find(i)])) for i in range(m) if find(i) != i]


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, component, row_key`` for each row of ``docs``.

    ``component`` is a number of the component's own, whatever its ids (null for rows that link with nothing); ``row_key``
    is xxhash64 of id and text, so rows of one id or none can be told apart.

    ``component_id`` is the smallest id that can be reached by links, the row's own included. Null and empty texts and
    texts of white space have no runs and link with nothing; a text of fewer than ``size`` words is one run. Repeated
    rows come back as often as they came; rows of one id but different texts are linked by their texts alone, and ids
    count in the minimum. A null id never is a minimum unless all are null. Other columns of ``docs`` are not read. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    level = frequency_levels(given.select("text"), size)
    rows = written(signed(given, level, size, percent))

    classes = written(rows.where("n > 0").groupBy("digest", "n").agg(F.min("node").alias("rep"), F.min("doc_id").alias("least_id")))
    # Of a linked pair, the smaller set holds a shared run within a shorter prefix still; runs without such a holder join nothing.
    postings = rows.where("node is not null").select("node", "n", F.posexplode("prefix").alias("place", "token"))
    hubs = (
        postings.withColumn("short", F.col("place") < index_length(F.col("n"), percent)).groupBy("token")
        .agg(F.min("node").alias("hub"), F.count("*").alias("held"), F.bool_or("short").alias("short")).where("held > 1 and short").select("token", "hub")
    )
    postings = postings.select("node", "token")
    met = postings.join(hubs, "token").groupBy("node", "hub").agg(F.count("*").alias("shared"))
    reps = rows.where("node is not null").select("node", "digest", "n").join(classes.select("digest", "n", "rep"), ["digest", "n"])
    band = F.floor(F.log("n") / math.log(1.01 * 100 / percent)).cast("int")
    members = written(met.join(reps.select("node", "rep", "n"), "node").groupBy("hub", "rep", "n").agg(F.max("shared").cast("int").alias("shared")))
    members = members.withColumn("band", band).select(
        "hub", "rep", "n", "shared", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("upper"), (F.col("band") == F.col("upper")).alias("own")
    )
    group = ["hub", "upper"]
    sizes = members.groupBy(*group).agg(F.count("*").cast("int").alias("m"), F.sum(F.col("own").cast("int")).alias("owns")).where("m > 1 and owns > 0")
    placed = written(members.join(sizes.select(*group, "m"), group))
    cell_key = [*group, "lo", "hi"]
    task_key = [*cell_key, "part_lo", "part_hi"]
    carried = ["rep", "label", "key", "n", "own"]

    def bounded(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("n", "ascending"), ("rep", "ascending")])
        n, label, block = (table.column(c).to_numpy() for c in ("n", "label", "block"))
        sides = label if table.column("lo")[0] == table.column("hi")[0] else np.stack((label, block))
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8).reshape(-1, BOUND_CELLS).astype(np.int64)
        pairs = possible_pairs(n, sides, counts, percent, table.column("own").to_numpy())
        table = table.select([*cell_key, *carried])
        out = [table.slice(0, 0).append_column("part_lo", pa.array([], pa.int32())).append_column("part_hi", pa.array([], pa.int32()))]
        for i, j, of in cells_of_pairs(pairs, n):
            at = [pa.array(np.full(len(of), x, np.int32)) for x in (i, j)]
            out.append(table.take(pa.array(of)).append_column("part_lo", at[0]).append_column("part_hi", at[1]))
        return pa.concat_tables(out)

    def verify(table: pa.Table) -> pa.Table:
        first = dict(zip(table.column("rep").to_pylist(), range(table.num_rows)))  # repeated rows have one key and one text
        table = table.take(pa.array(list(first.values())))
        links = forest_of_links(table.column("rep").to_numpy(), table.column("label").to_numpy(), table.column("text").to_pylist(), size, percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    def bounded_again(table: pa.Table) -> pa.Table:
        first = dict(zip(table.column("rep").to_pylist(), range(table.num_rows)))  # repeated rows have one key and one text
        table = table.take(pa.array(list(first.values())))
        n, label, own = (table.column(c).to_numpy() for c in ("n", "label", "own"))
        counts = np.stack([np.frombuffer(c, np.uint8) for c in table.column("counts").to_pylist()]).astype(np.int64)
        pairs = possible_pairs(n, label, counts, percent, own)
        return table.select([*task_key, *carried]).filter(pa.array(pairs.any(0) | pairs.any(1)))

    signs = rows.where("node is not null").select(F.col("node").alias("rep"), "key", "counts")  # a class is signed by one of its nodes

    def links_within(cells: DataFrame) -> DataFrame:
        shape = "hub long, upper int, lo int, hi int, rep long, label long, key long, n long, own boolean, part_lo int, part_hi int"
        met_there = cells.select(*cell_key, "block", "rep", "n", "own", "label").join(signs, "rep")
        near = written(met_there.groupBy(*cell_key).applyInArrow(bounded, shape)).select(*task_key, *carried)
        shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in near.schema)
        fine = with_texts(near).mapInArrow(lambda batches: fine_counts(batches, size, percent), f"{shape}, counts binary")
        nearer = written(fine.groupBy(*task_key).applyInArrow(bounded_again, shape))
        return written(with_texts(nearer).groupBy(*task_key).applyInArrow(verify, "a long, b long").distinct())

    def with_texts(near: DataFrame) -> DataFrame:
        asked = broadcast_if_small(written(near.select("key").distinct()))  # beyond the limit, texts are shuffled once more
        texts = given.select("key", "text").join(asked, "key", "left_semi")
        return near.join(texts, "key").select(*near.columns, "text")

    # Each text with the group whose hub shares most of its prefix; hubs stay in their own groups.
    best = placed.groupBy("rep").agg(F.max(F.struct("shared", "m", (-F.col("hub")).alias("minus_hub"), "upper")).alias("best"))
    chosen = written(
        placed.join(best, "rep").where("rep = hub or (hub = -best.minus_hub and upper = best.upper)").select(*group, "rep", "n", "own")
    )
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_RUNS)).cast("int")
    groups = chosen.groupBy(*group).agg(
        F.count("*").alias("m"), blocks.alias("blocks"), F.array(*[F.min_by("rep", F.xxhash64("rep", F.lit(k))) for k in range(ANCHORS)]).alias("anchors")
    ).where("m > 1")
    anchor = (F.col("rep") == F.col("hub")) | F.array_contains("anchors", F.col("rep"))
    alone = (
        chosen.join(groups, group).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("lo", F.explode(F.when(anchor, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
        .withColumns({"hi": F.col("lo"), "label": F.col("rep"), "own": F.lit(True)})  # it is the only group of its texts
    )
    links = links_within(alone)

    # All groups, by components: what is outside a group's largest component (strays) meets it and each other.
    so_far = connected_components(links).withColumnRenamed("node", "rep")
    labelled = written(placed.drop("shared", "m").join(so_far, "rep", "left").withColumn("label", F.coalesce("label", "rep")))
    several = (
        labelled.groupBy(*group, "label").agg(F.count("*").alias("k")).groupBy(*group)
        .agg(F.sum("k").alias("m"), F.max(F.struct("k", "label")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
        .select(*group, (F.col("m") <= BOUND_ROWS).alias("one"), F.col("main.label").alias("main"),
                F.ceil((F.col("m") - F.col("main.k")) * 2 / BOUND_ROWS).cast("int").alias("stray_blocks"),
                F.ceil(F.col("main.k") * 2 / BOUND_ROWS).cast("int").alias("main_blocks"))
    )
    spread = F.xxhash64("rep")
    block = (
        F.when(F.col("one"), 0)
        .when(F.col("label") == F.col("main"), F.col("stray_blocks") + F.pmod(spread, F.col("main_blocks")))
        .otherwise(F.pmod(spread, F.col("stray_blocks"))).cast("int")
    )
    last = F.when(F.col("one"), 0).when(F.col("block") < F.col("stray_blocks"), F.col("stray_blocks") + F.col("main_blocks") - 1).otherwise(F.col("stray_blocks") - 1)
    across = (
        labelled.join(several, group).withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    )
    links = links.union(links_within(across))
    labels = connected_components(links)
    labelled = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", "n", "least_id", F.coalesce("label", "rep").alias("label")
    )
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_class = labelled.join(least, "label").select("digest", "n", "component_id", F.col("label").alias("component"))
    return rows.select("doc_id", "key", "digest", "n").join(of_class, ["digest", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "component", F.col("key").alias("row_key"),
    )
