"""Differences between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import model
from ..session import broadcast_if_small, written
from .collect import GROWTH
from .flatten import LEAF_KINDS, OBJECT_KEY, PLACE, objects, of_kind, printed_key
from .history import sequenced


def added(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(old.select(*keys), keys, "left_anti")


def removed(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti")


def key_sets(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of both sides with the set they are in: added, removed or common."""
    sides = new.select(*keys, F.lit(1).alias("_new"), F.lit(0).alias("_old")).unionAll(
        old.select(*keys, F.lit(0).alias("_new"), F.lit(1).alias("_old"))
    )
    both = sides.groupBy(*keys).agg(F.max("_new").alias("_new"), F.max("_old").alias("_old"))
    member = F.when(F.col("_old") == 0, "added").when(F.col("_new") == 0, "removed").otherwise("common")
    return both.select(*keys, member.alias("member"))


def _changes(rows: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """Rows of both sides (`side`: before or after, `value`) -> keys, `change`, `before_value`, `after_value`.

    Both sides meet in one grouping on the key parts: null parts match each other, of repeated keys the last by
    ``place`` counts, and a hot key is pre-aggregated before the shuffle.
    """
    on = lambda side, value: F.when(F.col("side") == side, value)
    met = rows.groupBy(*keys).agg(
        F.count(on("before", F.lit(1))).alias("_before"), F.count(on("after", F.lit(1))).alias("_after"),
        F.max_by("value", on("before", place)).alias("before_value"), F.max_by("value", on("after", place)).alias("after_value"),
    )
    change = (
        F.when(F.col("_before") == 0, "added")
        .when(F.col("_after") == 0, "removed")
        .when(~F.col("before_value").eqNullSafe(F.col("after_value")), "changed")
    )
    kept = met.withColumn("change", change).where(F.col("change").isNotNull())
    return kept.select(*keys, "change", "before_value", "after_value")


def diff(before: DataFrame, after: DataFrame, keys: list[str], value: str = "value", values: bool = True, place: str | None = None) -> DataFrame:
    """Added, removed and changed objects of flat relations: keys, `change`, `before_value`, `after_value`.

    Of repeated keys the last by the column ``place`` counts, else the largest value. With ``values=False`` only
    digests of the values are shuffled, which is enough for counting, and no values are returned.
    """
    held = F.col(value) if values else F.unhex(F.sha2(F.col(value), 256))
    side = lambda rows, name: rows.select(*keys, held.alias("value"), (F.col(place) if place else held).alias("_place"), F.lit(name).alias("side"))
    found = _changes(side(before, "before").unionAll(side(after, "after")), keys, F.col("_place"))
    return found if values else found.drop("before_value", "after_value")


def neighbour_pairs(headers: DataFrame) -> DataFrame:
    """data_source_id, from_snapshot_id, to_snapshot_id of every two neighbouring snapshots of every source."""
    heads = sequenced(headers.select("snapshot_id", "data_source_id", "captured_at")).select("snapshot_id", "data_source_id", "seq")
    older = heads.select("data_source_id", (F.col("seq") + 1).alias("seq"), F.col("snapshot_id").alias("from_snapshot_id"))
    return heads.withColumnRenamed("snapshot_id", "to_snapshot_id").join(older, ["data_source_id", "seq"]).select("data_source_id", "from_snapshot_id", "to_snapshot_id")


def _placed(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows with the number `seq` of their snapshot in its source, and the ids of the snapshots before and after it."""
    heads = sequenced(headers.select("snapshot_id", "data_source_id", "captured_at"))
    none, own = F.lit(None).cast("bigint"), F.col("snapshot_id")
    slot = lambda seq, *ids: F.struct(seq.alias("seq"), *[i.alias(n) for i, n in zip(ids, ("_own", "_before", "_after"))])
    slots = F.array(slot(F.col("seq"), own, none, none), slot(F.col("seq") + 1, none, own, none), slot(F.col("seq") - 1, none, none, own))
    line = heads.select("data_source_id", F.inline(slots)).groupBy("data_source_id", "seq").agg(*[F.max(c).alias(c) for c in ("_own", "_before", "_after")])
    line = line.where("_own IS NOT NULL").withColumnRenamed("_own", "snapshot_id")
    return rows.drop("data_source_id", "captured_at", "run_id").join(broadcast_if_small(written(line)), "snapshot_id")


def neighbour_changes(rows: DataFrame, headers: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """What happened to every object between every two neighbouring snapshots of every source.

    ``rows``: snapshot_id, ``keys`` (one row of a key in a snapshot) and ``value``. Gives data_source_id,
    from_snapshot_id, to_snapshot_id, keys, `change` (added, removed, changed or same), before_value and after_value.
    One scan and one shuffle: the rows of an object are put in line, and each looks at the one before and after it.
    """
    line = W.partitionBy("data_source_id", *keys).orderBy("seq")
    was, after = F.lag("seq").over(line), F.lead("seq").over(line)
    met = _placed(rows.select("snapshot_id", *keys, F.col(value).alias("_value")), headers).select(
        "*", was.alias("_was"), F.lag("_value").over(line).alias("_old"), after.alias("_next"))
    none = F.lit(None).cast(met.schema["_value"].dataType)
    here = F.col("_was").eqNullSafe(F.col("seq") - 1)

    def event(start: Column, end: Column, change: Column, before: Column, now: Column) -> Column:
        return F.struct(start.alias("from_snapshot_id"), end.alias("to_snapshot_id"), change.alias("change"), before.alias("before_value"), now.alias("after_value"))

    change = F.when(~here, "added").when(F.col("_old").eqNullSafe(F.col("_value")), "same").otherwise("changed")
    arrived = F.when(F.col("_before").isNotNull(), event(F.col("_before"), F.col("snapshot_id"), change, F.when(here, F.col("_old")), F.col("_value")))
    gone = F.col("_after").isNotNull() & ~F.col("_next").eqNullSafe(F.col("seq") + 1)
    left = F.when(gone, event(F.col("snapshot_id"), F.col("_after"), F.lit("removed"), F.col("_value"), none))
    return met.select("data_source_id", *keys, F.explode(F.array_compact(F.array(arrived, left))).alias("e")).select("data_source_id", "e.from_snapshot_id", "e.to_snapshot_id", *keys, "e.change", "e.before_value", "e.after_value")


def object_versions(rows: DataFrame, headers: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Every object once for each run of neighbouring snapshots with an unchanged value.

    data_source_id, keys, `first_seq`, `last_seq` (numbers of the snapshots in their source) and ``value``. An object is
    in snapshot n if one of its runs covers n; two snapshots differ where the covering runs do. Gaps and islands: a run
    starts where the row before is missing or different, and the number of starts so far is the number of the run.
    """
    line = W.partitionBy("data_source_id", *keys).orderBy("seq")
    placed = _placed(rows.select("snapshot_id", *keys, F.col(value)), headers)
    same = F.lag("seq").over(line).eqNullSafe(F.col("seq") - 1) & F.lag(value).over(line).eqNullSafe(F.col(value))
    runs = placed.withColumn("_start", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_start").over(line))
    return runs.groupBy("data_source_id", *keys, "_run").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.first(value).alias(value)).drop("_run")


def version_diff(versions: DataFrame, pairs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Differences of any two snapshots of a source from `object_versions`: intervals are filtered, no snapshot is read.

    ``pairs``: data_source_id, from_seq, to_seq. Gives the pair, keys, `change`, before_value and after_value.
    """
    pair = ["data_source_id", "from_seq", "to_seq"]
    covers = lambda n: (F.col("first_seq") <= F.col(n)) & (F.col(n) <= F.col("last_seq"))
    met = versions.join(broadcast_if_small(pairs.select(*pair)), "data_source_id").where(covers("from_seq") != covers("to_seq"))
    found = met.groupBy(*pair, *keys).agg(
        F.count_if(covers("from_seq")).alias("_before"), F.count_if(covers("to_seq")).alias("_after"),
        F.max(F.when(covers("from_seq"), F.col(value))).alias("before_value"), F.max(F.when(covers("to_seq"), F.col(value))).alias("after_value"))
    change = (
        F.when(F.col("_before") == 0, "added").when(F.col("_after") == 0, "removed")
        .when(~F.col("before_value").eqNullSafe(F.col("after_value")), "changed"))
    return found.withColumn("change", change).where("change IS NOT NULL").drop("_before", "_after")


def changed_objects(stored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Objects whose digests differ between the snapshots of a pair: snapshot_id, kind, schema_name, name, the pair, `side`.

    Reads ids, names and digests only. Equal objects meet here and go no further, with all that is below them.
    """
    pair = ["from_snapshot_id", "to_snapshot_id"]
    side = lambda end, name: F.struct(F.col(end).alias("snapshot_id"), F.lit(name).alias("side"))
    wanted = pairs.select(*pair, F.inline(F.array(side(pair[0], "before"), side(pair[1], "after"))))
    # The digest leaves growth out, but a difference in it is one: it follows the digest as text.
    grown = F.concat_ws(":", "digest", *[F.coalesce(F.col(f"storage.{g}").cast("string"), F.lit("")) for g in GROWTH])
    rows = of_kind(stored, model.SCHEMA, model.TABLE_KIND, model.VIEW_KIND, model.ROUTINE_KIND).select("snapshot_id", "kind", "schema_name", "name", grown.alias("digest"))
    met = rows.join(broadcast_if_small(wanted), "snapshot_id").groupBy(*pair, "kind", "schema_name", "name").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("digest")))).alias(s) for s in ("before", "after")])
    differ = met.where(F.col("before") != F.col("after"))
    sides = F.array(*[F.when(F.size(s) > 0, side(end, s)) for end, s in zip(pair, ("before", "after"))])
    return differ.select(*pair, "kind", "schema_name", "name", F.inline(F.array_compact(sides)))


def snapshot_diff(stored: DataFrame, pairs: DataFrame, without: tuple[str, ...] = (), kinds: tuple[str, ...] = LEAF_KINDS) -> DataFrame:
    """Differences of many snapshot pairs at once, from the store.

    ``pairs``: from_snapshot_id, to_snapshot_id (see `checked_pairs`). Digests decide which objects differ; only these
    are read whole and taken apart, and only the asked ``kinds`` are printed. Both sides meet in one grouping on the
    object key, which also keeps the last of repeated names.
    """
    pair = ["from_snapshot_id", "to_snapshot_id"]
    differ = changed_objects(stored, pairs)
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("kind", "schema_name", "name")]
    fetched = stored.alias("s").join(differ.alias("d"), [F.col("s.snapshot_id") == F.col("d.snapshot_id"), *same]).select("s.*", *[f"d.{c}" for c in (*pair, "side")])
    rows = objects(fetched, without, (*pair, "side"), kinds)
    keys = [*pair, *OBJECT_KEY]
    found = _changes(rows, keys, F.struct(*PLACE))
    return found.select(*keys, printed_key().alias("key"), "change", "before_value", "after_value")


def checked_pairs(pairs: DataFrame, headers: DataFrame) -> DataFrame:
    """Pairs with `valid` and `reason`: both snapshots must exist and belong to the asked source."""
    ids = headers.select("snapshot_id", "data_source_id")
    old = ids.withColumnsRenamed({"snapshot_id": "from_snapshot_id", "data_source_id": "_from_source"})
    new = ids.withColumnsRenamed({"snapshot_id": "to_snapshot_id", "data_source_id": "_to_source"})
    joined = pairs.join(old, "from_snapshot_id", "left").join(new, "to_snapshot_id", "left")
    reason = (
        F.when(F.col("_from_source").isNull() | F.col("_to_source").isNull(), "unknown snapshot")
        .when((F.col("_from_source") != F.col("data_source_id")) | (F.col("_to_source") != F.col("data_source_id")), "other source")
    )
    return joined.withColumn("reason", reason).withColumn("valid", reason.isNull()).drop("_from_source", "_to_source")


def diff_counts(changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts of added, removed and changed objects; kinds that do not occur count zero."""
    counts = [F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")]
    return changes.groupBy(*(keys or [])).agg(*counts)


def in_key_order(changes: DataFrame) -> DataFrame:
    """Added, then removed, then changed, each by key."""
    rank = F.when(F.col("change") == "added", 0).when(F.col("change") == "removed", 1).otherwise(2)
    return changes.orderBy(rank, "key")
