"""From flat catalogue relations to rows of the snapshot store, growth included."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import model
from ..operators import collect, history
from ..session import written

_TOTALS = [*model.TABLE_KEY, "data_bytes", "index_bytes", "total_bytes"]
_HEAD = ["snapshot_id", "data_source_id", "captured_at"]


def with_growth(
    headers: DataFrame,
    relations: dict[str, DataFrame],
    before_headers: DataFrame | None = None,
    before_totals: DataFrame | None = None,
) -> DataFrame:
    """Table sizes with growth, of the given snapshots and of the stored ones among which they fall.

    ``before_headers`` / ``before_totals``: stored snapshots just before and after the given ones, and their table totals.
    """
    sizes = collect.attach_storage(relations["tables"].select(*model.TABLE_KEY), relations["storage"])
    known, heads = sizes.join(headers.where("storage_growth").select("snapshot_id"), "snapshot_id", "left_semi"), headers.select(*_HEAD)
    if before_headers is not None and before_totals is not None:
        known = known.unionByName(before_totals.select(*_TOTALS), allowMissingColumns=True)
        heads = heads.unionByName(before_headers.select(*_HEAD))
    return history.storage_growth(known, heads)


def summaries(grown: DataFrame) -> DataFrame:
    """snapshot_id, storage_summary."""
    fields = ["data_bytes", "index_bytes", "total_bytes", "growth_bytes", "observed_tables", "comparable_tables"]
    return history.storage_summary(grown).select("snapshot_id", F.struct(*fields).alias("storage_summary"))


def collected(
    headers: DataFrame,
    relations: dict[str, DataFrame],
    before_headers: DataFrame | None = None,
    before_totals: DataFrame | None = None,
    grown: DataFrame | None = None,
) -> DataFrame:
    """Store rows of the given snapshots.

    With stored snapshots around them (as in `with_growth`) growth carries on from the store. Growth is added to the
    storage relation; the digest leaves it out. ``grown``: what `with_growth` gives for these arguments, if it is at hand already.
    """
    # Summaries and assembly both read it.
    grown = written(with_growth(headers, relations, before_headers, before_totals)) if grown is None else grown
    if before_headers is not None:
        grown = grown.join(headers.where("storage_growth").select("snapshot_id"), "snapshot_id", "left_semi")
    return collect.assemble(headers.join(summaries(grown), "snapshot_id", "left"), {**relations, "storage": grown})
