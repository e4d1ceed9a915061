"""Space-Saving summaries as tables: bounded lists of frequent keys that merge.

A summary of a group has at most ``capacity`` rows ``(rk, key, count, error, floor)`` and says

* of a listed key, that it occurred at most ``count`` and at least ``count - error`` times,
* of every other key, that it occurred at most ``floor`` times, the same number on all rows.

Merging keeps both. A key's count is what its summaries say plus the floors of those that do not list it; what the cut to
``capacity`` drops raises the floor. The floor never exceeds the group's events divided by ``capacity + 1``: a list
that drops a key at some count holds ``capacity`` others with at least that much above the earlier floor. So every key
more frequent than that is listed, whatever the order and number of merges.

Building and merging are group-bys and a cut to the top of each group inside the map tasks; the only rows that meet in
one task are the ``capacity + 1`` of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import is_small
from tidemark.operators.ranking import top_per_group
from tidemark.schema import STREAM, STREAM_WINDOW, TOP_LIST_CAPACITY, WINDOW

SUMMARY = ["rk", "key", "count", "error", "floor"]


def summaries(
    counts: DataFrame,
    capacity: int | Column = TOP_LIST_CAPACITY,
    group: Sequence[str] = STREAM_WINDOW,
    largest: int | None = None,
) -> DataFrame:
    """A summary of every group from exact counts ``(group, key, n)``.

    Only the cut loses anything: listed counts have no error. ``capacity`` may be a column that is the same within
    a group, at most ``largest``.
    """
    most = capacity if isinstance(capacity, int) else largest
    if most is None:
        raise ValueError("a capacity from a column needs its largest value")
    rows = counts.select(
        *group,
        "key",
        F.col("n").alias("count"),
        F.lit(0).cast("long").alias("error"),
        F.lit(0).cast("long").alias("base"),
        F.lit(capacity).cast("long").alias("capacity"),
    )
    return _cut(rows, group, most)


def from_top_lists(lists: DataFrame, capacity: int | Column, group: Sequence[str] = STREAM_WINDOW) -> DataFrame:
    """Top lists ``(group, rk, key, n)`` as summaries: behind a full list no key is more frequent than its last one."""
    last = F.when(F.col("rk") == F.lit(capacity), F.col("n"))
    floor = F.coalesce(F.max(last).over(Window.partitionBy(*group)), F.lit(0))
    return lists.select(
        *group, "rk", "key", F.col("n").alias("count"), F.lit(0).cast("long").alias("error"), floor.alias("floor")
    )


def merge(
    parts: DataFrame,
    capacity: int = TOP_LIST_CAPACITY,
    members: Sequence[str] = WINDOW,
    group: Sequence[str] = STREAM,
) -> DataFrame:
    """One summary per group from the summaries ``parts``, which ``members`` tell apart within their group."""
    # Every summary adds its floor once, whether a key is in it or not.
    bases = (
        parts.groupBy(*group, *members)
        .agg(F.max("floor").alias("floor"))
        .groupBy(*group)
        .agg(F.sum("floor").alias("base"))
    )
    keys = parts.groupBy(*group, "key").agg(
        F.sum(F.col("count") - F.col("floor")).alias("above"),
        F.sum(F.col("count") - F.col("error")).alias("least"),
    )
    count = F.col("above") + F.col("base")
    rows = _beside(keys, bases, group).select(
        *group,
        "key",
        count.alias("count"),
        (count - F.col("least")).alias("error"),
        "base",
        F.lit(capacity).cast("long").alias("capacity"),
    )
    return _cut(rows, group, capacity)


def _beside(keys: DataFrame, bases: DataFrame, group: Sequence[str]) -> DataFrame:
    """Join the one row of every group; a null in the group is a value like any other."""
    named = bases.withColumnsRenamed({name: f"__{name}" for name in group})
    same = F.lit(True)
    for name in group:
        same &= F.col(name).eqNullSafe(F.col(f"__{name}"))
    return keys.join(F.broadcast(named) if is_small(named) else named, same)


def _cut(rows: DataFrame, group: Sequence[str], most: int) -> DataFrame:
    """The first ``capacity`` rows of every group; the one behind them, if there is one, gives the floor."""
    order = [F.col("count").desc(), F.col("key").asc()]
    held = top_per_group(rows, group, order, most + 1)
    behind = F.when(F.col("rk") == F.col("capacity") + 1, F.col("count"))
    floor = F.coalesce(F.max(behind).over(Window.partitionBy(*group)), F.col("base"))
    listed = held.withColumn("floor", floor).filter(F.col("rk") <= F.col("capacity"))
    return listed.select(*group, *SUMMARY)
