"""The count-min sketch as a table with one row per non-empty cell.

Building, merging and probing are a group-by, a group-by and a join, so a sketch of any number of
windows is spread over the cluster and has an exact answer in any SQL engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import sketch_buckets
from tidemark.schema import (
    SKETCH_DEPTH,
    SKETCH_MAX_VALUE,
    SKETCH_WIDTH,
    STREAM,
    STREAM_WINDOW,
)


def cells(
    counts: DataFrame,
    depth: int = SKETCH_DEPTH,
    width: int | Column = SKETCH_WIDTH,
    max_value: int | Column = SKETCH_MAX_VALUE,
    group: Sequence[str] = STREAM_WINDOW,
) -> DataFrame:
    """Cells ``(i, b, v)`` per window from per-window key counts.

    Width and cap may be columns, one value per stream. Only distinct keys are expanded into
    ``depth`` cells, never single events.
    """
    capped = counts.withColumn("__cap", F.lit(max_value).cast("long"))
    placed = _placed(capped, [*group, "n", "__cap"], depth, width)
    summed = placed.groupBy(*group, "__cap", "i", "b").agg(F.sum("n").alias("v"))
    return summed.withColumn("v", F.least("v", "__cap")).drop("__cap")


def merge(window_cells: DataFrame, group: Sequence[str] = STREAM) -> DataFrame:
    """One sketch per group: cells add up over windows."""
    return window_cells.groupBy(*group, "i", "b").agg(F.sum("v").alias("v"))


def estimate(
    keys: DataFrame,
    merged: DataFrame,
    depth: int = SKETCH_DEPTH,
    width: int | Column = SKETCH_WIDTH,
    group: Sequence[str] = STREAM,
) -> DataFrame:
    """Estimated count of each ``(group, key)``: the smallest of its cells.

    Never below the true count while no cell has reached its cap. A key of which some cell is empty
    was never counted and gets 0.
    """
    sized = keys.withColumn("__width", F.lit(width).cast("long"))
    probes = sized.select(*group, "key", "__width").distinct()
    placed = _placed(probes, [*group, "key"], depth, F.col("__width"))
    found = placed.join(merged, [*group, "i", "b"], "left")
    lowest = F.min(F.coalesce(F.col("v"), F.lit(0)))
    return found.groupBy(*group, "key").agg(lowest.alias("estimate"))


def _placed(rows: DataFrame, columns: list[str], depth: int, width: int | Column) -> DataFrame:
    """Each row once per sketch row, with its cell. The projection shares the digest of a key.

    The arrays are never empty, so the outer form changes no result; it keeps Spark from deriving
    an is-not-empty filter and hashing every record below the aggregation to evaluate it.
    """
    buckets = rows.withColumn("__buckets", sketch_buckets(F.coalesce("key", F.lit("")), depth, width))
    return buckets.select(*columns, F.posexplode_outer("__buckets").alias("i", "b"))
