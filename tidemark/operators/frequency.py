"""Key frequencies per window and most frequent keys over ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import Moment
from tidemark.operators.ranking import top_per_group
from tidemark.operators.windows import open_window
from tidemark.schema import DAY_MS, STREAM, STREAM_WINDOW, TOP_LIST_CAPACITY


def by_count() -> list:
    """Most frequent first; equal counts in key order."""
    return [F.col("n").desc(), F.col("key").asc()]


def key_counts(windowed: DataFrame) -> DataFrame:
    """Occurrences of each key per window: ``n``. A hot key is counted inside the map tasks."""
    return windowed.groupBy(*STREAM_WINDOW, "key").agg(F.count(F.lit(1)).alias("n"))


def event_counts(windowed: DataFrame) -> DataFrame:
    """Events per window: ``n_events``; windows without events do not appear."""
    return windowed.groupBy(*STREAM_WINDOW).agg(F.count(F.lit(1)).alias("n_events"))


def total_counts(rows: DataFrame, group: Sequence[str] = STREAM) -> DataFrame:
    """Count per key over all given windows, from records or from per-window counts."""
    total = F.sum("n") if "n" in rows.columns else F.count(F.lit(1))
    return rows.groupBy(*group, "key").agg(total.alias("n"))


def top_list(counts: DataFrame, capacity: int = TOP_LIST_CAPACITY) -> DataFrame:
    """The bounded top list of every window, from per-window counts."""
    return top_per_group(counts, STREAM_WINDOW, by_count(), capacity)


def configured_top_list(counts: DataFrame, largest: int | None = None) -> DataFrame:
    """Top lists cut at every stream's own ``topk_max_count``, whatever it is.

    ``largest`` is the largest of these numbers, for the first cut; it is looked up if not given.
    """
    if largest is None:
        largest = counts.agg(F.max("topk_max_count")).first()[0] or 0
    return top_list(counts, largest).filter(F.col("rk") <= F.col("topk_max_count"))


def top_keys(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent keys of every stream over the given windows, exactly."""
    return top_per_group(total_counts(rows), STREAM, by_count(), k)


def top_keys_of_stream(rows: DataFrame, k: int) -> DataFrame:
    """As :func:`top_keys` for rows of a single stream, without a ranking window."""
    return total_counts(rows).orderBy(*by_count()).limit(k)


def top_keys_truncated(counts: DataFrame, k: int) -> DataFrame:
    """Top keys merged from the first ``k + k // 2`` entries of every window.

    Reads little when top lists are stored, but misses keys that are mid-ranked in many windows;
    :func:`top_keys` is exact.
    """
    if "rk" in counts.columns:
        heads = counts.filter(F.col("rk") <= k + k // 2)
    else:
        heads = top_list(counts, k + k // 2)
    return top_keys(heads, k)


def current_top_keys(
    records: DataFrame, k: int, as_of: Moment, slide_ms: int = DAY_MS, offset_ms: int = 0
) -> DataFrame:
    """The ``k`` most frequent keys of every stream's open window."""
    return top_keys(open_window(records, as_of, slide_ms, offset_ms), k)


def top_sketches(windowed: DataFrame, capacity: int = TOP_LIST_CAPACITY) -> DataFrame:
    """A mergeable top-k sketch per window that tracks at most ``capacity`` keys."""
    sketch = F.expr(f"approx_top_k_accumulate(key, {int(capacity)})")
    return windowed.groupBy(*STREAM_WINDOW).agg(sketch.alias("sketch"))


def merged_top_keys(
    sketches: DataFrame, k: int, capacity: int = TOP_LIST_CAPACITY
) -> DataFrame:
    """Approximate top keys of every stream over the given window sketches."""
    merged = sketches.groupBy(*STREAM).agg(
        F.expr(f"approx_top_k_combine(sketch, {int(capacity)})").alias("sketch")
    )
    items = merged.select(
        *STREAM, F.explode(F.expr(f"approx_top_k_estimate(sketch, {int(k)})")).alias("item")
    )
    return items.select(
        *STREAM, F.col("item.item").alias("key"), F.col("item.count").alias("estimate")
    )


def monitored_keys(rows: DataFrame, k: int, capacity: int) -> DataFrame:
    """Approximate top keys of every stream from one list of at most ``capacity`` entries."""
    listed = rows.groupBy(*STREAM).agg(
        F.expr(f"approx_top_k(key, {int(k)}, {int(capacity)})").alias("items")
    )
    return listed.select(*STREAM, F.explode("items").alias("item")).select(
        *STREAM, F.col("item.item").alias("key"), F.col("item.count").alias("estimate")
    )
