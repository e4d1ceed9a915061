"""Attributes of keys: first seen per window, newest window over a range, with counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.attributes import with_key
from tidemark.schema import STREAM, STREAM_WINDOW


def _arrival() -> Column:
    return F.struct("ts", "seq")


def key_rollup(windowed: DataFrame) -> DataFrame:
    """One row per window and key: ``n`` and the first attributes seen, null if it had none.

    Counts and attributes come from one aggregation, so a rollup shuffles the records once.
    """
    seen = F.when(F.col("values").isNotNull(), _arrival())
    return windowed.groupBy(*STREAM_WINDOW, "key").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("values", seen).alias("values")
    )


def first_seen(windowed: DataFrame) -> DataFrame:
    """The first attributes of each key per window."""
    carrying = windowed.filter(F.col("values").isNotNull())
    return carrying.groupBy(*STREAM_WINDOW, "key").agg(
        F.min_by("values", _arrival()).alias("values")
    )


def newest(window_values: DataFrame, group: Sequence[str] = STREAM) -> DataFrame:
    """The attributes of each key in the newest window that has some."""
    carrying = window_values.filter(F.col("values").isNotNull())
    return carrying.groupBy(*group, "key").agg(F.max_by("values", "window_start").alias("values"))


def values_with_counts(windowed: DataFrame) -> DataFrame:
    """Newest attributes and total count of every key that ever carried attributes.

    The newest window wins, and within it the first arrival. Both are one order on the records, so
    records need a single aggregation and a single shuffle; the rows of :func:`key_rollup`, one per
    window and key, are merged the same way.
    """
    if "n" in windowed.columns:
        total = F.sum("n")
        order = F.when(F.col("values").isNotNull(), F.col("window_start"))
    else:
        total = F.count(F.lit(1))
        order = F.when(
            F.col("values").isNotNull(),
            F.struct(F.col("window_start"), -F.unix_micros("ts"), -F.col("seq")),
        )
    merged = windowed.groupBy(*STREAM, "key").agg(
        F.max_by("values", order).alias("values"), total.alias("n")
    )
    return merged.filter(F.col("values").isNotNull())


def attach_counts(values: DataFrame, counts: DataFrame, count: str = "n") -> DataFrame:
    """Add each key's count; both sides have one row per key, and no count means 0."""
    found = values.join(counts.select(*STREAM, "key", count), [*STREAM, "key"], "left")
    return found.withColumn(count, F.coalesce(F.col(count), F.lit(0)))


def values_of_key(window_values: DataFrame, key: str) -> DataFrame:
    """The attribute map of one key."""
    return window_values.filter(F.col("key") == key)


def first_values(window_values: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` attribute rows in key order."""
    return window_values.orderBy("key").limit(limit)


def values_and_key(window_values: DataFrame) -> DataFrame:
    """Attribute rows with the key as an attribute of its own."""
    return window_values.withColumn("values", with_key(F.col("values"), F.col("key")))
