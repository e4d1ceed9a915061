"""Distinct keys per window and over ranges: exact, HyperLogLog and k minimum values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import KMV_HASH_BITS, canonical_key, kmv_hash
from tidemark.operators.ranking import top_per_group
from tidemark.schema import HLL_LG_K, STREAM, STREAM_WINDOW


def relative_error(lg_k: int = HLL_LG_K) -> float:
    """Standard error of a HyperLogLog sketch with ``2**lg_k`` registers."""
    return 1.04 / (2**lg_k) ** 0.5


def distinct_keys(rows: DataFrame, group: Sequence[str] = STREAM) -> DataFrame:
    """Exact number of distinct canonical keys per group: ``n_distinct``."""
    return rows.groupBy(*group).agg(
        F.count_distinct(canonical_key(F.col("key"))).alias("n_distinct")
    )


def distinct_sketches(windowed: DataFrame, lg_k: int = HLL_LG_K) -> DataFrame:
    """A mergeable distinct-count sketch per window: ``hll``."""
    return windowed.groupBy(*STREAM_WINDOW).agg(
        F.hll_sketch_agg(canonical_key(F.col("key")), lg_k).alias("hll")
    )


def merged_distinct(sketches: DataFrame, group: Sequence[str] = STREAM) -> DataFrame:
    """Estimated number of distinct keys over the given window sketches."""
    return sketches.groupBy(*group).agg(
        F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("estimate")
    )


def approximate_distinct(rows: DataFrame, lg_k: int = HLL_LG_K) -> DataFrame:
    """Estimated number of distinct keys per stream straight from records."""
    sketch = F.hll_sketch_agg(canonical_key(F.col("key")), lg_k)
    return rows.groupBy(*STREAM).agg(F.hll_sketch_estimate(sketch).alias("estimate"))


def accuracy(rows: DataFrame, lg_k: int = HLL_LG_K) -> DataFrame:
    """The estimate beside the exact count, with its relative error.

    The sketch is fed one row per distinct key, which leaves its content unchanged and needs one
    shuffle for both figures.
    """
    keys = rows.select(*STREAM, canonical_key(F.col("key")).alias("key")).distinct()
    report = keys.groupBy(*STREAM).agg(
        F.count(F.lit(1)).alias("exact"),
        F.hll_sketch_estimate(F.hll_sketch_agg("key", lg_k)).alias("estimate"),
    )
    error = F.abs(F.col("estimate") - F.col("exact")) / F.col("exact")
    return report.withColumn("relative_error", error)


def kmv_hashes(rows: DataFrame, k: int, group: Sequence[str] = STREAM) -> DataFrame:
    """The ``k`` smallest distinct key hashes per group; unions of such sets merge."""
    hashes = rows.select(*group, kmv_hash(F.col("key")).alias("h")).distinct()
    return top_per_group(hashes, group, [F.col("h").asc()], k)


def merge_kmv(hashes: DataFrame, k: int, group: Sequence[str] = STREAM) -> DataFrame:
    """One k-minimum-values set per group from the sets of several windows."""
    return top_per_group(hashes.select(*group, "h").distinct(), group, [F.col("h").asc()], k)


def kmv_estimate(hashes: DataFrame, k: int, group: Sequence[str] = STREAM) -> DataFrame:
    """Distinct keys from k minimum values; exact while there are fewer than ``k`` keys."""
    kept = hashes.groupBy(*group).agg(F.count(F.lit(1)).alias("kept"), F.max("h").alias("h_k"))
    return kept.select(*group, _from_minimum_values(k).alias("estimate"))


def _from_minimum_values(k: int) -> Column:
    """Distinct keys from the number of hashes ``kept`` and the largest of them, ``h_k``."""
    scaled = F.lit(float(k - 1)) / (F.col("h_k").cast("double") / F.lit(float(2**KMV_HASH_BITS)))
    return F.when(F.col("kept") < k, F.col("kept").cast("double")).otherwise(scaled)


def compare_kmv(hashes: DataFrame, left: Column, k: int, group: Sequence[str] = ()) -> DataFrame:
    """Two sets of keys per group, from their minimum values: ``either``, ``shared``, ``left_only``, ``right_only``.

    ``left`` is true for hashes of the one set, false for those of the other and null for neither. Both may
    be given by the minimum sets of several windows. The ``k`` smallest hashes of the union are a sample of it in which
    every key is known to be in one set, the other or both; below ``k`` keys everything is exact. ``similarity`` is
    the Jaccard index.
    """
    sided = hashes.select(*group, "h", left.alias("left")).filter(F.col("left").isNotNull())
    marked = sided.groupBy(*group, "h").agg(F.max("left").alias("left"), F.max(~F.col("left")).alias("right"))
    if group:
        sample = top_per_group(marked, group, [F.col("h").asc()], k)
    else:
        sample = marked.orderBy("h").limit(k)
    counted = sample.groupBy(*group).agg(
        F.count(F.lit(1)).alias("kept"),
        F.max("h").alias("h_k"),
        F.count_if(F.col("left") & F.col("right")).alias("shared"),
        F.count_if(F.col("left") & ~F.col("right")).alias("left_only"),
        F.count_if(~F.col("left") & F.col("right")).alias("right_only"),
    )
    sized = counted.withColumn("either", _from_minimum_values(k))
    shares = [
        F.coalesce(F.col(part) * F.col("either") / F.nullif("kept", F.lit(0)), F.lit(0.0)).alias(part)
        for part in ("shared", "left_only", "right_only")
    ]
    similarity = F.col("shared") / F.nullif("kept", F.lit(0))
    return sized.select(*group, "either", *shares, similarity.alias("similarity"))
