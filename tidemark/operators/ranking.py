"""Top rows per group and global order without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor, inf, nextafter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import SALTS, is_small
from tidemark.session import written

ROWS_PER_BUCKET = 4_000_000
#: Buckets that one round of cutting makes of one bucket.
FANOUT = 1_000
SAMPLES_PER_BUCKET = 200
TIED_PARTS = 1_024
SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rk"
) -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1.

    Up to the session's group-limit threshold Spark cuts every group to ``n`` rows inside the map
    tasks. Beyond it the group is first ranked in hashed slices, one per shuffle partition, so that
    the last step sees at most ``n`` rows per slice.
    """
    spark = df.sparkSession
    threshold = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n > threshold:
        slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
        hashable = [
            F.col(f"`{field.name}`") for field in df.schema if field.dataType.typeName() != "map"
        ]
        sliced = df.withColumn("__slice", F.pmod(F.xxhash64(*hashable), F.lit(slices)))
        df = _ranked(sliced, [*group, "__slice"], order, n, "__rank").drop("__slice", "__rank")
    return _ranked(df, group, order, n, rank)


def _ranked(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str
) -> DataFrame:
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def split_points(
    df: DataFrame, column: str, rows_per_bucket: int = ROWS_PER_BUCKET, fanout: int = FANOUT
) -> list[float]:
    """Ascending values that cut ``column`` into buckets of at most twice ``rows_per_bucket`` rows.

    Quantiles of a sample give up to ``fanout`` buckets; then the buckets are counted, and those that are too
    large are cut by quantiles of their own until none is. A value that repeats more often gets a bucket
    to itself (see :func:`is_single`), the only kind that may be larger. One split value per
    ``rows_per_bucket`` rows reaches the driver; they shape the buckets and never decide which rows a result holds.
    """
    values = df.select(F.col(column).alias("__of"))
    rows = values.count()
    if rows <= rows_per_bucket:
        return []
    everything = {"__bucket": 0, "rows": rows, "low": -inf, "high": inf}
    points: set[float] = set()
    large = [everything]
    while large:
        found = _quantiles(with_bucket(values, "__of", sorted(points)), large, rows_per_bucket, fanout)
        before = len(points)
        for bucket in large:
            points |= _cuts(found.get(bucket["__bucket"], []), bucket["low"], bucket["high"])
        if len(points) == before:
            break
        large = [
            row.asDict()
            for row in with_bucket(values, "__of", sorted(points))
            .groupBy("__bucket")
            .agg(
                F.count(F.lit(1)).alias("rows"),
                F.min(F.col("__of").cast("double")).alias("low"),
                F.max(F.col("__of").cast("double")).alias("high"),
            )
            .filter(F.col("rows") > 2 * rows_per_bucket)
            .collect()
        ]
        ordered = sorted(points)
        large = [bucket for bucket in large if not _one_value(ordered, int(bucket["__bucket"]))]
    return sorted(points)


def _quantiles(
    bucketed: DataFrame, large: list[dict], rows_per_bucket: int, fanout: int
) -> dict[float, list[float]]:
    """Sampled quantiles of each of the buckets that are too large."""
    parts = min(fanout, max(ceil(bucket["rows"] / rows_per_bucket) for bucket in large))
    fraction = SAMPLES_PER_BUCKET * parts / min(bucket["rows"] for bucket in large)
    rows = bucketed
    if len(large) > 1 or large[0]["low"] != -inf:
        rows = rows.filter(F.array_contains(F.lit([float(b["__bucket"]) for b in large]), F.col("__bucket")))
    if fraction < 1:
        rows = rows.sample(fraction, seed=1)
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    at = F.percentile_approx(F.col("__of").cast("double"), shares, 10 * parts)
    return {row[0]: row[1] or [] for row in rows.groupBy("__bucket").agg(at.alias("points")).collect()}


def _cuts(quantiles: list[float], low: float, high: float) -> set[float]:
    """Where to cut a bucket with values from ``low`` to ``high``: none if it has a single one.

    A quantile that comes up twice is a frequent value, which is cut off on both sides.
    """
    cuts = set(quantiles)
    cuts |= {nextafter(a, inf) for a, b in zip(quantiles, quantiles[1:]) if a == b}
    if low == high:
        return {low, nextafter(low, inf)}
    inside = {cut for cut in cuts if low < cut <= high}
    if not inside and -inf < low and high < inf:
        # A sample without luck: halving the range always gets on.
        inside = {low / 2 + high / 2} if low < low / 2 + high / 2 else {high}
    return inside


def _one_value(points: Sequence[float], bucket: int) -> bool:
    return 0 < bucket < len(points) and points[bucket] == nextafter(points[bucket - 1], inf)


def is_single(df: DataFrame, column: str, points: Sequence[float], bucket: int) -> bool:
    """Whether all rows of a bucket have the same value of ``column``.

    Integers beyond 2^53 may share a double, so their buckets never count as single.
    """
    integral = df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")
    return integral and _one_value(points, bucket) and abs(points[bucket]) < 2.0**53


def with_bucket(
    df: DataFrame, column: str, points: Sequence[float], bucket: str = "__bucket"
) -> DataFrame:
    """Number rows by the split points around ``column``: bucket order is column order."""
    if not points:
        return df.withColumn(bucket, F.lit(0.0))
    from pyspark.ml.feature import Bucketizer

    bounds = [float("-inf"), *points, float("inf")]
    numbered = df.withColumn("__value", F.col(column).cast("double"))
    cut = Bucketizer(splits=bounds, inputCol="__value", outputCol=bucket)
    return cut.transform(numbered).drop("__value")


def page(
    df: DataFrame,
    column: str,
    offset: int,
    limit: int,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    shape: DataFrame | None = None,
) -> DataFrame:
    """Rows ``offset + 1`` to ``offset + limit`` in the order of the unique numeric ``column``.

    A plain ``orderBy().offset().limit()`` gathers ``offset + limit`` rows in one task. Here the
    values are counted per bucket, the two buckets in which the page begins and ends are ranked to
    find its first and last value, and the page is a range filter the source can apply: whole rows
    are neither sorted nor shuffled. ``shape`` gives rows that are cheaper to read than ``df`` to
    place the buckets by, such as ``df`` before its filters.
    """
    points = split_points(df if shape is None else shape, column, rows_per_bucket)
    # One count per bucket reaches the driver.
    counted = with_bucket(df.select(column), column, points).groupBy("__bucket").count().collect()
    sizes = {int(row["__bucket"]): row["count"] for row in counted}
    last = min(offset + limit, sum(sizes.values()))
    if last <= offset:
        return df.filter(F.lit(False))
    low = _value_at(df, column, points, sizes, offset + 1)
    high = _value_at(df, column, points, sizes, last)
    return df.filter(F.col(column).between(F.lit(low), F.lit(high)))


def _value_at(
    df: DataFrame, column: str, points: Sequence[float], sizes: dict[int, int], position: int
) -> int | float:
    """The value at a position, counted from 1, found by ranking the one bucket that holds it."""
    skipped = 0
    for bucket in sorted(sizes):
        if skipped + sizes[bucket] >= position:
            break
        skipped += sizes[bucket]
    values = df.select(column)
    # The bounds only spare the scan; rounded outwards, they leave the choice to the bucket.
    if bucket > 0:
        values = values.filter(F.col(column) >= F.lit(floor(nextafter(points[bucket - 1], -inf))))
    if bucket < len(points):
        values = values.filter(F.col(column) <= F.lit(ceil(nextafter(points[bucket], inf))))
    within = Window.partitionBy("__bucket").orderBy(column)
    ranked = (
        with_bucket(values, column, points)
        .filter(F.col("__bucket") == bucket)
        .withColumn("__rank", F.row_number().over(within))
    )
    return ranked.filter(F.col("__rank") == position - skipped).first()[column]


def running_max(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    value: str,
    result: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Maximum of ``value`` so far within each group, in the order of the numeric ``order``.

    Rows of a group with the same place in the order count for each other. A window over a whole group would
    hold a hot stream in one task. Instead each bucket of the order runs its own window and starts
    from the maximum of all earlier buckets; a bucket of one place, however large, is run in parts.
    """
    points = split_points(df, order, rows_per_bucket)
    bucketed = with_bucket(df, order, points)
    if not points:
        so_far = Window.partitionBy(*group).orderBy(order).rangeBetween(*SO_FAR)
        return bucketed.withColumn(result, F.max(value).over(so_far)).drop("__bucket")
    single = [float(b) for b in range(len(points) + 1) if is_single(df, order, points, b)]
    tied = F.array_contains(F.lit(single).cast("array<double>"), F.col("__bucket")) if single else F.lit(False)
    slices = [*group, "__bucket"]
    earlier = Window.partitionBy(*group).orderBy("__bucket")
    before = F.max("__top").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    # Rows of one place in the order see each other, so a bucket of such rows starts from its own maximum too.
    carried = (
        bucketed.groupBy(*slices)
        .agg(F.max(value).alias("__top"))
        .withColumn("__carried", F.when(tied, F.greatest(before, "__top")).otherwise(before))
        .select(*slices, "__carried")
    )
    # Sized and joined: two reads of what took a scan of all rows.
    carried = written(carried, "carried")
    # That maximum is their result, whatever part of the bucket they are in.
    hashable = [F.col(f"`{field.name}`") for field in df.schema if field.dataType.typeName() != "map"]
    part = F.when(tied, F.pmod(F.xxhash64(*hashable), F.lit(TIED_PARTS))).otherwise(0)
    parted = bucketed.withColumn("__part", part).withColumn("__salt", F.col("__part") % SALTS)
    on = slices
    if is_small(carried):
        carried = F.broadcast(carried)
    else:
        # Only buckets that are run in parts meet their maximum more than once. The rows stay where the join put them,
        # since the window's groups lie within its keys; the hint keeps Spark from broadcasting one row per bucket.
        salts = [F.array(*[F.lit(salt).cast("long") for salt in range(count)]) for count in (SALTS, 1)]
        carried = carried.withColumn("__salt", F.explode(F.when(tied, salts[0]).otherwise(salts[1]))).hint("merge")
        on = [*slices, "__salt"]
    within = Window.partitionBy(*slices, "__salt", "__part").orderBy(order).rangeBetween(*SO_FAR)
    return (
        parted.join(carried, on, "left")
        .withColumn(result, F.greatest(F.max(value).over(within), F.col("__carried")))
        .drop("__bucket", "__carried", "__part", "__salt")
    )
