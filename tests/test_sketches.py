import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import records, rows
from tidemark.operators import countmin, distinct, frequency, windows
from tidemark.schema import STREAM

DEPTH, WIDTH = 3, 64


@pytest.fixture(scope="module")
def daily(spark):
    """Five days in which one key holds a third of all events."""
    rng = random.Random(11)
    data = [
        ("hot" if rng.random() < 0.34 else f"k{rng.randrange(300)}", f"2013-05-{rng.randrange(1, 6):02}", None)
        for _ in range(4000)
    ]
    return windows.assign_windows(records(spark, data)).cache()


def cells(rows_):
    return countmin.cells(frequency.key_counts(rows_), DEPTH, WIDTH)


def test_estimates_are_never_below_the_count(daily):
    merged = countmin.merge(cells(daily))
    exact = frequency.total_counts(daily)
    both = countmin.estimate(exact, merged, DEPTH, WIDTH).join(exact, [*STREAM, "key"])
    assert both.filter("estimate < n").count() == 0
    assert both.count() == exact.count()
    # With far more cells than keys the estimate is the count.
    wide = countmin.cells(frequency.key_counts(daily), DEPTH, 1 << 20)
    precise = countmin.estimate(exact, countmin.merge(wide), DEPTH, 1 << 20)
    assert rows(precise, "key", "estimate") == rows(exact, "key", "n")


def test_merging_windows_equals_sketching_the_range(daily):
    per_window = countmin.merge(cells(daily))
    at_once = countmin.cells(frequency.total_counts(daily), DEPTH, WIDTH, group=STREAM)
    assert rows(per_window) == rows(at_once)
    early, late = daily.filter("day(ts) <= 2"), daily.filter("day(ts) > 2")
    for first, second in ((early, late), (late, early)):
        halves = countmin.merge(cells(first)).unionByName(countmin.merge(cells(second)))
        assert rows(countmin.merge(halves)) == rows(at_once)


def test_cells_stop_at_their_cap(daily):
    capped = countmin.cells(frequency.key_counts(daily), DEPTH, WIDTH, 10)
    assert capped.agg(F.max("v")).first()[0] == 10


def test_every_event_is_in_every_sketch_row(daily):
    per_row = cells(daily).groupBy("i").agg(F.sum("v").alias("v"))
    assert rows(per_row, "v") == [(4000,)] * DEPTH


def test_unknown_keys_are_estimated_from_their_cells(spark, daily):
    probe = spark.createDataFrame([("s", "c", "never"), ("s", "other", "hot")], [*STREAM, "key"])
    wide = countmin.merge(countmin.cells(frequency.key_counts(daily), DEPTH, 1 << 20))
    found = countmin.estimate(probe, wide, DEPTH, 1 << 20)
    assert rows(found, "key", "estimate") == [("hot", 0), ("never", 0)]


def test_distinct_sketches_merge_in_any_order(daily):
    sketches = distinct.distinct_sketches(daily)
    exact = distinct.distinct_keys(daily).first()["n_distinct"]
    merged = distinct.merged_distinct(sketches).first()["estimate"]
    direct = distinct.approximate_distinct(daily).first()["estimate"]
    assert abs(merged - exact) <= 3 * distinct.relative_error() * exact
    assert abs(direct - exact) <= 3 * distinct.relative_error() * exact
    assert distinct.merged_distinct(sketches.orderBy(F.desc("window_start"))).first()["estimate"] == merged


def test_distinct_ignores_the_case_of_digests(spark):
    digest = "0cc175b9c0f1b6a831c399e269772661"
    rec = records(spark, [(k, "2013-05-09", None) for k in (digest, digest.upper(), "a")])
    daily = windows.assign_windows(rec)
    assert distinct.distinct_keys(daily).first()["n_distinct"] == 1
    assert distinct.approximate_distinct(daily).first()["estimate"] == 1
    assert len(rows(frequency.top_keys(daily, 5))) == 3


def test_minimum_values_merge_and_are_exact_when_few(daily):
    exact = distinct.distinct_keys(daily).first()["n_distinct"]
    few = distinct.kmv_estimate(distinct.kmv_hashes(daily, 1000), 1000)
    assert few.first()["estimate"] == exact
    k = 64
    whole = distinct.kmv_hashes(daily, k)
    merged = distinct.merge_kmv(distinct.kmv_hashes(daily, k, [*STREAM, "window_start"]), k)
    assert rows(merged, "h") == rows(whole, "h")
    estimate = distinct.kmv_estimate(whole, k).first()["estimate"]
    assert abs(estimate - exact) <= 3 * exact / (k - 2) ** 0.5


def test_accuracy_report(daily):
    report = distinct.accuracy(daily).first()
    assert report["exact"] == distinct.distinct_keys(daily).first()["n_distinct"]
    assert report["relative_error"] <= 3 * distinct.relative_error()
