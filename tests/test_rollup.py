"""Dyadic roll-ups answer like the windows they hold, whatever was refreshed, and read few sketches."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from tidemark.operators import countmin, distinct, windows
from tidemark.session import fresh_folder
from tidemark.schema import RECORD
from tidemark.sources.rollup import RollUps
from tidemark.sources.store import WindowStore

FIRST = datetime(2024, 1, 1)
K = 16


def label(day, hour=0):
    return (FIRST + timedelta(days=day, hours=hour)).strftime("%Y%m%dT%H%M%S")


def events(spark, days, hours=(3,)):
    """Some keys per day of two streams; stream b has nothing on every third day."""
    data = [
        ("s", c, f"k{(d * 7 + h + j) % 60}", FIRST + timedelta(days=d, hours=h), d * 1000 + h * 10 + j, None)
        for d in days for h in hours for j in range(8) for c in ("a", "b") if c == "a" or d % 3
    ]
    return spark.createDataFrame(data, RECORD)


@pytest.fixture(scope="module")
def store(spark):
    """33 days, sealed in two parts, of which the roll-ups have seen the first and, for some days, half of the second."""
    store = WindowStore(spark, fresh_folder(spark, "rolled"), depth=2, width=32, kmv_size=K)
    rolled = RollUps(store)
    store.seal_records(windows.assign_windows(events(spark, range(0, 20), (3, 15)), 12 * 3600 * 1000), "one")
    rolled.refresh()
    store.seal_records(windows.assign_windows(events(spark, range(18, 33), (3,)), 12 * 3600 * 1000), "two")
    return store


def answers(source, bounds):
    if isinstance(source, RollUps):
        cms, kmv, hll = (source.sketches(kind, *bounds) for kind in ("cms", "kmv", "distinct"))
    else:
        cms, kmv, hll = source.cells(*bounds), source.minimum_values(*bounds), source.distinct_sketches(*bounds)
    return (
        rows(distinct.merged_distinct(hll), "collection", "estimate"),
        rows(countmin.merge(cms), "collection", "i", "b", "v"),
        rows(distinct.merge_kmv(kmv, K), "collection", "h"),
    )


@pytest.mark.parametrize("bounds", [(None, None), (label(3, 12), label(21)), (label(9), label(3)), (label(2), label(19), "end")])
def test_ranges_equal_the_windows(store, bounds):
    assert answers(RollUps(store), bounds) == answers(store, bounds)


def test_a_refreshed_range_reads_few_cells(store):
    rolled = RollUps(store)
    rolled.refresh()
    bounds = (label(1), label(30, 12))
    assert answers(rolled, bounds) == answers(store, bounds)
    placed = rolled._cover(label(1), label(30, 12), "start")
    of_a = placed.filter("collection = 'a'").select("level", "cell").distinct().collect()
    assert len(of_a) <= 9 and all(row.level >= 0 for row in of_a)
    text = rolled.sketches("distinct", label(1), label(30, 12))._jdf.queryExecution().executedPlan().toString()
    # One scan has sketches, of the cells: no windows are read.
    assert re.findall(r"ReadSchema: struct<([^>]*hll[^>]*)>", text) == ["service:string,collection:string,hll:binary"]
    assert re.search(r"PartitionFilters: \[[^\]]*level", text)


def test_lost_refresh_is_not_counted_on(spark):
    store = WindowStore(spark, fresh_folder(spark, "lost"), depth=1, width=8)
    rolled = RollUps(store)
    rolled.refresh()
    store.seal_records(windows.assign_windows(events(spark, range(4))), "one")
    writes = []

    def lost(name, placed, write=rolled._write):
        if name == "index" or len(writes) == 3:
            raise RuntimeError("lost")
        writes.append(name)
        write(name, placed)

    rolled._write = lost
    with pytest.raises(RuntimeError):
        rolled.refresh()
    again = RollUps(store)
    read = {"distinct": store.distinct_sketches, "cms": store.cells}
    for _ in range(2):
        for kind, column in (("distinct", "estimate"), ("cms", "v")):
            merge = distinct.merged_distinct if kind == "distinct" else countmin.merge
            assert rows(merge(again.sketches(kind)), "collection", column) == rows(merge(read[kind]()), "collection", column)
        again.refresh()
    with pytest.raises(ValueError):
        again.sketches("kmv")


def test_kmv_comparison_is_exact_when_few_and_close_when_many(spark):
    keys = spark.range(6000).select(F.lit("s").alias("service"), F.lit("c").alias("collection"), F.col("id").cast("string").alias("key"))
    left, right = keys.filter("key < 4000"), keys.filter("key >= 1000")
    for k, slack in ((10_000, 0), (512, 0.15)):
        sets = (
            distinct.kmv_hashes(left, k).withColumn("side", F.lit(True))
            .unionByName(distinct.kmv_hashes(right, k).withColumn("side", F.lit(False)))
            .unionByName(distinct.kmv_hashes(keys.limit(10), k).withColumn("side", F.lit(None).cast("boolean")))
        )
        for group in ((), ("service", "collection")):
            found = distinct.compare_kmv(sets, F.col("side"), k, group).first()
            for name, exact in (("either", 6000), ("shared", 3000), ("left_only", 1000), ("right_only", 2000)):
                assert abs(found[name] - exact) <= slack * 6000
            assert abs(found["similarity"] - 0.5) <= slack
    none = distinct.compare_kmv(sets.limit(0), F.col("side"), 8).first()
    assert none["either"] == none["shared"] == 0 and none["similarity"] is None
