"""Space-Saving summaries keep their bounds, whatever is cut and however they are merged."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import spacesaving
from tidemark.operators.ranking import top_per_group

GROUP = ["g"]


def table(spark, streams):
    """``streams[g][part]`` is a list of keys; counts per group, part and key."""
    rows = [(g, p, k, n) for g, parts in streams.items() for p, keys in enumerate(parts) for k, n in Counter(keys).items()]
    return spark.createDataFrame(rows, "g string, p int, key string, n long")


def skewed(rng, size, keys):
    return [f"k{int(keys * rng.random() ** 3)}" for _ in range(size)]


@pytest.fixture(scope="module")
def streams():
    rng = random.Random(9)
    found = {
        "many": [skewed(rng, 400, 300) for _ in range(6)],
        "even": [[f"k{i}" for i in range(60)] for _ in range(3)],  # nothing stands out
        "few": [["a", "b", "a"], ["c"]],
        "one part": [skewed(rng, 500, 200)],
    }
    found[None] = [skewed(rng, 100, 90) for _ in range(4)]
    return found


def check(rows, streams, capacity):
    listed = defaultdict(dict)
    for r in rows:
        listed[r.g][r.key] = r
    for g, parts in streams.items():
        exact = Counter(k for part in parts for k in part)
        found = listed[g]
        assert len(found) == min(capacity, len(exact))
        (floor,) = {r.floor for r in found.values()}
        assert floor <= sum(exact.values()) / (capacity + 1)
        for key, r in found.items():
            assert r["count"] - r["error"] <= exact[key] <= r["count"]
        assert all(n <= floor for key, n in exact.items() if key not in found)
        order = sorted(found.values(), key=lambda r: (-r["count"], r.key))
        assert [r.rk for r in order] == list(range(1, len(found) + 1))
    assert set(listed) == set(streams)


@pytest.mark.parametrize("capacity", [1, 5, 20, 1000])
def test_bounds_hold_after_building_and_merging(spark, streams, capacity):
    counts = table(spark, streams)
    parts = spacesaving.summaries(counts, capacity, ["g", "p"])
    merged = spacesaving.merge(parts, capacity, ["p"], GROUP).collect()
    check(merged, streams, capacity)
    # Merged in two steps: pairs of parts first.
    pairs = parts.withColumn("half", F.col("p") % 2)
    halves = spacesaving.merge(pairs, capacity, ["p"], ["g", "half"])
    check(spacesaving.merge(halves, capacity, ["half"], GROUP).collect(), streams, capacity)


def test_a_whole_list_is_exact(spark, streams):
    merged = spacesaving.merge(spacesaving.summaries(table(spark, streams), 1000, ["g", "p"]), 1000, ["p"], GROUP)
    assert merged.filter("error > 0 or floor > 0").count() == 0


def test_capacity_may_differ_between_groups(spark, streams):
    counts = table(spark, streams).withColumn("limit", F.when(F.col("g") == "many", 3).otherwise(7))
    parts = spacesaving.summaries(counts, F.col("limit"), ["g", "p"], largest=7)
    sizes = {r.g: r.n for r in parts.filter("p = 0").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"many": 3, "even": 7, "few": 2, "one part": 7, None: 7}
    with pytest.raises(ValueError):
        spacesaving.summaries(counts, F.col("limit"), ["g", "p"])


def test_top_lists_are_summaries(spark, streams):
    counts = table(spark, streams)
    lists = top_per_group(counts, ["g", "p"], [F.col("n").desc(), F.col("key").asc()], 20)
    merged = spacesaving.merge(spacesaving.from_top_lists(lists, 20, ["g", "p"]), 20, ["p"], GROUP).collect()
    # A list bounds the rest by its own last count: as good as one that holds a key less.
    for g, parts in streams.items():
        exact = Counter(k for part in parts for k in part)
        found = {r.key: r for r in merged if r.g == g}
        (floor,) = {r.floor for r in found.values()}
        assert floor <= sum(exact.values()) / 20
        assert all(r["count"] - r["error"] <= exact[k] <= r["count"] for k, r in found.items())
        assert all(n <= floor for k, n in exact.items() if k not in found)


def test_no_rows(spark):
    none = spark.createDataFrame([], "g string, p int, key string, n long")
    assert spacesaving.merge(spacesaving.summaries(none, 5, ["g", "p"]), 5, ["p"], GROUP).count() == 0


def test_groups_are_cut_before_the_shuffle(spark, streams):
    parts = spacesaving.summaries(table(spark, streams), 50, ["g", "p"])
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan and plan.count("Exchange hashpartitioning") == 1
