import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from tidemark.operators import arrival, ranking
from tidemark.operators.ranking import page, running_max, split_points, top_per_group, with_bucket


@pytest.fixture(scope="module")
def clustered_ids():
    """A third of all ids sit in a narrow cluster, the rest is spread wide."""
    rng = random.Random(7)
    return sorted(set(range(1000, 2000)) | {rng.randrange(-(10**9), 10**12) for _ in range(2000)})


@pytest.mark.parametrize("offset, limit", [(0, 0), (0, 5), (990, 40), (1500, 1000), (2990, 50), (5000, 10)])
@pytest.mark.parametrize("per_bucket", [150, 10**6])
def test_pages_are_the_sorted_slice(spark, clustered_ids, offset, limit, per_bucket):
    df = spark.createDataFrame([(i,) for i in clustered_ids], "id bigint").repartition(4)
    found = rows(page(df, "id", offset, limit, per_bucket))
    assert found == [(i,) for i in clustered_ids[offset : offset + limit]]


def test_pages_placed_by_unfiltered_rows(spark, clustered_ids):
    df = spark.createDataFrame([(i,) for i in clustered_ids], "id bigint")
    kept = [i for i in clustered_ids if i % 2]
    found = page(df.filter("id % 2 != 0"), "id", 300, 200, 100, shape=df)
    assert rows(found, "id") == [(i,) for i in kept[300:500]]


def test_pages_of_ids_beyond_double_precision(spark):
    ids = [2**60 + i for i in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    assert rows(page(df, "id", 100, 250, 20), "id") == [(i,) for i in ids[100:350]]


def test_clustered_ids_fill_buckets_evenly(spark, clustered_ids):
    df = spark.createDataFrame([(i,) for i in clustered_ids], "id bigint")
    points = split_points(df, "id", 300)
    sizes = with_bucket(df, "id", points).groupBy("__bucket").count().collect()
    assert len(sizes) >= 8
    assert max(row["count"] for row in sizes) < 600


@pytest.mark.parametrize("per_bucket", [50, 10**6])
def test_running_max_equals_a_loop(spark, per_bucket):
    rng = random.Random(3)
    # Two thirds of all rows belong to one group.
    data = [(rng.choice(["hot", "hot", "cold"]), seq, rng.randrange(100)) for seq in range(900)]
    df = spark.createDataFrame(data, "g string, seq bigint, v int").repartition(4)
    found = {row["seq"]: row["m"] for row in running_max(df, ["g"], "seq", "v", "m", per_bucket).collect()}
    top: dict[str, int] = {}
    for group, seq, value in data:
        top[group] = max(top.get(group, value), value)
        assert found[seq] == top[group]
    assert len(found) == len(data)


def test_many_buckets_are_neither_broadcast_nor_repeated(spark, monkeypatch):
    # Half of the rows share one place, which is run in parts.
    for module in ("joins", "ranking"):
        monkeypatch.setattr(f"tidemark.operators.{module}.is_small", lambda *args: False, raising=False)
    rng = random.Random(13)
    data = [(rng.choice("ab"), rng.choice([40, rng.randrange(80)]), rng.randrange(1000)) for _ in range(600)]
    df = spark.createDataFrame(data, "g string, at bigint, v int").repartition(4)
    largest = running_max(df, ["g"], "at", "v", "m", 20)
    text = largest._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in text
    # Both sides of the join, and nothing again for the windows.
    assert text.count("Exchange hashpartitioning") == 2
    found = largest.collect()
    assert len(found) == len(data)
    for row in found:
        assert row["m"] == max(v for g, at, v in data if g == row["g"] and at <= row["at"])


def test_arrival_windows_do_not_depend_on_the_buckets(spark):
    from tests.helpers import records

    rng = random.Random(5)
    data = [(str(i), f"2013-05-{1 + max(0, i // 40 - rng.randrange(2)):02}", None) for i in range(600)]
    rec = records(spark, data)
    whole = rows(arrival.assign_arrival_windows(rec), "seq", "window_start")
    assert rows(arrival.assign_arrival_windows(rec, 30), "seq", "window_start") == whole


def test_top_rows_beyond_the_group_limit_threshold(spark, monkeypatch):
    data = [("hot" if i % 3 else "cold", f"k{i:05}", i % 50) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, key string, n int")
    order = [F.col("n").desc(), F.col("key").asc()]
    one_stage = rows(top_per_group(df, ["g"], order, 700))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        assert rows(top_per_group(df, ["g"], order, 700)) == one_stage
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "4096")
    for group in ("hot", "cold"):
        best = sorted((-n, key) for g, key, n in data if g == group)[:700]
        assert [(key, -n) for n, key in best] == [
            (key, n) for rk, key, n in sorted((r[3], r[1], r[2]) for r in one_stage if r[0] == group)
        ]


def test_a_bucket_splits_until_it_is_small(spark):
    # Two values per cut: the first round leaves halves, which split again and again.
    df = spark.range(2000)
    points = split_points(df, "id", 100, fanout=2)
    sizes = [row["count"] for row in with_bucket(df, "id", points).groupBy("__bucket").count().collect()]
    assert len(points) >= 9 and max(sizes) <= 200 and sum(sizes) == 2000


def test_more_buckets_than_one_round_makes(spark):
    df = spark.range(3000).selectExpr("id * id * id as id")
    points = split_points(df, "id", 20, fanout=10)
    sizes = [row["count"] for row in with_bucket(df, "id", points).groupBy("__bucket").count().collect()]
    assert len(points) > 60 and max(sizes) <= 40 and sum(sizes) == 3000


@pytest.mark.parametrize("fanout", [2, 1000])
def test_a_repeated_value_gets_a_bucket_to_itself(spark, fanout):
    data = [i // 4 for i in range(400)] + [37] * 900 + [-5] * 300 + [10**6] * 250
    df = spark.createDataFrame([(v,) for v in data], "v bigint").repartition(4)
    points = split_points(df, "v", 50, fanout)
    held = with_bucket(df, "v", points).groupBy("__bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    for row in held.collect():
        if row["n"] > 100:
            assert row["low"] == row["high"]
            assert ranking.is_single(df, "v", points, int(row["__bucket"]))


def test_split_points_of_few_rows_and_of_one_value(spark):
    assert split_points(spark.range(0), "id", 10) == []
    assert split_points(spark.range(10), "id", 10) == []
    one = spark.range(500).selectExpr("7L as id")
    points = split_points(one, "id", 10)
    assert ranking.is_single(one, "id", points, points.index(7.0) + 1)
    far = spark.range(500).selectExpr("id + (1L << 60) as id")
    points = split_points(far, "id", 10)
    assert not any(ranking.is_single(far, "id", points, b) for b in range(len(points) + 1))


@pytest.mark.parametrize("per_bucket", [20, 10**6])
def test_running_max_with_repeated_places(spark, per_bucket):
    rng = random.Random(11)
    data = [(rng.choice("ab"), rng.choice([40, 40, rng.randrange(80)]), rng.randrange(1000)) for _ in range(600)]
    df = spark.createDataFrame(data, "g string, at bigint, v int").repartition(4)
    found = running_max(df, ["g"], "at", "v", "m", per_bucket).collect()
    assert len(found) == len(data)
    for row in found:
        assert row["m"] == max(v for g, at, v in data if g == row["g"] and at <= row["at"])
