import pytest
from pyspark.sql import functions as F

from tests.helpers import records, rows
from tidemark.operators import distinct, frequency, values, windows

DAY1, DAY2 = "20130509T000000", "20130510T000000"


def repeated(day, **times):
    return [(key, day, None) for key, n in times.items() for _ in range(n)]


@pytest.fixture
def two_days(spark):
    return records(
        spark,
        repeated("2013-05-09", a=9, b=8, c=7, z=6) + repeated("2013-05-10", d=9, e=8, f=7, z=6),
    )


def test_import_scenario(spark):
    """Tokens on one day and a sentinel on the next, which is still open."""
    tokens = [(t, "2013-05-09", {"key": t}) for t in ("a", "b", "a")]
    rec = records(spark, tokens + [("end", "2013-05-10 10:00:00", {"end": "end"})])
    as_of = "20130510T120000"
    before = windows.select_range(rec, "20130508T000000", DAY1, as_of)
    assert rows(distinct.distinct_keys(before), "n_distinct") == [(2,)]
    assert rows(frequency.top_keys(before, 20), "rk", "key", "n") == [(1, "a", 2), (2, "b", 1)]
    since = values.values_with_counts(windows.select_range(rec, "20130508T000000", as_of=as_of))
    found = {row["key"]: (row["n"], row["values"]) for row in since.collect()}
    assert found == {
        "a": (2, {"key": "a"}),
        "b": (1, {"key": "b"}),
        "end": (1, {"end": "end"}),
    }


def test_truncated_merge_misses_what_exact_finds(two_days):
    daily = windows.assign_windows(two_days)
    assert rows(frequency.top_keys(daily, 2), "rk", "key", "n") == [(1, "z", 12), (2, "a", 9)]
    truncated = frequency.top_keys_truncated(frequency.key_counts(daily), 2)
    assert rows(truncated, "rk", "key", "n") == [(1, "a", 9), (2, "d", 9)]


def test_counts_and_records_give_the_same_top(two_days):
    daily = windows.assign_windows(two_days)
    assert rows(frequency.top_keys(frequency.key_counts(daily), 5)) == rows(
        frequency.top_keys(daily, 5)
    )


def test_limits_and_unknowns(two_days):
    daily = windows.assign_windows(two_days)
    assert rows(frequency.top_keys_of_stream(daily, 0)) == []
    assert rows(frequency.top_keys(daily, 0)) == []
    assert rows(frequency.top_keys(windows.of_stream(daily, "s", "unknown"), 5)) == []
    assert rows(frequency.top_keys(windows.in_range(daily, DAY2, DAY1), 5)) == []
    # Fewer keys than asked for are not padded.
    assert len(rows(frequency.top_keys_of_stream(daily, 100))) == 7


def test_ties_are_in_key_order(spark):
    rec = records(spark, repeated("2013-05-09", b=1, a=1, c=1))
    top = frequency.top_keys_of_stream(windows.assign_windows(rec), 2)
    assert [row["key"] for row in top.collect()] == ["a", "b"]


def test_top_lists_hold_no_more_than_their_capacity(two_days):
    counts = frequency.key_counts(windows.assign_windows(two_days))
    top = frequency.top_list(counts, 3)
    assert rows(top, "window_start", "rk").__len__() == 6
    own = counts.withColumn("topk_max_count", F.lit(2))
    assert len(rows(frequency.configured_top_list(own, 3))) == 4


def test_current_window_only(spark):
    rec = records(
        spark,
        repeated("2013-05-09 23:00:00", old=5)
        + repeated("2013-05-10 01:00:00", a=2)
        + repeated("2013-05-10 13:00:00", future=9),
    )
    top = frequency.current_top_keys(rec, 3, "20130510T120000")
    assert rows(top, "key", "n") == [("a", 2)]


def test_sketched_top_lists_merge_over_windows(two_days):
    daily = windows.assign_windows(two_days)
    merged = frequency.merged_top_keys(frequency.top_sketches(daily, 100), 2, 100)
    assert set(rows(merged, "key", "estimate")) >= {("z", 12)}
    listed = frequency.monitored_keys(daily, 7, 100)
    exact = frequency.total_counts(daily)
    assert rows(listed, "key", "estimate") == rows(exact, "key", "n")


def test_events_per_window_has_no_empty_windows(spark):
    rec = records(spark, repeated("2013-05-09", a=3) + repeated("2013-05-12", a=1))
    counts = frequency.event_counts(windows.assign_windows(rec))
    assert rows(counts, "n_events") == [(1,), (3,)]


def test_a_configured_list_may_be_longer_than_the_default(spark):
    one = "'s' service, 'c' collection, timestamp'2024-01-01' window_start, timestamp'2024-01-02' window_end"
    counts = spark.range(3000).selectExpr("cast(id as string) key", "id + 1 n", "2000 topk_max_count", *one.split(", "))
    assert frequency.configured_top_list(counts).count() == 2000
