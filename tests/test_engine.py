import pytest
from pyspark.sql import functions as F

from tests.helpers import records, rows
from tidemark import LogAnalytics
from tidemark.schema import STREAM_CONFIG
from tidemark.session import fresh_folder

DAY1, DAY2, DAY3 = "20130509T000000", "20130510T000000", "20130511T000000"
NOON = "20130510T120000"


@pytest.fixture(scope="module")
def service(spark):
    """Day 1 sealed, day 2 open at noon, one more collection that only has the open day."""
    service = LogAnalytics(spark, fresh_folder(spark, "service"), depth=2, width=1024)
    first = [(k, "2013-05-09 10:00:00", {"v": k}) for k in "aaab"] + [("c", "2013-05-09", None)]
    service.insert(records(spark, first))
    service.seal(DAY2)
    second = [("a", "2013-05-10 09:00:00", {"v": "new"}), ("d", "2013-05-10 11:00:00", {"v": "d"}),
              ("late", "2013-05-10 20:00:00", {"v": "x"})]
    service.insert(records(spark, second))
    service.insert(records(spark, [("o", "2013-05-10 01:00:00", {"v": "o"})], collection="other"))
    # An event for a sealed window changes nothing.
    service.insert(records(spark, [("a", "2013-05-09 12:00:00", {"v": "z"})]))
    return service


def values_of(df, *columns):
    return {row["key"]: (row["values"], *[row[c] for c in columns]) for row in df.collect()}


def test_top_keys(service):
    ask = lambda *a, **o: [tuple(r) for r in service.top_keys("s", "c", *a, as_of=NOON, **o).collect()]
    assert ask(DAY1, DAY1, 2) == [("a", 3), ("b", 1)]
    assert ask(DAY1, DAY3, 9) == [("a", 4), ("b", 1), ("c", 1), ("d", 1)]
    assert ask(DAY1, DAY3, 9, merge="truncated") == ask(DAY1, DAY3, 9)
    assert ask(DAY1, DAY3, 0) == []
    with pytest.raises(ValueError):
        ask(DAY1, DAY3, 2, merge="other")
    assert [tuple(r) for r in service.current_top_keys("s", "c", 1, NOON).collect()] == [("a", 1)]
    assert service.top_keys("s", "nobody", DAY1, DAY3, 5, NOON).collect() == []


@pytest.mark.parametrize("exact", [True, False])
def test_distinct_keys(service, exact):
    ask = lambda *a: service.distinct("s", *a, NOON, exact).collect()
    assert [tuple(r) for r in ask("c", DAY1, DAY1)] == [(3,)]
    assert [tuple(r) for r in ask("c", DAY1, DAY3)] == [(4,)]
    assert [tuple(r) for r in ask("nobody", DAY1, DAY3)] == [(0,)]
    assert service.current_distinct("s", "c", NOON, exact).first()["n_distinct"] == 2
    assert service.current_distinct("s", "nobody", NOON, exact).first()["n_distinct"] == 0
    if not exact:
        service.roll_up()
        assert [tuple(r) for r in ask("c", DAY1, DAY3)] == [(4,)]


def test_keys_of_two_streams(spark):
    service = LogAnalytics(spark, fresh_folder(spark, "compared"), kmv_size=8)
    service.insert(records(spark, [(k, "2013-05-09", None) for k in "abcd"], collection="c"))
    service.insert(records(spark, [(k, "2013-05-10", None) for k in "cde"], collection="d"))
    service.close("all")
    for _ in range(2):
        found = service.compare_keys("s", "c", "s", "d", DAY1, DAY3).first()
        assert found.asDict() == {"either": 5.0, "shared": 2.0, "left_only": 2.0, "right_only": 1.0, "similarity": 0.4}
        service.roll_up()


def test_attributes(service):
    assert values_of(service.value("s", "c", "a", NOON)) == {"a": ({"v": "new"},)}
    assert rows(service.value_attribute("s", "c", "a", "v", NOON)) == [("a", "new")]
    assert values_of(service.value("s", "c", "b", NOON)) == {}
    assert list(values_of(service.current_values("s", "c", 1, NOON))) == ["a"]
    assert values_of(service.window_values("s", "c", DAY1, 1)) == {"a": ({"v": "a"},)}
    assert values_of(service.window_values("s", "c", DAY1)) == {
        "a": ({"v": "a", "key": "a"},),
        "b": ({"v": "b", "key": "b"},),
    }


def test_values_with_counts(service):
    assert values_of(service.values_with_counts("s", "c", DAY1, NOON), "n") == {
        "a": ({"v": "new", "key": "a"}, 4),
        "b": ({"v": "b", "key": "b"}, 1),
        "d": ({"v": "d", "key": "d"}, 1),
    }
    everything = service.all_collections("s", DAY1, NOON)
    assert rows(everything, "collection", "key", "n") == [
        ("c", "a", 4),
        ("c", "b", 1),
        ("c", "d", 1),
        ("other", "o", 1),
    ]


def test_listings(service):
    assert [tuple(r) for r in service.windows("s", "c").collect()] == [(DAY1,)]
    assert rows(service.collections("s")) == [("c",)]


def test_labels(spark, service):
    hits = spark.createDataFrame(
        [("c1", "red", 2), ("c2", "red", 1)], "collection string, label_name string, hits bigint"
    )
    service.add_labels(hits)
    service.add_labels(hits)
    assert rows(service.labels("c1")) == [("red", 4)]
    service.drop_labels("c1")
    assert rows(service.labels("c1")) == []
    assert rows(service.labels("c2")) == [("red", 2)]


def test_closing_seals_the_open_windows(spark):
    service = LogAnalytics(spark, fresh_folder(spark, "closing"), label="end")
    service.insert(records(spark, [("a", "2013-05-09 10:00:00", None)]))
    service.seal("20130509T120000")
    assert service.windows("s", "c").collect() == []
    service.close()
    assert [tuple(r) for r in service.windows("s", "c").collect()] == [(DAY2,)]
    assert [tuple(r) for r in service.top_keys("s", "c", DAY2, DAY2, 5, DAY3).collect()] == [("a", 1)]
    assert service.top_keys("s", "c", DAY1, DAY1, 5, DAY3).collect() == []


def test_the_present_defaults_to_the_clock(spark):
    service = LogAnalytics(spark, fresh_folder(spark, "now"), slide_ms=3_600_000)
    assert service.current_top_keys("s", "c", 5).collect() == []
    service.seal()


def test_sealed_history_is_not_read_again(spark):
    service = LogAnalytics(spark, fresh_folder(spark, "history"), depth=1, width=16)
    days = [(str(d), f"2013-05-{d:02} 10:00:00", None) for d in range(1, 10)]
    service.insert(records(spark, days))
    service.seal("20130508T000000")
    # Day 7 ends where the seal stopped; the slide before it is still looked at, nothing earlier.
    assert rows(service._pending(), "key") == [("7",), ("8",), ("9",)]
    # A late insert is looked at whatever its day: its window was never stored for that stream.
    service.insert(records(spark, [("x", "2013-05-02", None)], collection="late"))
    assert ("x",) in rows(service._pending(), "key")
    service.seal("20130508T000000")
    service.seal("20130509T000000")
    assert rows(service.collections("s")) == [("c",), ("late",)]
    assert [r[0] for r in service.windows("s", "c").collect()] == [
        f"2013050{d}T000000" for d in range(1, 9)
    ]
    assert rows(service.top_keys("s", "c", "20130501T000000", "20130531T000000", 20, "20130510T000000"),
                "key") == [(str(d),) for d in range(1, 10)]


def test_a_repeated_insert_replaces_itself(spark):
    service = LogAnalytics(spark, fresh_folder(spark, "again"), depth=1, width=16)
    for _ in range(2):
        service.insert(records(spark, [("a", "2013-05-09", None)]), batch=1)
    assert service.records().count() == 1


def test_streams_with_their_own_settings(spark):
    config = spark.createDataFrame(
        [("s", "hourly", 0, 3_600_000, 64, 2, 1)], STREAM_CONFIG
    )
    service = LogAnalytics(spark, fresh_folder(spark, "config"), config=config, depth=1, width=16)
    hours = [(k, f"2013-05-09 {h:02}:30:00", {"v": k}) for h in (1, 2) for k in "aaab"]
    service.insert(records(spark, hours, collection="hourly"))
    service.insert(records(spark, hours))
    service.seal("20130509T020000")
    ask = lambda c, b, e, **o: [
        tuple(r) for r in service.top_keys("s", c, b, e, 5, "20130509T024000", **o).collect()
    ]
    assert [r[0] for r in service.windows("s", "hourly").collect()] == ["20130509T010000"]
    assert service.windows("s", "c").collect() == []
    assert ask("hourly", "20130509T010000", "20130509T010000") == [("a", 3), ("b", 1)]
    # The stored top list holds one entry, the sketch cells stop at 2.
    assert ask("hourly", "20130509T010000", "20130509T010000", merge="truncated") == [("a", 3)]
    assert service.store.cells().agg({"v": "max"}).first()[0] == 2
    # The whole day is one open window for the other stream, and the hour for this one.
    assert ask("c", DAY1, DAY2) == [("a", 6), ("b", 2)]
    current = service.current_top_keys("s", "hourly", 5, "20130509T024000").collect()
    assert [tuple(r) for r in current] == [("a", 3), ("b", 1)]
    everything = service.all_collections("s", DAY1, "20130509T024000")
    assert rows(everything, "collection", "key", "n") == [
        ("c", "a", 6),
        ("c", "b", 2),
        ("hourly", "a", 6),
        ("hourly", "b", 2),
    ]


def _top(service, stream="c"):
    return {r["key"]: r["n"] for r in service.top_keys("s", stream, DAY1, DAY3, 9, as_of=DAY3).collect()}


def test_a_callers_batch_number_hides_nothing(spark):
    service = LogAnalytics(spark, fresh_folder(spark, "service"), depth=2, width=1024)
    service.insert(records(spark, [("a", "2013-05-09 10:00:00", None)]))
    service.seal(DAY3)
    service.insert(records(spark, [("b", "2013-05-09 10:00:00", None)], collection="new"), batch=7)
    assert _top(service, "new") == {"b": 1}


def test_a_reused_seal_name_loses_nothing(spark):
    service = LogAnalytics(spark, fresh_folder(spark, "service"), depth=2, width=1024)
    service.insert(records(spark, [("a", "2013-05-09 10:00:00", None)]))
    service.seal(DAY2, name="daily")
    service.insert(records(spark, [("b", "2013-05-10 10:00:00", None)]))
    service.seal(DAY3, name="daily")
    assert _top(service) == {"a": 1, "b": 1}


def test_progress_goes_on_after_close(spark):
    service = LogAnalytics(spark, fresh_folder(spark, "service"), depth=2, width=1024)
    service.insert(records(spark, [("a", "2013-05-09 10:00:00", None)]))
    service.close()
    service.insert(records(spark, [("b", "2013-05-10 10:00:00", None)]))
    service.seal("20130520T000000")
    assert service._pending().count() == 0
    assert _top(service) == {"a": 1, "b": 1}


def test_late_records_count_in_the_open_window(spark):
    service = LogAnalytics(spark, fresh_folder(spark, "service"), depth=2, width=1024, late="open")
    early = records(spark, [("a", "2013-05-08 10:00:00", None)])
    service.insert(early)
    service.seal(DAY3)
    late = records(spark, [("a", "2013-05-08 11:00:00", None), ("b", "2013-05-08 12:00:00", None)])
    service.insert(late, batch=3)
    begin, end = DAY3, "20130512T000000"
    ask = lambda: {r["key"]: r["n"] for r in service.top_keys("s", "c", begin, end, 9, as_of=end).collect()}
    assert ask() == {"a": 1, "b": 1}  # the window the seal left open
    assert service.late_records().count() == 2
    service.seal(end)
    assert ask() == {"a": 1, "b": 1}
    service.insert(late, batch=3)  # a repeat of what is counted
    service.seal(end)
    assert ask() == {"a": 1, "b": 1}


def test_records_without_names_or_time_are_kept_once(spark):
    service = LogAnalytics(spark, fresh_folder(spark, "service"), depth=2, width=1024)
    nameless = records(spark, [("x", "2013-05-09 10:00:00", None)]).withColumns(
        {name: F.lit(None).cast("string") for name in ("service", "collection", "key")}
    )
    service.insert(nameless)
    service.seal(DAY3)
    service.seal(DAY3)
    assert service.store.catalog().count() == 1
    assert rows(service.top_keys("", "", DAY1, DAY3, 9, DAY3), "key", "n") == [("", 1)]
    untimed = records(spark, [("now", "2013-05-09", None)])
    service.insert(untimed.withColumn("ts", F.lit(None).cast("timestamp")))
    assert rows(service.current_top_keys("s", "c", 9)) == [("now", 1)]


def test_frequent_keys_keep_their_bounds(spark):
    service = LogAnalytics(spark, fresh_folder(spark, "frequent"), capacity=2, depth=1, width=16)
    day = [("a", 5), ("b", 4), ("c", 3), ("d", 1)]
    events = [(k, f"2013-05-{d:02} 0{i}:00:00", None) for d in (9, 10, 11) for k, n in day for i in range(n)]
    service.insert(records(spark, events))
    service.seal("20130511T000000")
    found = service.frequent_keys("s", "c", "20130509T000000", "20130512T000000", 2, "20130511T120000").collect()
    exact = {k: 3 * n for k, n in day}
    assert [r.key for r in sorted(found, key=lambda r: -r["count"])] == ["a", "b"]
    assert all(r["count"] - r["error"] <= exact[r.key] <= r["count"] for r in found)
    assert all(exact[k] <= found[0].floor for k in ("c", "d"))
