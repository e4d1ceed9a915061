import pytest
from pyspark.sql import functions as F

from tests.helpers import records, rows
from tidemark.functions.times import format_label
from tidemark.operators import arrival, frequency, windows
from tidemark.operators.joins import sized_join
from tidemark.schema import STREAM_CONFIG

DAY1, DAY2 = "20130509T000000", "20130510T000000"


def counts(df, label="start"):
    return rows(windows.with_label(frequency.event_counts(df), label), "label", "n_events")


def test_midnight_opens_the_next_window(spark):
    rec = records(spark, [("a", "2013-05-09 23:59:59", None), ("a", "2013-05-10", None)])
    assert counts(windows.assign_windows(rec)) == [(DAY1, 1), (DAY2, 1)]


def test_labels_by_start_or_end(spark):
    rec = records(spark, [("a", "2013-05-09 10:00:00", None)])
    assert counts(windows.assign_windows(rec), "end") == [(DAY2, 1)]
    with pytest.raises(ValueError):
        windows.label_column("middle")


@pytest.mark.parametrize(
    "begin, end, label, days",
    [
        (DAY1, DAY1, "start", [1]),
        (DAY1, DAY2, "start", [1, 2]),
        (DAY2, DAY1, "start", []),
        (DAY2, DAY2, "end", [1]),
        (DAY2, None, "start", [2, 3]),
        (None, DAY2, "end", [1]),
    ],
)
def test_closed_label_ranges(spark, begin, end, label, days):
    rec = records(spark, [(str(d), f"2013-05-{8 + d:02} 23:59:59.999", None) for d in (1, 2, 3)])
    found = windows.select_range(rec, begin, end, label=label)
    assert [int(key) for (key,) in rows(found, "key")] == days


@pytest.mark.parametrize(
    "begin, end, as_of, keys",
    [
        # The open window (day 2) counts by the present, not by its label.
        (DAY1, DAY2, "20130510T120000", ["one"]),
        (DAY1, "20130510T120000", "20130510T120000", ["one", "two"]),
        ("20130510T110000", "20130511T000000", "20130510T120000", ["two"]),
        ("20130510T130000", "20130511T000000", "20130510T120000", []),
        (DAY1, "20130511T000000", "20130511T000000", ["later", "one", "two"]),
    ],
)
def test_the_open_window_takes_part_by_the_present(spark, begin, end, as_of, keys):
    rec = records(
        spark,
        [
            ("one", "2013-05-09 08:00:00", None),
            ("two", "2013-05-10 08:00:00", None),
            ("later", "2013-05-10 20:00:00", None),
        ],
    )
    assert rows(windows.select_range(rec, begin, end, as_of), "key") == [(k,) for k in keys]


def test_listings(spark):
    rec = records(spark, [("a", "2013-05-09", None), ("b", "2013-05-10", None)]).unionByName(
        records(spark, [("a", "2013-05-10", None)], collection="new")
    )
    daily = windows.assign_windows(rec)
    assert rows(windows.window_labels(windows.of_stream(daily, "s", "c")), "label") == [
        (DAY1,),
        (DAY2,),
    ]
    assert rows(windows.collections(daily, "20130510T120000"), "collection") == [("c",)]
    assert rows(windows.of_stream(daily, "nobody"), "key") == []


@pytest.mark.parametrize("max_rows", [100, 0])
def test_streams_have_their_own_windows(spark, max_rows):
    rec = records(spark, [("a", "2013-05-09 07:00:00", None)]).unionByName(
        records(spark, [("a", "2013-05-09 07:00:00", None)], collection="own")
    )
    config = spark.createDataFrame(
        [("s", "own", 1_800_000, 3_600_000, None, None, 5)], STREAM_CONFIG
    )
    with_settings = windows.assign_configured_windows(rec, config)
    assert rows(with_settings, "collection", format_label(F.col("window_start")), "topk_max_count",
                "sketch_width") == [
        ("c", DAY1, 1024, 1 << 20),
        ("own", "20130509T063000", 5, 1 << 20),
    ]
    # Beyond the broadcast bound the same rows come from the salted join.
    plain = sized_join(rec, config, ["service", "collection"], max_rows=max_rows)
    assert rows(plain, "collection", "topk_max_count") == [("c", None), ("own", 5)]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_the_salted_join_keeps_every_row_once(spark, how):
    large = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "x"), (2, "y")], "k bigint, v string")
    broadcast = sized_join(large, small, ["k"], how)
    salted = sized_join(large, small, ["k"], how, max_rows=1, salts=4)
    assert rows(salted, "id", "k") == rows(broadcast, "id", "k")


def test_late_events_stay_where_they_arrive(spark):
    late = [("a", "2013-05-09", None), ("b", "2013-05-10", None), ("c", "2013-05-09", None)]
    rec = records(spark, late)
    assert counts(windows.assign_windows(rec)) == [(DAY1, 2), (DAY2, 1)]
    assert counts(arrival.assign_arrival_windows(rec)) == [(DAY1, 1), (DAY2, 2)]
