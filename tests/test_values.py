from pyspark.sql import functions as F

from tests.helpers import records, rows
from tidemark.operators import frequency, values, windows

DAY1, DAY2 = "20130509T000000", "20130510T000000"

NEWEST = [
    ("x", "2013-05-09 01:00:00", {"v": "1"}),
    ("x", "2013-05-09 02:00:00", {"v": "2"}),
    ("x", "2013-05-10 01:00:00", {"v": "3"}),
    ("x", "2013-05-10 02:00:00", {"v": "4"}),
]


def found(df, *columns):
    return sorted(
        ((row["key"], row["values"], *[row[c] for c in columns]) for row in df.collect()), key=repr
    )


def test_newest_window_wins_and_first_in_it(spark):
    daily = windows.assign_windows(records(spark, NEWEST))
    assert found(values.values_with_counts(daily), "n") == [("x", {"v": "3"}, 4)]
    first_day = windows.in_range(daily, DAY1, DAY1)
    assert found(values.values_with_counts(first_day), "n") == [("x", {"v": "1"}, 2)]


def test_one_pass_equals_the_composition_of_rollup_newest_and_join(spark):
    rec = records(
        spark,
        NEWEST
        + [
            ("plain", "2013-05-09", None),
            ("mixed", "2013-05-09", {"v": "old"}),
            ("mixed", "2013-05-10", None),
            ("mixed", "2013-05-10 05:00:00", {"v": "new"}),
        ],
    )
    daily = windows.assign_windows(rec)
    one_pass = values.values_with_counts(daily)
    rolled = values.key_rollup(daily)
    assert found(values.values_with_counts(rolled), "n") == found(one_pass, "n")
    joined = values.attach_counts(
        values.newest(values.first_seen(daily)), frequency.total_counts(daily)
    )
    assert found(joined, "n") == found(one_pass, "n")
    # A key without any attributes is not listed; events without attributes still count.
    assert found(one_pass, "n") == [("mixed", {"v": "new"}, 3), ("x", {"v": "3"}, 4)]


def test_a_key_without_count_gets_zero(spark):
    daily = windows.assign_windows(records(spark, NEWEST))
    none = frequency.total_counts(daily.filter(F.lit(False)))
    assert found(values.attach_counts(values.newest(values.first_seen(daily)), none), "n") == [
        ("x", {"v": "3"}, 0)
    ]


def test_attributes_follow_arrival_when_times_are_equal(spark):
    rec = records(spark, [("x", "2013-05-09", {"v": "1"}), ("x", "2013-05-09", {"v": "2"})])
    assert found(values.first_seen(windows.assign_windows(rec))) == [("x", {"v": "1"})]


def test_key_order_and_limit(spark):
    rec = records(spark, [(k, "2013-05-09", {"k": k}) for k in ("c", "a", "b", "B")])
    seen = values.first_seen(windows.assign_windows(rec))
    assert [row["key"] for row in values.first_values(seen, 3).collect()] == ["B", "a", "b"]
    assert rows(values.first_values(seen, 0), "key") == []


def test_unknown_keys_have_no_attributes(spark):
    rec = records(spark, [("a", "2013-05-09", {"k": "1"})])
    seen = values.first_seen(windows.assign_windows(rec))
    assert found(values.values_of_key(seen, "a")) == [("a", {"k": "1"})]
    assert found(values.values_of_key(seen, "nobody")) == []
