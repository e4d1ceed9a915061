import pytest
from pyspark.sql import functions as F

from tests.helpers import records, rows
from tidemark.operators import countmin, distinct, frequency, values, windows
from tidemark.session import fresh_folder
from tidemark.sources import store as store_module
from tidemark.sources.store import WindowStore

DAY1, DAY2 = "20130509T000000", "20130510T000000"


@pytest.fixture
def store(spark):
    return WindowStore(spark, fresh_folder(spark, "store"), capacity=2, depth=2, width=64)


@pytest.fixture
def daily(spark):
    rec = records(
        spark,
        [(k, "2013-05-09", {"k": k}) for k in "aaabbc"] + [(k, "2013-05-10", None) for k in "ad"],
    )
    return windows.assign_windows(rec)


def stored(store):
    return {
        "keys": rows(store.keys(), "window_start", "key", "n"),
        "top": rows(store.top_lists(), "window_start", "rk", "key", "n"),
        "cells": rows(store.cells(), "window_start", "i", "b", "v"),
        "catalog": rows(store.catalog(), "window_start", "n_events", "n_keys"),
    }


def test_stored_windows_answer_like_the_records(store, daily):
    store.seal_records(daily, "one")
    counts = frequency.key_counts(daily)
    assert rows(store.keys(), "key", "n") == rows(counts, "key", "n")
    assert rows(store.top_lists(), "rk", "key", "n") == rows(
        frequency.top_list(counts, 2), "rk", "key", "n"
    )
    assert rows(store.cells(), "i", "b", "v") == rows(countmin.cells(counts, 2, 64), "i", "b", "v")
    merged = distinct.merged_distinct(store.distinct_sketches())
    assert merged.first()["estimate"] == 4
    assert rows(values.values_with_counts(store.keys()), "key", "n") == rows(
        values.values_with_counts(daily), "key", "n"
    )


def test_ranges_of_stored_windows(store, daily):
    store.seal_records(daily, "one")
    assert len(rows(store.keys(DAY1, DAY1), "key")) == 3
    assert len(rows(store.keys(DAY2), "key")) == 2
    assert len(rows(store.keys(DAY2, DAY2, "end"), "key")) == 3
    assert rows(store.keys(DAY2, DAY1), "key") == []


def test_sealed_windows_are_never_changed(store, daily):
    store.seal_records(daily, "one", DAY2)
    before = stored(store)
    assert len(before["catalog"]) == 1
    store.seal_records(daily.unionByName(daily), "two")
    after = stored(store)
    for name, old in before.items():
        assert set(old) <= set(after[name])
    assert rows(store.keys(DAY1, DAY1), "key", "n") == [("a", 3), ("b", 2), ("c", 1)]
    assert rows(store.keys(DAY2, DAY2), "key", "n") == [("a", 2), ("d", 2)]


def test_a_completed_seal_is_left_as_it_is(spark, store, daily):
    store.seal_records(daily, "one")
    before = stored(store)
    store.seal_records(daily, "one")
    assert stored(store) == before
    late = records(spark, [("z", "2013-05-09", None)], collection="late")
    store.seal_records(windows.assign_windows(daily.select(*late.columns).unionByName(late)), "one")
    assert stored(store) == before
    store.seal_records(windows.assign_windows(late), "two")
    assert len(rows(store.keys(), "key")) == len(before["keys"]) + 1


@pytest.mark.parametrize("lost", ["toplist", "cms", "catalog"])
def test_a_seal_lost_half_way_is_invisible_and_can_be_repeated(store, daily, monkeypatch, lost):
    write = WindowStore._write

    def failing(self, name, rows_, seal):
        if name == lost:
            raise RuntimeError("executor lost")
        write(self, name, rows_, seal)

    monkeypatch.setattr(WindowStore, "_write", failing)
    with pytest.raises(RuntimeError):
        store.seal_records(daily, "one")
    assert stored(store) == {"keys": [], "top": [], "cells": [], "catalog": []}
    monkeypatch.setattr(WindowStore, "_write", write)
    store.seal_records(daily, "one")
    assert rows(store.keys(), "key", "n") == rows(frequency.key_counts(daily), "key", "n")
    assert len(rows(store.catalog(), "seal")) == 2


def test_windows_not_yet_stored(store, daily):
    store.seal_records(daily, "one", DAY2)
    assert rows(store.unsealed(daily), "key") == [("a",), ("d",)]


def test_a_store_can_be_opened_again(spark, store, daily):
    store.seal_records(daily, "one")
    again = WindowStore(spark, store.path)
    assert rows(again.keys(), "key", "n") == rows(store.keys(), "key", "n")


def test_short_windows_share_a_day_folder(spark, store):
    rec = records(spark, [("a", f"2013-05-09 10:{m:02}:30", None) for m in range(30)])
    store.seal_records(windows.assign_windows(rec, 60_000), "one")
    files = spark.read.parquet(f"{store.path}/keys").select(F.input_file_name()).distinct()
    assert len({path.rsplit("/", 1)[0] for (path,) in files.collect()}) == 1
    found = store.keys("20130509T101000", "20130509T101200")
    assert len(rows(found, "window_start")) == 3


def test_stored_tables_are_the_ones_declared():
    assert set(store_module.TABLES) == {"keys", "toplist", "distinct", "cms", "catalog"}
