"""What the physical plans must look like: pushdown, pruning, no per-row Python, no cross joins."""

import re

import pytest

from tidemark.plans.queries import all_queries
from tidemark.operators import frequency, values, windows
from tidemark.session import fresh_folder
from tidemark.sources import tables
from tidemark.sources.store import WindowStore

SF_DIR = "/root/testdata/sf0.001"
WRITING = {name for name in all_queries() if name.startswith(("stored_", "stream_", "seal_"))}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(all_queries()) - WRITING))
def test_no_python_no_cross_join(spark, name):
    text = plan(all_queries()[name](spark, SF_DIR))
    for unwanted in ("Python", "InArrow", "InPandas", "CartesianProduct", "NestedLoop", "SinglePartition"):
        assert unwanted not in text


def test_time_ranges_reach_the_scan(spark):
    rec = tables.event_records(spark, SF_DIR)
    found = windows.select_range(rec, "20240110T000000", "20240112T000000", "20240111T120000")
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan(found)).group(1)
    assert "GreaterThanOrEqual(ts,2024-01-10T00:00)" in pushed
    assert "LessThanOrEqual(ts,2024-01-11T12:00)" in pushed


def test_counting_reads_no_attributes(spark):
    text = plan(frequency.key_counts(windows.assign_windows(tables.event_records(spark, SF_DIR))))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {field.split(":")[0] for field in schema.split(",")} == {"ts", "user_id", "event_type"}


def test_top_lists_are_cut_before_the_shuffle(spark):
    daily = windows.assign_windows(tables.event_records(spark, SF_DIR))
    text = plan(frequency.top_list(frequency.key_counts(daily)))
    assert re.search(r"WindowGroupLimit .*1024, Partial", text)


def test_top_of_one_stream_is_not_sorted_as_a_whole(spark):
    daily = windows.assign_windows(tables.event_records(spark, SF_DIR))
    assert "TakeOrderedAndProject" in plan(frequency.top_keys_of_stream(daily, 10))


def test_values_with_counts_shuffles_once(spark):
    daily = windows.assign_windows(tables.event_records(spark, SF_DIR))
    assert plan(values.values_with_counts(daily)).count("Exchange hashpartitioning") == 1


def test_sketching_hashes_keys_not_records(spark):
    text = plan(all_queries()["cms_merge"](spark, SF_DIR))
    scan = text[text.rindex("HashAggregate") :]
    assert "md5" not in scan


def test_stored_ranges_read_only_their_days(spark):
    store = WindowStore(spark, fresh_folder(spark, "pruned"), depth=1, width=16)
    store.seal_records(windows.assign_windows(tables.event_records(spark, SF_DIR)), "one")
    text = plan(store.keys("20240110T000000", "20240111T000000").select("key", "n"))
    keys = next(line for line in text.splitlines() if "/keys]" in line)
    assert re.search(r"PartitionFilters: \[[^\]]*day\S* >= 20240110", keys)
    assert re.search(r"PartitionFilters: \[[^\]]*day\S* <= 20240111", keys)
    assert "values" not in re.search(r"ReadSchema: struct<([^>]*)>", keys).group(1)
    by_end = plan(store.keys("20240110T000000", "20240111T000000", "end").select("key"))
    assert re.search(r"PartitionFilters: \[[^\]]*day\S* >= 20240109", by_end)
