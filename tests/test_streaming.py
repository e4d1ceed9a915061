import pytest
from pyspark.sql import functions as F

from tests.helpers import records, rows
from tidemark.functions.times import format_label
from tidemark.operators import frequency, labels, values, windows
from tidemark.schema import RECORD
from tidemark.session import ROCKSDB_STATE, fresh_folder
from tidemark.sources.store import WindowStore
from tidemark.streaming import labels as label_stream
from tidemark.streaming import windows as window_stream



def start():
    return format_label(F.col("window_start"))


DAYS = [
    [("a", "2013-05-09 01:00:00", {"v": "1"}), ("a", "2013-05-09 02:00:00", {"v": "2"})],
    [("b", "2013-05-10 01:00:00", None), ("a", "2013-05-10 02:00:00", {"v": "3"})],
    [("c", "2013-05-11 01:00:00", {"v": "4"})],
]


@pytest.fixture
def files(spark):
    """One parquet file per day, so that a stream can read them as separate batches."""
    path = fresh_folder(spark, "input")
    for day in DAYS:
        records(spark, day).coalesce(1).write.mode("append").parquet(path)
    return path


def source(spark, path, schema=RECORD):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, writer, checkpoint=None):
    place = checkpoint or fresh_folder(spark, "state")
    running = writer.option("checkpointLocation", place).trigger(availableNow=True).start()
    running.awaitTermination()
    return place


def test_stream_equals_batch(spark, files):
    store = WindowStore(spark, fresh_folder(spark, "store"))
    drain(spark, window_stream.seal_windows(source(spark, files), store, "log", delay="0 seconds"))
    batch = windows.assign_windows(spark.read.schema(RECORD).parquet(files))
    whole = values.key_rollup(batch)
    sealed = rows(store.catalog(), start())
    assert sealed == [("20130509T000000",), ("20130510T000000",)]
    in_store = rows(store.keys(), "window_start", "key", "n")
    assert set(in_store) < set(rows(whole, "window_start", "key", "n"))
    # The last window never passes the watermark of a finite stream.
    window_stream.flush_tail(spark.read.schema(RECORD).parquet(files), store, "tail")
    assert rows(store.keys(), "window_start", "key", "n") == rows(
        whole, "window_start", "key", "n"
    )
    attributes = {row["key"]: row["values"] for row in store.keys("20130509T000000", "20130509T000000").collect()}
    assert attributes == {"a": {"v": "1"}}


def test_a_restarted_stream_goes_on(spark, files):
    store = WindowStore(spark, fresh_folder(spark, "store"))
    checkpoint = drain(spark, window_stream.seal_windows(source(spark, files), store, "log", delay="0 seconds"))
    more = [("d", "2013-05-12 01:00:00", None), ("d", "2013-05-13 01:00:00", None)]
    records(spark, more).coalesce(1).write.mode("append").parquet(files)
    drain(spark, window_stream.seal_windows(source(spark, files), store, "log", delay="0 seconds"), checkpoint)
    days = rows(store.catalog(), start())
    assert [day for (day,) in days] == [f"201305{d:02}T000000" for d in (9, 10, 11, 12)]


def test_open_windows_are_kept_current(spark, files):
    path = fresh_folder(spark, "open")
    drain(spark, window_stream.track_open_windows(source(spark, files), path, delay="0 seconds"))
    latest = window_stream.latest_counts(spark.read.parquet(path))
    batch = windows.assign_windows(spark.read.schema(RECORD).parquet(files))
    columns = ("window_start", "key", "n")
    assert rows(latest, *columns) == rows(frequency.key_counts(batch), *columns)


def test_running_label_totals(spark):
    source_path, path = fresh_folder(spark, "hits"), fresh_folder(spark, "totals")
    schema = "collection string, label_name string, hits bigint"
    batches = [[("c1", "red", 2), ("c1", "blue", 1)], [("c1", "red", 3)], [("c2", "red", 4)]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source_path)
    drain(spark, label_stream.track_labels(source(spark, source_path, schema), path))
    changes = spark.read.parquet(path)
    assert rows(label_stream.latest_totals(changes)) == rows(
        labels.label_totals(spark.read.parquet(source_path))
    )
    # Only labels that changed are logged: one row per label and batch that touched it.
    assert changes.count() == 4


def test_the_cluster_state_store_gives_the_same_totals(spark):
    """State in RocksDB, as ``tune`` sets it outside local sessions."""
    schema = "collection string, label_name string, hits bigint"
    source_path, path = fresh_folder(spark, "hits"), fresh_folder(spark, "totals")
    spark.createDataFrame([("c", "red", 2), ("c", "red", 3)], schema).write.parquet(source_path)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB_STATE)
    try:
        drain(spark, label_stream.track_labels(source(spark, source_path, schema), path))
    finally:
        spark.conf.set(name, before)
    assert rows(label_stream.latest_totals(spark.read.parquet(path))) == [("c", "red", 5)]


def test_events_behind_the_watermark_do_not_reopen_a_window(spark, files):
    store = WindowStore(spark, fresh_folder(spark, "store"), depth=1, width=16)
    checkpoint = drain(spark, window_stream.seal_windows(source(spark, files), store, "log", delay="0 seconds"))
    sealed = rows(store.keys(), "window_start", "key", "n")
    late = [("late", "2013-05-09 03:00:00", None)]
    records(spark, late).coalesce(1).write.mode("append").parquet(files)
    drain(spark, window_stream.seal_windows(source(spark, files), store, "log", delay="0 seconds"), checkpoint)
    assert rows(store.keys(), "window_start", "key", "n") == sealed
