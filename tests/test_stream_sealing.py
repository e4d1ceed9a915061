"""One streaming query for all window settings: late events, replays, restarts and the open windows."""

from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import records, rows
from tidemark.operators import arrival
from tidemark.schema import RECORD, STREAM_CONFIG
from tidemark.session import fresh_folder
from tidemark.sources.store import WindowStore
from tidemark.streaming import arrival as arrival_stream
from tidemark.streaming.epochs import EpochTable, folder_values
from tidemark.streaming.sealing import StreamSealer

HOUR = 3_600_000
COLUMNS = ("collection", "window_start", "key", "n")


def put(spark, path, rows_, collection="c"):
    records(spark, rows_, collection=collection).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, writer, checkpoint=None):
    place = checkpoint or fresh_folder(spark, "state")
    writer.option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    return place


def sealer(spark, delay_ms=0, store=None, path=None, **options):
    store = store or WindowStore(spark, fresh_folder(spark, "store"), depth=1, width=16)
    return StreamSealer(spark, store, path or fresh_folder(spark, "open"), "log", delay_ms, **options)


def simulate(batches, delay, slide=timedelta(days=1)):
    """What each (window start, key) counts, and the late events, one batch at a time."""
    counts, late, newest, reached = Counter(), [], None, None
    zero = datetime(1970, 1, 1)

    def start(t):
        return zero + (t - zero) // slide * slide

    for batch in batches:
        for key, time, _ in batch:
            t = datetime.fromisoformat(time)
            if reached is not None and start(t) + slide <= reached:
                late.append((key, time))
                t = reached
            counts[start(t), key] += 1
        newest = max([newest or zero, *(datetime.fromisoformat(t) for _, t, _ in batch)])
        reached = newest - delay
    return counts, late


BATCHES = [
    [("a", "2013-05-09 01:00:00", {"v": "1"}), ("a", "2013-05-09 02:00:00", {"v": "2"}), ("b", "2013-05-09 23:00:00", None)],
    [("a", "2013-05-10 02:00:00", {"v": "3"}), ("b", "2013-05-09 22:00:00", {"v": "4"})],  # the second is still in time
    [("c", "2013-05-12 01:00:00", {"v": "5"})],
    [("b", "2013-05-09 05:00:00", {"v": "late"}), ("d", "2013-05-12 02:00:00", None), ("a", "2013-05-11 20:00:00", None)],
    [("a", "2013-05-10 03:00:00", {"v": "late"}), ("c", "2013-05-13 09:00:00", None)],
]


@pytest.mark.parametrize("hours", [0, 3, 30])
def test_nothing_is_lost_and_late_events_count_in_the_open_window(spark, hours):
    path = fresh_folder(spark, "input")
    for batch in BATCHES:
        put(spark, path, batch)
    found = sealer(spark, hours * HOUR)
    drain(spark, found.writer(source(spark, path)))
    found.close()
    want, late = simulate(BATCHES, timedelta(hours=hours))
    got = {(r.window_start, r.key): r.n for r in found.store.keys().select("window_start", "key", "n").collect()}
    assert got == want and sum(got.values()) == sum(map(len, BATCHES))
    assert sorted((r.key, str(r.ts)) for r in found.late_records().collect()) == sorted(late)
    assert late


def test_attributes_are_the_first_seen_over_all_batches(spark):
    path = fresh_folder(spark, "input")
    put(spark, path, [("a", "2013-05-09 05:00:00", {"v": "second"}), ("b", "2013-05-09 06:00:00", None)])
    put(spark, path, [("a", "2013-05-09 04:00:00", {"v": "first"}), ("b", "2013-05-09 07:00:00", {"v": "only"})])
    put(spark, path, [("x", "2013-05-11 00:00:00", None)])
    found = sealer(spark)
    drain(spark, found.writer(source(spark, path)))
    assert {r.key: r["values"] for r in found.store.keys().collect()} == {"a": {"v": "first"}, "b": {"v": "only"}}
    assert rows(found.open_windows(), "key", "n") == [("x", 1)]
    # What was sealed has left the table of open windows.
    assert folder_values(spark, f"{found.path}/open", "closes") == ["20130512"]


def test_every_stream_has_its_own_windows_in_one_query(spark):
    path = fresh_folder(spark, "input")
    config = spark.createDataFrame(
        [("s", f"c{i}", i * 60_000, (i + 1) * 600_000, None, None, None) for i in range(100)], STREAM_CONFIG
    )
    begin = datetime(2013, 5, 9)
    events = [(f"c{i}", f"k{j % 3}", begin + timedelta(minutes=37 * j + i)) for i in range(0, 101, 4) for j in range(30)]
    for part in range(3):
        rows_ = [(c, k, str(t)) for j, (c, k, t) in enumerate(sorted(events, key=lambda e: e[2])) if j * 3 // len(events) == part]
        frame = spark.createDataFrame(rows_, "collection string, key string, t string").select(
            F.lit("s").alias("service"), "collection", "key", F.col("t").cast("timestamp").alias("ts"),
            F.lit(0).cast("long").alias("seq"), F.lit(None).cast("map<string,string>").alias("values"),
        )
        frame.coalesce(1).write.mode("append").parquet(path)
    found = sealer(spark, config=config)
    started = found.writer(source(spark, path))
    drain(spark, started)
    assert found.store.catalog().count() > 100  # sealed before the stream was closed
    found.close()
    want = Counter()
    for c, k, t in events:
        i = int(c[1:])
        slide, offset = ((i + 1) * 600, i * 60) if i < 100 else (86400, 0)
        seconds = int((t - datetime(1970, 1, 1)).total_seconds())
        at = seconds - (seconds - offset) % slide
        want[c, datetime(1970, 1, 1) + timedelta(seconds=at), k] += 1
    assert {(r.collection, r.window_start, r.key): r.n for r in found.store.keys().collect()} == want


def test_a_replayed_batch_changes_nothing(spark):
    found = sealer(spark, HOUR)
    for epoch, batch in enumerate(BATCHES):
        found.take(records(spark, batch), epoch)
        before = (rows(found.store.keys(), *COLUMNS), rows(found.open_windows(), *COLUMNS), found.late_records().count())
        found.take(records(spark, batch), epoch)
        after = (rows(found.store.keys(), *COLUMNS), rows(found.open_windows(), *COLUMNS), found.late_records().count())
        assert before == after
    found.close()
    want, _ = simulate(BATCHES, timedelta(hours=1))
    assert {(r.window_start, r.key): r.n for r in found.store.keys().collect()} == want


def test_a_restarted_stream_goes_on(spark):
    path = fresh_folder(spark, "input")
    first = sealer(spark)
    checkpoint = None
    for k, batch in enumerate(BATCHES):
        put(spark, path, batch)
        again = sealer(spark, store=first.store, path=first.path)
        checkpoint = drain(spark, again.writer(source(spark, path)), checkpoint)
    again.close()
    want, _ = simulate(BATCHES, timedelta(0))
    assert {(r.window_start, r.key): r.n for r in first.store.keys().collect()} == want
    # Only the newest states are kept.
    assert len(folder_values(spark, f"{first.path}/progress", "epoch")) <= 2


def test_awkward_batches(spark):
    found = sealer(spark)
    none = records(spark, BATCHES[0]).limit(0)
    found.take(none, 0)
    assert found.reached() is None and found.open_windows().count() == 0 and found.late_records().count() == 0
    timeless = records(spark, BATCHES[0]).withColumn("ts", F.lit(None).cast("timestamp"))
    found.take(timeless, 1)  # no time is known yet
    odd = records(spark, BATCHES[0]).withColumn("key", F.lit(None).cast("string"))
    found.take(odd.unionByName(timeless), 2)
    found.take(none, 3)
    found.close()
    got = {(format(r.window_start, "%m%d"), r.key): r.n for r in found.store.keys().collect()}
    assert got == {("0101", "a"): 2, ("0101", "b"): 1, ("0509", None): 3, ("0509", "a"): 2, ("0509", "b"): 1}


def test_arrival_order_over_batches_equals_one_batch(spark):
    begin = datetime(2013, 5, 9)
    events = [
        (f"s{i % 3}" if i % 7 else None, f"k{i % 5}", begin + timedelta(hours=i * 2 - (60 if i % 6 == 5 else 0)), i)
        for i in range(200)
    ]
    frame = spark.createDataFrame(
        [(c, k, str(t), i) for c, k, t, i in events], "collection string, key string, t string, seq long"
    ).select(
        F.lit("s").alias("service"), "collection", "key", F.col("t").cast("timestamp").alias("ts"), "seq",
        F.lit(None).cast("map<string,string>").alias("values"),
    )
    source_path, path = fresh_folder(spark, "input"), fresh_folder(spark, "arrival")
    for part in range(5):
        mine = frame.filter((F.col("seq") >= part * 40) & (F.col("seq") < part * 40 + 40))
        mine.coalesce(1).write.mode("append").parquet(source_path)
    writer = arrival_stream.track_arrival_windows(source(spark, source_path), path, rows_per_bucket=16)
    drain(spark, writer)
    got = rows(arrival_stream.arrival_windows(spark, path), "seq", "window_start", "window_end")
    opened, want = defaultdict(lambda: datetime.min), []
    for c, _, t, i in events:
        day = t.replace(hour=0, minute=0)
        opened[c] = max(opened[c], day)
        want.append((i, opened[c], opened[c] + timedelta(days=1)))
    assert got == want
    named = frame.filter(F.col("collection").isNotNull())
    whole = rows(arrival.assign_arrival_windows(named, 16), "seq", "window_start", "window_end")
    assert [r for r in got if r[0] % 7] == whole
    assert len(folder_values(spark, f"{path}/open", "epoch")) <= 2


def test_epoch_states(spark):
    states = EpochTable(spark, fresh_folder(spark, "states"), "n int")
    assert states.before().count() == 0
    for epoch in range(4):
        states.write(spark.createDataFrame([(epoch,)], "n int"), epoch)
    assert [r.n for r in states.before().collect()] == [3] and [r.n for r in states.before(2).collect()] == [1]
    states.forget(3)
    assert folder_values(spark, states.path, "epoch", int) in ([2, 3], [3, 2])
