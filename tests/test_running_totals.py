"""Label totals over many micro-batches: folded, replayed and restarted, they stay the sum of all hits."""

import random
from collections import Counter

import pytest

from tests.helpers import rows
from tidemark.session import fresh_folder
from tidemark.streaming.epochs import folder_values
from tidemark.streaming.totals import RunningTotals

SCHEMA = "collection string, label_name string, hits bigint"


def batches(count):
    rng = random.Random(3)
    return [
        [(rng.choice(["a", "b", None]), rng.choice(["x", "y", "z", None]), rng.randrange(5)) for _ in range(rng.randrange(4))]
        for _ in range(count)
    ]


def summed(taken):
    totals = Counter()
    seen = set()
    for batch in taken:
        for collection, label, hits in batch:
            totals[collection, label] += hits
            seen.add((collection, label))
    return {k: totals[k] for k in seen}


@pytest.mark.parametrize("fold_every", [1, 3, 100])
def test_totals_are_those_of_all_batches(spark, fold_every):
    path = fresh_folder(spark, "totals")
    found = RunningTotals(spark, path, fold_every)
    assert found.totals().count() == 0
    taken = batches(8)
    for epoch, batch in enumerate(taken):
        frame = spark.createDataFrame(batch, SCHEMA)
        found.take(frame, epoch)
        if epoch % 3 == 2:  # a lost driver repeats the micro-batch
            RunningTotals(spark, path, fold_every).take(frame, epoch)
        if epoch in (1, 4, 7):
            got = {(r.collection, r.label_name): r.hit_docs_num for r in found.totals().collect()}
            assert got == summed(taken[: epoch + 1])
    # Reading takes in at most the changes since the snapshot before the newest one.
    assert len(folder_values(spark, f"{path}/changes", "epoch")) <= 2 * fold_every
    assert len(folder_values(spark, f"{path}/snapshots", "epoch")) <= 2


def test_a_stream_goes_on_after_a_restart(spark):
    source, path, state = (fresh_folder(spark, name) for name in ("hits", "totals", "state"))
    taken = [b for b in batches(9) if b]
    for part in (taken[:4], taken[4:]):
        for batch in part:
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        hits = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        writer = RunningTotals(spark, path, 2).writer(hits).option("checkpointLocation", state)
        writer.trigger(availableNow=True).start().awaitTermination()
    got = RunningTotals(spark, path, 2).totals()
    assert {(r.collection, r.label_name): r.hit_docs_num for r in got.collect()} == summed(taken)
    assert len(rows(got.select("label_name").filter("label_name is not null"))) > 0
