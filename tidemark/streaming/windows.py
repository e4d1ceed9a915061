"""Structured Streaming: seal windows of one length as the watermark passes, keep the open ones readable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.functions.times import Moment, moment
from tidemark.operators.windows import assign_windows
from tidemark.schema import DAY_MS, STREAM, STREAM_WINDOW
from tidemark.session import written
from tidemark.sources.store import WindowStore


def windowed_keys(
    stream: DataFrame, slide_ms: int = DAY_MS, offset_ms: int = 0, *, delay: str
) -> DataFrame:
    """Per window and key: count and first-seen attributes, kept as streaming state.

    Events more than ``delay`` behind the newest one are dropped by the watermark; :mod:`tidemark.streaming.sealing`
    keeps them, and takes streams with settings of their own. Each micro-batch
    is pre-aggregated before it reaches the state, so a hot key costs one row per task.
    """
    length = f"{slide_ms} milliseconds"
    span = F.window("ts", length, length, f"{offset_ms % slide_ms} milliseconds")
    seen = F.when(F.col("values").isNotNull(), F.struct("ts", "seq"))
    return (
        stream.withWatermark("ts", delay)
        .groupBy(span.alias("span"), *STREAM, "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by("values", seen).alias("values"))
        .select(
            *STREAM,
            F.col("span.start").alias("window_start"),
            F.col("span.end").alias("window_end"),
            "key",
            "n",
            "values",
        )
    )


def seal_windows(
    stream: DataFrame,
    store: WindowStore,
    name: str,
    slide_ms: int = DAY_MS,
    offset_ms: int = 0,
    *,
    delay: str,
) -> DataStreamWriter:
    """A writer that stores every window once the watermark has passed its end.

    A window's keys leave the state in one micro-batch, which becomes one seal named after it: a
    replayed batch replaces itself. The batch is written as it leaves the state and sealed from
    there, where adaptive execution, which stateful plans go without, splits hot windows.
    """

    def seal(batch: DataFrame, batch_id: int) -> None:
        rows = written(batch, f"{name}-batch")
        if not rows.isEmpty():
            store.seal(rows, f"{name}-{batch_id}")

    keys = windowed_keys(stream, slide_ms, offset_ms, delay=delay)
    return keys.writeStream.outputMode("append").foreachBatch(seal)


def flush_tail(
    records: DataFrame,
    store: WindowStore,
    seal: str,
    slide_ms: int = DAY_MS,
    offset_ms: int = 0,
    since: Moment | None = None,
) -> None:
    """Seal every window the store does not have, from a batch read of the same records.

    A finite stream ends before the watermark passes its last windows; this closes them.
    """
    if since is not None:
        records = records.filter(F.col("ts") >= moment(since))
    store.seal_records(store.unsealed(assign_windows(records, slide_ms, offset_ms)), seal)


def track_open_windows(
    stream: DataFrame,
    path: str,
    slide_ms: int = DAY_MS,
    offset_ms: int = 0,
    *,
    delay: str,
) -> DataStreamWriter:
    """A writer that logs the new totals of changed keys, one folder per micro-batch."""
    counts = windowed_keys(stream, slide_ms, offset_ms, delay=delay).drop("values")
    return changes_writer(counts, path)


def changes_writer(changes: DataFrame, path: str) -> DataStreamWriter:
    """Log the updated rows of a stateful aggregate; a replayed batch replaces its folder."""

    def log(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("epoch", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("epoch")
            .parquet(path)
        )

    return changes.writeStream.outputMode("update").foreachBatch(log)


def latest_counts(changes: DataFrame) -> DataFrame:
    """Current counts from the change log: totals only grow, so the largest is the latest."""
    return changes.groupBy(*STREAM_WINDOW, "key").agg(F.max("n").alias("n"))
