"""Sealing the windows of all streams in one streaming query, each stream by its own settings, with nothing lost.

Every micro-batch is rolled up per window and key and added to a table of open windows, in which the state of the query
lives: a window length is a column there, so any number of settings are one query and one read of the source. The
time reached is the newest event time seen less ``delay_ms``; windows that end by it are sealed from the table and
leave it.

An event whose window is sealed when it comes is late. It is kept in a side output as it came, and counts in the window
of its stream that holds the time reached, the oldest still open, from that window's first moment.

Every step is named after its micro-batch and replaces what a lost attempt left, and what is late depends only on the
micro-batches before, so a replay does the same again.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.functions import times
from tidemark.operators.windows import assign_windows, with_config
from tidemark.schema import DAY_MS, RECORD, STREAM_WINDOW
from tidemark.session import written
from tidemark.sources.store import WindowStore
from tidemark.streaming.epochs import EpochTable, folder_values, remove

_OPEN = (
    "service string, collection string, window_start timestamp, window_end timestamp, key string, n bigint, "
    "values map<string,string>, seen struct<ts:timestamp,seq:bigint>, closes string, epoch bigint"
)
_LATE = RECORD.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ", 6)
_PROGRESS = "newest timestamp, reached timestamp"
#: Where events without time count as long as no event had one.
_NO_TIME = datetime(1970, 1, 1)


@dataclass
class StreamSealer:
    """Seals the windows of a stream of records into ``store``, keeping what is open below ``path``.

    ``delay_ms`` is how long events may come after the newest one before their window is sealed; there is no default,
    since it decides what is late. ``config`` gives streams their own slide length and start time (see
    ``STREAM_CONFIG``), the other arguments are for streams without. Null keys, services and collections are values like
    any other; an event without time happens at the newest time seen, or at the start of 1970 if none was seen yet.
    """

    spark: SparkSession
    store: WindowStore
    path: str
    name: str
    delay_ms: int
    config: DataFrame | None = None
    slide_ms: int = DAY_MS
    offset_ms: int = 0

    def writer(self, stream: DataFrame) -> DataStreamWriter:
        """A writer that takes the records of ``stream`` in; to be started with a checkpoint location."""
        return stream.writeStream.outputMode("append").foreachBatch(self.take)

    def take(self, batch: DataFrame, epoch: int) -> None:
        """Roll up one micro-batch and seal what is over by then."""
        progress = self._progress()
        before = progress.before(epoch).first()
        rows = written(batch.select(*RECORD.names), f"{self.name}-batch")
        newest = rows.agg(F.max("ts")).first()[0]
        known = [t for t in (newest, before["newest"] if before else None) if t is not None]
        if not known and rows.isEmpty():
            return
        newest = max(known, default=_NO_TIME)
        reached = before["reached"] if before else None
        self._add(rows.withColumn("ts", F.coalesce("ts", F.lit(newest))), reached, epoch)
        now = self.spark.createDataFrame([(newest,)], "newest timestamp").select(
            "newest", times.later(F.col("newest"), -self.delay_ms).alias("reached")
        )
        progress.write(now, epoch)
        self._seal_due(now.first()["reached"], reached, epoch)
        progress.forget(epoch)

    def _add(self, rows: DataFrame, reached, epoch: int) -> None:
        """Roll up the rows into the table of open windows, late ones into the window that holds ``reached``."""
        windowed = self._windowed(rows)
        if reached is None:
            placed = windowed.withColumn("late", F.lit(False))
        else:
            now = F.lit(reached)
            slide, offset = F.col("slide_length_ms"), F.col("start_time_ms")
            opened = times.window_start(now, slide, offset)
            placed = windowed.withColumn("late", F.col("window_end") <= now)
            self._replace(placed.filter("late").select(*RECORD.names), "late", ["epoch"], epoch)
            start = F.when(F.col("late"), opened).otherwise(F.col("window_start"))
            placed = placed.withColumns(
                {
                    "ts": F.when(F.col("late"), opened).otherwise(F.col("ts")),
                    "window_start": start,
                    "window_end": times.later(start, slide),
                }
            )
        seen = F.when(F.col("values").isNotNull(), F.struct("ts", "seq"))
        partial = placed.groupBy(*STREAM_WINDOW, "key").agg(
            F.count(F.lit(1)).alias("n"), F.min_by("values", seen).alias("values"), F.min(seen).alias("seen")
        )
        closes = F.date_format("window_end", "yyyyMMdd")
        self._replace(partial.withColumn("closes", closes), "open", ["closes", "epoch"], epoch)

    def _windowed(self, rows: DataFrame) -> DataFrame:
        defaults = {"slide_length_ms": self.slide_ms, "start_time_ms": self.offset_ms}
        if self.config is None:
            sized = rows.withColumns({name: F.lit(value).cast("long") for name, value in defaults.items()})
        else:
            sized = with_config(rows, self.config, defaults)
        return assign_windows(sized, F.col("slide_length_ms"), F.col("start_time_ms"))

    def _replace(self, rows: DataFrame, table: str, places: list[str], epoch: int) -> None:
        (
            rows.withColumn("epoch", F.lit(epoch).cast("long"))
            .hint("rebalance", *places)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*places)
            .parquet(f"{self.path}/{table}")
        )

    def _seal_due(self, reached, before, epoch: int) -> None:
        """Seal the windows that the time reached has passed since the micro-batch before."""
        due = self._partials().filter(F.col("window_end") <= F.lit(reached))
        due = due.filter(F.col("closes") <= F.date_format(F.lit(reached), "yyyyMMdd"))
        if before is not None:
            due = due.filter(F.col("window_end") > F.lit(before))
            due = due.filter(F.col("closes") >= F.date_format(F.lit(before), "yyyyMMdd"))
        # A replay of an earlier attempt of this micro-batch may see more epochs than it wrote.
        due = due.filter(F.col("epoch") <= epoch)
        if not due.isEmpty():
            self.store.seal(self._rolled(due), f"{self.name}-{epoch}")
        today = reached.strftime("%Y%m%d")
        for day in folder_values(self.spark, f"{self.path}/open", "closes"):
            if day < today:  # all windows that end on these days are sealed
                remove(self.spark, f"{self.path}/open/closes={day}")

    @staticmethod
    def _rolled(partials: DataFrame) -> DataFrame:
        return partials.groupBy(*STREAM_WINDOW, "key").agg(
            F.sum("n").alias("n"), F.min_by("values", "seen").alias("values")
        )

    def _partials(self) -> DataFrame:
        return self._table("open", _OPEN)

    def _table(self, name: str, schema: str) -> DataFrame:
        if not folder_values(self.spark, f"{self.path}/{name}", "closes" if name == "open" else "epoch"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _progress(self) -> EpochTable:
        return EpochTable(self.spark, f"{self.path}/progress", _PROGRESS)

    def reached(self):
        """The time up to which windows are sealed, or None."""
        row = self._progress().before().first()
        return row and row["reached"]

    def open_windows(self) -> DataFrame:
        """Counts and first-seen attributes of every key in the windows that are still open."""
        reached = self.reached()
        rows = self._partials()
        if reached is not None:
            rows = rows.filter(F.col("window_end") > F.lit(reached))
            rows = rows.filter(F.col("closes") >= F.date_format(F.lit(reached), "yyyyMMdd"))
        return self._rolled(rows)

    def late_records(self) -> DataFrame:
        """The records that came after their window was sealed, as they came."""
        return self._table("late", f"{_LATE}, epoch bigint").drop("epoch")

    def close(self) -> None:
        """Seal the windows that are still open: the tail of a stream that has ended."""
        self.store.seal(self.open_windows(), f"{self.name}-close")
