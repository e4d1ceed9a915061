"""The analytics service as one object: insert records, seal windows, ask questions.

Questions take a service, mostly a collection, and label ranges; they return DataFrames. Sealed
windows come from the store, windows not yet sealed from the record log. ``as_of`` is the moment
taken as the present, by default the wall clock.

The log is partitioned by day and insert, and every seal notes how far it got: later seals and
questions read only the days and inserts beyond that, never the records of sealed history. One
driver inserts and seals.
"""

from __future__ import annotations

import time
from datetime import datetime, timezone
from functools import cached_property, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from tidemark.functions import times
from tidemark.functions.attributes import attribute
from tidemark.functions.times import LABEL_STRPTIME, Moment, moment
from tidemark.operators import distinct, frequency, spacesaving, values, windows
from tidemark.operators.joins import sized_join
from tidemark.schema import DAY_MS, RECORD, STREAM, STREAM_WINDOW
from tidemark.session import tune
from tidemark.sources.labelstore import LabelStore
from tidemark.sources.rollup import RollUps
from tidemark.sources.store import WindowStore

_LOG = StructType(
    [
        *RECORD.fields,
        StructField("arrived", LongType()),
        StructField("sent", TimestampType()),
        StructField("day", StringType()),
        StructField("batch", LongType()),
    ]
)
_PROGRESS = "as_of timestamp, batch bigint"
_FAR = "99991231T000000"


class LogAnalytics:
    """Windowed analytics over the records kept below ``path``.

    ``config`` gives streams their own settings (see ``STREAM_CONFIG``); the slide length and offset
    are for streams without. ``late`` says what becomes of a record whose window is sealed when it
    comes: ``leave`` keeps it in the log but in no answer, ``open`` counts it in the open window.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        slide_ms: int = DAY_MS,
        offset_ms: int = 0,
        label: str = "start",
        config: DataFrame | None = None,
        late: str = "leave",
        **store_options,
    ):
        if late not in ("leave", "open"):
            raise ValueError(f"late must be 'leave' or 'open', not {late!r}")
        self.spark = tune(spark)
        self.late = late
        self.path = path.rstrip("/")
        self.defaults = {"start_time_ms": offset_ms, "slide_length_ms": slide_ms}
        self.label = label
        self.config = config
        self.longest_ms = slide_ms
        if config is not None:
            longest = config.agg(F.max("slide_length_ms")).first()[0]
            self.longest_ms = max(longest or 0, slide_ms)
        self.store = WindowStore(spark, f"{self.path}/windows", config=config, **store_options)
        self.label_store = LabelStore(spark, self.path)
        for path, schema, places in (
            (self._log_path, _LOG, ["day", "batch"]),
            (self._progress_path, _PROGRESS, ["batch"]),
        ):
            empty = spark.createDataFrame([], schema).write.mode("ignore")
            empty.partitionBy(*places).parquet(path)

    # --- records and sealing ---------------------------------------------------------------------

    @property
    def _log_path(self) -> str:
        return f"{self.path}/log"

    @property
    def _progress_path(self) -> str:
        return f"{self.path}/progress"

    def insert(self, records: DataFrame, batch: int | None = None) -> None:
        """Append log records, with or without attributes.

        Inserting again under the same batch number replaces the records of that batch. The number says
        nothing about when they came: that is noted beside it, and decides what a seal has covered.

        With ``late="open"`` a record whose window is sealed already counts in the window that is open
        when it comes; ``sent`` keeps its own time. Repeating a batch that a seal has covered moves nothing, since
        its records are counted. A null service, collection or key is the empty text, and a record
        without time happens when it comes.
        """
        arrived = _clock()
        number = arrived if batch is None else batch
        named = {name: F.coalesce(name, F.lit("")) for name in (*STREAM, "key")}
        present = F.timestamp_micros(F.lit(arrived).cast("long"))
        rows = records.select(*RECORD.names).withColumns(named | {"ts": F.coalesce("ts", present)})
        rows = rows.withColumn("sent", F.col("ts"))
        if self.late == "open" and not self.store.catalog().isEmpty():
            if batch is None or not self._covered(batch):
                rows = self._in_open_windows(rows)
        placed = rows.withColumns(
            {
                "arrived": F.lit(arrived).cast("long"),
                "day": F.date_format("ts", "yyyyMMdd"),
                "batch": F.lit(number).cast("long"),
            }
        )
        (
            placed.select(*_LOG.names)
            .hint("rebalance", "day")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day", "batch")
            .parquet(self._log_path)
        )

    def records(self) -> DataFrame:
        """The record log."""
        return self.spark.read.schema(_LOG).parquet(self._log_path)

    def late_records(self) -> DataFrame:
        """Logged records that were moved to a later window than their own."""
        return self.records().filter(F.col("sent") != F.col("ts")).select(*RECORD.names, "sent")

    def _covered(self, batch: int) -> bool:
        """Whether a seal came after the records logged under this number."""
        last = self._progress().agg(F.max("batch")).first()[0]
        logged = self.records().filter((F.col("batch") == batch) & (F.col("arrived") <= (last or 0)))
        return not logged.isEmpty()

    def _in_open_windows(self, rows: DataFrame) -> DataFrame:
        """Move records of sealed windows to the first moment of their stream's open window.

        That is the window the last seal left open, and in any case one behind all sealed ones.
        """
        if self.config is None:
            sized = rows.withColumns({name: F.lit(value) for name, value in self.defaults.items()})
        else:
            sized = windows.with_config(rows, self.config, self.defaults)
        slide, offset = F.col("slide_length_ms"), F.col("start_time_ms")
        catalog = self.store.catalog()
        sealed = catalog.select(*STREAM_WINDOW, F.lit(True).alias("late"))
        newest = catalog.groupBy(*STREAM).agg(F.max("window_end").alias("open"))
        marked = sized_join(windows.assign_windows(sized, slide, offset), sealed, STREAM_WINDOW)
        marked = sized_join(marked, newest, STREAM)
        noted = self._progress().filter(F.col("as_of") < moment(_FAR))
        reached = noted.agg(times.format_label(F.max_by("as_of", "batch"))).first()[0]
        now_open = F.col("open")
        if reached is not None:
            now_open = F.greatest(now_open, times.window_start(moment(reached), slide, offset))
        moved = F.when(F.col("late"), now_open).otherwise(F.col("ts"))
        return marked.withColumn("ts", moved).select(*rows.columns)

    def _progress(self) -> DataFrame:
        return self.spark.read.schema(_PROGRESS).parquet(self._progress_path)

    def seal(self, as_of: Moment | None = None, name: str | None = None) -> None:
        """Store all windows that are over and not stored yet."""
        as_of = _now(as_of)
        named = as_of if isinstance(as_of, str) else as_of.strftime(LABEL_STRPTIME)
        self._seal_pending(name or f"until-{named}-{_clock()}", as_of)

    def close(self, name: str | None = None) -> None:
        """Store everything, open windows included."""
        self._seal_pending(name or f"close-{_clock()}", None)

    def _seal_pending(self, name: str, as_of: Moment | None) -> None:
        if not self.store.catalog().filter(F.col("seal") == name).isEmpty():
            return  # a completed seal is left alone, and what came since stays pending
        batch = _clock()
        windowed = self._windowed(self._pending())
        self.store.seal_records(self.store.unsealed(windowed), name, as_of)
        reached = moment(_FAR if as_of is None else as_of)
        progress = self.spark.range(1).select(
            reached.alias("as_of"), F.lit(batch).cast("long").alias("batch")
        )
        progress.write.mode("append").partitionBy("batch").parquet(self._progress_path)

    def _pending(self) -> DataFrame:
        """Logged records that the last seal has not covered, by day and insert."""
        log = self.records()
        last = self._progress().agg(F.max(F.struct("batch", "as_of")).alias("last")).select(
            F.date_format(times.later(F.col("last.as_of"), -self.longest_ms), "yyyyMMdd").alias("day"),
            F.col("last.batch").alias("batch"),
        )
        reached = last.first()
        if reached["day"] is not None:
            log = log.filter(
                (F.col("day") >= F.lit(reached["day"])) | (F.col("arrived") > F.lit(reached["batch"]))
            )
        return log.select(*RECORD.names)

    # --- frequent keys ---------------------------------------------------------------------------

    def current_top_keys(
        self, service: str, collection: str, k: int, as_of: Moment | None = None
    ) -> DataFrame:
        rows = self._open(service, collection, as_of)
        return frequency.top_keys_of_stream(rows, k).select("key", "n")

    def top_keys(
        self,
        service: str,
        collection: str,
        begin: Moment,
        end: Moment,
        k: int,
        as_of: Moment | None = None,
        merge: str = "exact",
    ) -> DataFrame:
        """Most frequent keys of the windows in a range; ``merge`` is exact or truncated."""
        live = frequency.key_counts(self._live(service, collection, begin, end, as_of))
        if merge == "truncated":
            stored = self._stored(self.store.top_lists, service, collection, begin, end)
            heads = k + k // 2
            parts = stored.filter(F.col("rk") <= heads).drop("rk")
            recent = frequency.top_list(live, heads).drop("rk")
        elif merge == "exact":
            parts = self._stored(self.store.keys, service, collection, begin, end).drop("values")
            recent = live
        else:
            raise ValueError(f"merge must be 'exact' or 'truncated', not {merge!r}")
        return frequency.top_keys_of_stream(parts.unionByName(recent), k).select("key", "n")

    def frequent_keys(
        self,
        service: str,
        collection: str,
        begin: Moment,
        end: Moment,
        k: int,
        as_of: Moment | None = None,
    ) -> DataFrame:
        """Most frequent keys of a range from the stored summaries: ``key``, ``count``, ``error`` and ``floor``.

        Reads at most the capacity per window. A key occurred ``count - error`` to ``count`` times, and one that the
        summary of the range does not list at most ``floor`` times.
        """
        live = frequency.key_counts(self._live(service, collection, begin, end, as_of))
        stored = self._stored(self.store.frequent, service, collection, begin, end)
        parts = stored.unionByName(spacesaving.summaries(live, self.store.capacity))
        merged = spacesaving.merge(parts, self.store.capacity)
        return merged.filter(F.col("rk") <= k).select("key", "count", "error", "floor")

    # --- distinct keys ---------------------------------------------------------------------------

    def current_distinct(
        self, service: str, collection: str, as_of: Moment | None = None, exact: bool = False
    ) -> DataFrame:
        rows = self._open(service, collection, as_of)
        if not exact:
            rows = distinct.distinct_sketches(rows, self.store.lg_k)
        return self._count_distinct(rows, exact)

    def distinct(
        self,
        service: str,
        collection: str,
        begin: Moment,
        end: Moment,
        as_of: Moment | None = None,
        exact: bool = False,
    ) -> DataFrame:
        """Number of distinct keys over a range, one row; 0 for an unknown stream."""
        live = self._live(service, collection, begin, end, as_of)
        if exact:
            stored = self._stored(self.store.keys, service, collection, begin, end)
            return self._count_distinct(stored.select("key").unionByName(live.select("key")), True)
        rolled = partial(self._rolled.sketches, "distinct")
        stored = self._stored(rolled, service, collection, begin, end)
        recent = distinct.distinct_sketches(live, self.store.lg_k).select(*STREAM, "hll")
        return self._count_distinct(stored.unionByName(recent), False)

    def compare_keys(
        self, service: str, collection: str, other_service: str, other_collection: str, begin: Moment, end: Moment
    ) -> DataFrame:
        """How many keys two streams share over the sealed windows of a range, one row; see ``distinct.compare_kmv``.

        From stored minimum values, so the service needs a ``kmv_size``. A stream has all its keys in common with itself.
        """
        hashes = self._rolled.sketches("kmv", begin, end, self.label)
        one = windows.of_stream(hashes, service, collection).withColumn("side", F.lit(True))
        other = windows.of_stream(hashes, other_service, other_collection).withColumn("side", F.lit(False))
        return distinct.compare_kmv(one.unionByName(other), F.col("side"), self.store.kmv_size)

    def roll_up(self) -> None:
        """Merge the sketches of sealed windows over days, so that long ranges read few; after seals, from time to time."""
        self._rolled.refresh()

    @cached_property
    def _rolled(self) -> RollUps:
        return RollUps(self.store)

    def _count_distinct(self, rows: DataFrame, exact: bool) -> DataFrame:
        if exact:
            return distinct.distinct_keys(rows, [])
        merged = distinct.merged_distinct(rows, [])
        return merged.select(F.coalesce("estimate", F.lit(0)).alias("n_distinct"))

    # --- attributes ------------------------------------------------------------------------------

    def value(
        self, service: str, collection: str, key: str, as_of: Moment | None = None
    ) -> DataFrame:
        """The attributes of a key in the open window."""
        rows = values.values_of_key(self._open(service, collection, as_of), key)
        return values.first_seen(rows).select("key", "values")

    def value_attribute(
        self, service: str, collection: str, key: str, name: str, as_of: Moment | None = None
    ) -> DataFrame:
        """One attribute of a key in the open window."""
        found = self.value(service, collection, key, as_of)
        return found.select("key", attribute(F.col("values"), name).alias(name))

    def current_values(
        self, service: str, collection: str, limit: int, as_of: Moment | None = None
    ) -> DataFrame:
        """The first attribute rows of the open window in key order."""
        seen = values.first_seen(self._open(service, collection, as_of))
        return values.first_values(seen, limit).select("key", "values")

    def window_values(
        self, service: str, collection: str, window: Moment, limit: int | None = None
    ) -> DataFrame:
        """Attribute rows of a sealed window in key order, or all of them with their keys."""
        stored = self._stored(self.store.keys, service, collection, window, window)
        carrying = stored.filter(F.col("values").isNotNull())
        if limit is None:
            return values.values_and_key(carrying).select("key", "values")
        return values.first_values(carrying, limit).select("key", "values")

    def values_with_counts(
        self, service: str, collection: str, begin: Moment, as_of: Moment | None = None
    ) -> DataFrame:
        """Newest attributes and count of every key since ``begin``."""
        return self._values_with_counts(service, collection, begin, as_of)

    def all_collections(
        self, service: str, begin: Moment, as_of: Moment | None = None
    ) -> DataFrame:
        """The same for every collection of a service, in one plan."""
        return self._values_with_counts(service, None, begin, as_of)

    def _values_with_counts(
        self, service: str, collection: str | None, begin: Moment, as_of: Moment | None
    ) -> DataFrame:
        stored = self._stored(self.store.keys, service, collection, begin, None)
        live = values.key_rollup(self._live(service, collection, begin, None, as_of))
        return values.values_and_key(values.values_with_counts(stored.unionByName(live)))

    # --- listings --------------------------------------------------------------------------------

    def windows(self, service: str, collection: str) -> DataFrame:
        """Labels of the sealed windows of a stream, in time order."""
        catalog = windows.of_stream(self.store.catalog(), service, collection)
        return windows.window_labels(catalog, self.label).select("label").orderBy("label")

    def collections(self, service: str) -> DataFrame:
        """Collections of a service with at least one sealed window."""
        catalog = windows.of_stream(self.store.catalog(), service)
        return windows.collections(catalog).select("collection")

    # --- labels ----------------------------------------------------------------------------------

    def add_labels(self, hits: DataFrame) -> None:
        self.label_store.add(hits)

    def labels(self, collection: str) -> DataFrame:
        return self.label_store.labels_of(collection).select("label_name", "hit_docs_num")

    def drop_labels(self, collection: str) -> None:
        self.label_store.drop(collection)

    # --- parts -----------------------------------------------------------------------------------

    def _windowed(self, records: DataFrame) -> DataFrame:
        if self.config is None:
            return windows.assign_windows(
                records, self.defaults["slide_length_ms"], self.defaults["start_time_ms"]
            )
        placed = windows.assign_configured_windows(records, self.config, self.defaults)
        return placed.drop(*self.defaults)

    def _open(self, service: str, collection: str, as_of: Moment | None) -> DataFrame:
        """Records of a stream's open window."""
        settings = self.defaults
        if self.config is not None:
            stream = self.spark.createDataFrame([(service, collection)], STREAM)
            settings = windows.with_config(stream, self.config, self.defaults).first()
        slide_ms, offset_ms = settings["slide_length_ms"], settings["start_time_ms"]
        as_of = _now(as_of)
        now = moment(as_of)
        start = times.window_start(now, slide_ms, offset_ms)
        log = self.records().filter(F.col("day").between(_day(start), _day(now)))
        stream = windows.of_stream(log.select(*RECORD.names), service, collection)
        return windows.open_window(stream, as_of, slide_ms, offset_ms)

    def _live(
        self,
        service: str,
        collection: str | None,
        begin: Moment,
        end: Moment | None,
        as_of: Moment | None,
    ) -> DataFrame:
        """Records of windows in the range that no seal has stored yet."""
        as_of = _now(as_of)
        ts = F.col("ts")
        first = times.later(F.least(moment(begin), moment(as_of)), -self.longest_ms)
        rows = windows.of_stream(self._pending(), service, collection)
        rows = rows.filter((ts >= first) & (ts <= moment(as_of)))
        if end is not None:
            rows = rows.filter(ts <= times.later(moment(end), self.longest_ms))
        chosen = windows.in_range(self._windowed(rows), begin, end, as_of, self.label)
        return self.store.unsealed(chosen)

    def _stored(
        self,
        read,
        service: str,
        collection: str | None,
        begin: Moment | None,
        end: Moment | None,
    ) -> DataFrame:
        return windows.of_stream(read(begin, end, self.label), service, collection)


def _clock() -> int:
    return time.time_ns() // 1000


def _day(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def _now(as_of: Moment | None) -> Moment:
    return datetime.now(timezone.utc).replace(tzinfo=None) if as_of is None else as_of
