"""The stored windows: keys, top lists, distinct sketches, count-min cells and a catalog.

Every table is parquet below one folder, partitioned by the day a window starts and by the seal
(one write) that put the rows there:

    keys      stream, window bounds, key, n, values
    toplist   stream, window bounds, rk, key, n
    distinct  stream, window bounds, hll
    cms       stream, window bounds, i, b, v
    kmv       stream, window bounds, h             (with ``kmv_size``)
    catalog   stream, window bounds, n_events, n_keys   (by seal only)

Partitioning by day keeps the number of folders independent of the number of streams and of the
window length; rows are sorted by window and stream inside the files, so both are also found by
row-group statistics. A seal writes its
catalog rows last, and readers take only seals the catalog knows: a job lost half-way leaves nothing
visible, and repeating it under the same name replaces what it left. A store has one writer.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import Moment, later, moment
from tidemark.operators import countmin, distinct, frequency, spacesaving, values
from tidemark.operators.joins import sized_join
from tidemark.operators.windows import in_range, with_config
from tidemark.schema import (
    HLL_LG_K,
    SKETCH_DEPTH,
    SKETCH_MAX_VALUE,
    SKETCH_WIDTH,
    STREAM_WINDOW,
    TOP_LIST_CAPACITY,
)

_STREAM = (
    "service string, collection string, window_start timestamp, window_end timestamp, "
)
_PLACE = ", day string, seal string"
TABLES = {
    "keys": _STREAM + "key string, n bigint, values map<string,string>" + _PLACE,
    "toplist": _STREAM + "rk int, key string, n bigint" + _PLACE,
    "distinct": _STREAM + "hll binary" + _PLACE,
    "cms": _STREAM + "i int, b bigint, v bigint" + _PLACE,
    "kmv": _STREAM + "h bigint" + _PLACE,
    "catalog": _STREAM + "n_events bigint, n_keys bigint, seal string",
}


class WindowStore:
    """Write-once storage of sealed windows below ``path``.

    ``config`` gives streams their own top-list capacity, sketch width and sketch cap; the other
    arguments are for streams without. ``kmv_size`` minimum values are kept per window, or none.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        capacity: int = TOP_LIST_CAPACITY,
        depth: int = SKETCH_DEPTH,
        width: int = SKETCH_WIDTH,
        max_value: int = SKETCH_MAX_VALUE,
        lg_k: int = HLL_LG_K,
        config: DataFrame | None = None,
        kmv_size: int | None = None,
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.capacity = capacity
        self.depth = depth
        self.width = width
        self.max_value = max_value
        self.lg_k = lg_k
        self.config = config
        self.kmv_size = kmv_size
        with ThreadPoolExecutor(len(TABLES)) as pool:
            create = inheritable_thread_target(spark)(self._create)
            for job in [pool.submit(create, name) for name in TABLES]:
                job.result()

    def _create(self, name: str) -> None:
        empty = self.spark.createDataFrame([], TABLES[name]).write.mode("ignore")
        empty.partitionBy(*_places(name)).parquet(self._folder(name))

    def seal(self, key_rows: DataFrame, seal: str) -> None:
        """Store the windows of ``key_rows`` (see :func:`values.key_rollup`) not yet in the store.

        ``key_rows`` is evaluated once. All other tables come from the stored rows. A seal that was
        completed before is left as it is.
        """
        if not self.catalog().filter(F.col("seal") == seal).isEmpty():
            return
        self._write("keys", self.unsealed(key_rows), seal)
        stored = self._read("keys").filter(F.col("seal") == seal)
        counts = stored.select(*STREAM_WINDOW, "key", "n")
        if counts.isEmpty():
            return
        derived = {
            "toplist": self._top_lists(counts),
            "distinct": distinct.distinct_sketches(counts, self.lg_k),
            "cms": self._cells(counts),
        }
        if self.kmv_size:
            derived["kmv"] = distinct.kmv_hashes(counts, self.kmv_size, STREAM_WINDOW).drop("rk")
        # Independent jobs over the same stored rows: together they keep the cluster busy.
        with ThreadPoolExecutor(len(derived)) as pool:
            write = inheritable_thread_target(self.spark)(self._write)
            for job in [pool.submit(write, name, rows, seal) for name, rows in derived.items()]:
                job.result()
        entries = counts.groupBy(*STREAM_WINDOW).agg(
            F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_keys")
        )
        self._write("catalog", entries, seal)

    def _top_lists(self, counts: DataFrame) -> DataFrame:
        if self.config is None:
            return frequency.top_list(counts, self.capacity)
        largest = self.config.agg(F.max("topk_max_count")).first()[0]
        limited = with_config(counts, self.config, {"topk_max_count": self.capacity})
        top = frequency.configured_top_list(limited, max(largest or 0, self.capacity))
        return top.select(*STREAM_WINDOW, "rk", "key", "n")

    def _cells(self, counts: DataFrame) -> DataFrame:
        if self.config is None:
            return countmin.cells(counts, self.depth, self.width, self.max_value)
        defaults = {"sketch_width": self.width, "sketch_max_value": self.max_value}
        sized = with_config(counts, self.config, defaults)
        return countmin.cells(
            sized, self.depth, F.col("sketch_width"), F.col("sketch_max_value")
        )

    def seal_records(self, windowed: DataFrame, seal: str, as_of: Moment | None = None) -> None:
        """Roll up windowed records and store them; with ``as_of``, only windows over by then."""
        if as_of is not None:
            windowed = windowed.filter(F.col("window_end") <= moment(as_of))
        self.seal(values.key_rollup(windowed), seal)

    def catalog(self) -> DataFrame:
        """One row per sealed window of each stream."""
        return self._read("catalog")

    def keys(self, begin=None, end=None, label: str = "start") -> DataFrame:
        """Counts and first-seen attributes per sealed window and key."""
        return self._range("keys", begin, end, label)

    def top_lists(self, begin=None, end=None, label: str = "start") -> DataFrame:
        return self._range("toplist", begin, end, label)

    def frequent(self, begin=None, end=None, label: str = "start") -> DataFrame:
        """The top lists as Space-Saving summaries; see :mod:`tidemark.operators.spacesaving`."""
        lists = self.top_lists(begin, end, label)
        if self.config is None:
            return spacesaving.from_top_lists(lists, self.capacity)
        limited = with_config(lists, self.config, {"topk_max_count": self.capacity})
        return spacesaving.from_top_lists(limited, F.col("topk_max_count"))

    def distinct_sketches(self, begin=None, end=None, label: str = "start") -> DataFrame:
        return self._range("distinct", begin, end, label)

    def cells(self, begin=None, end=None, label: str = "start") -> DataFrame:
        return self._range("cms", begin, end, label)

    def minimum_values(self, begin=None, end=None, label: str = "start") -> DataFrame:
        """The minimum sets of windows; of those sealed without ``kmv_size`` there are none."""
        if not self.kmv_size:
            raise ValueError("this store keeps no minimum values: give it a kmv_size")
        return self._range("kmv", begin, end, label)

    def unsealed(self, windowed: DataFrame) -> DataFrame:
        """Rows of windows the store does not have."""
        sealed = self.catalog().select(*STREAM_WINDOW)
        return sized_join(windowed, sealed, STREAM_WINDOW, "left_anti")

    def _range(self, name: str, begin: Moment | None, end: Moment | None, label: str) -> DataFrame:
        rows = self._read(name)
        # Day text sorts like time, so these prune folders.
        if begin is not None:
            first = moment(begin)
            if label == "end":
                first = later(first, -self._longest_ms())
            rows = rows.filter(F.col("day") >= _day(first))
        if end is not None:
            rows = rows.filter(F.col("day") <= _day(moment(end)))
        rows = in_range(rows.drop("day"), begin, end, None, label)
        committed = self.catalog().select("seal").distinct()
        return sized_join(rows, committed, ["seal"], "left_semi").drop("seal")

    def _longest_ms(self) -> int:
        length = F.unix_millis("window_end") - F.unix_millis("window_start")
        return self.catalog().agg(F.max(length)).first()[0] or 0

    def _folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(self._folder(name))

    def _write(self, name: str, rows: DataFrame, seal: str) -> None:
        """Replace what a lost attempt of this seal wrote, in files that follow stream order.

        The rebalance hint lets adaptive execution merge small partitions and split large ones, so a
        window with a third of the rows is not written by one task.
        """
        placed = rows.withColumn("seal", F.lit(seal))
        if name != "catalog":
            placed = placed.withColumn("day", _day(F.col("window_start")))
        columns = T.StructType.fromDDL(TABLES[name]).names
        places = _places(name)
        order = [*places, *[c for c in ("window_start", "service", "collection", "rk", "key", "h") if c in columns]]
        (
            placed.select(*columns)
            .hint("rebalance", *places)
            .sortWithinPartitions(*order)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*places)
            .parquet(self._folder(name))
        )


def _places(name: str) -> list[str]:
    return ["seal"] if name == "catalog" else ["day", "seal"]


def _day(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")

