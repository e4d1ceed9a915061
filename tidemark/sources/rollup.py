"""Stored sketches rolled up over dyadic ranges of days, so that a long range reads few of them.

A cell of level l covers ``2**l`` days, those whose number since 1970 has the same quotient by ``2**l``. For every
stream and cell the sketches of all windows that begin in it are stored merged: level 0 from the
windows, each other level from at most two cells below. A range of n days then reads at most two cells
per level, and single windows at days it covers in part.

Every stored cell notes how many windows it holds. Windows are write-once, so a cell holds all of its windows exactly if
that number is the catalog's; any other cell is not read, and its parts are. A range is right therefore
whether a refresh is missing, was lost half-way or came before the last seal.

    distinct  stream, hll          cms  stream, i, b, v          kmv  stream, h
    index     stream, n            all of them by level and cell
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from tidemark.functions.times import Moment, later, moment
from tidemark.operators import countmin, distinct
from tidemark.operators.joins import sized_join
from tidemark.operators.windows import label_column
from tidemark.schema import STREAM, STREAM_WINDOW
from tidemark.session import written
from tidemark.sources.store import WindowStore

_STREAM = "service string, collection string, "
_CELL = ["level", "cell"]
_PLACE = ", level int, cell int"
SKETCHES = {"distinct": "hll binary", "cms": "i int, b bigint, v bigint", "kmv": "h bigint"}


class RollUps:
    """Dyadic cells beside the windows of ``store``. There is one writer."""

    def __init__(self, store: WindowStore):
        self.store = store
        self.spark = store.spark
        self.kinds = [kind for kind in SKETCHES if kind != "kmv" or store.kmv_size]
        for name in [*self.kinds, "index"]:
            empty = self.spark.createDataFrame([], self._schema(name)).write.mode("ignore")
            empty.partitionBy(*_CELL).parquet(self._folder(name))

    def refresh(self) -> None:
        """Bring all cells up to date that windows were added to; the others are not touched."""
        catalog = self.store.catalog().withColumn("day", _day_number(F.col("window_start")))
        span = catalog.agg(F.min("day"), F.max("day")).first()
        if span[0] is None:
            return
        levels = 1
        while span[0] >> (levels - 1) != span[1] >> (levels - 1):
            levels += 1
        due = written(_per_cell(catalog, levels).agg(F.count(F.lit(1)).alias("n")), "cells")
        noted = self._read("index").withColumnRenamed("n", "noted")
        stale = sized_join(due, noted, [*STREAM, *_CELL]).filter(~F.col("n").eqNullSafe(F.col("noted")))
        # At most two numbers per day that windows were added to.
        cells: dict[int, list[int]] = {}
        for level, cell in stale.select(*_CELL).distinct().collect():
            cells.setdefault(level, []).append(cell)
        if not cells:
            return

        def roll(kind: str) -> None:
            for level in sorted(cells):
                parts = self._days(kind, cells[level]) if level == 0 else self._below(kind, level, cells[level])
                self._write(kind, self._merge(kind)(parts, [*STREAM, *_CELL]))

        # The kinds know nothing of each other: together they keep the cluster busy.
        with ThreadPoolExecutor(len(self.kinds)) as pool:
            inherited = inheritable_thread_target(self.spark)(roll)
            for job in [pool.submit(inherited, kind) for kind in self.kinds]:
                job.result()
        # Last: what a lost refresh leaves is not counted on.
        self._write("index", due.filter(_any_cell([(level, cell) for level in cells for cell in cells[level]])))

    def sketches(
        self, kind: str, begin: Moment | None = None, end: Moment | None = None, label: str = "start"
    ) -> DataFrame:
        """Sketches per stream that together are those of all windows in a range: cells, and single windows.

        The closed range means window labels, as in :meth:`WindowStore.distinct_sketches`.
        """
        if kind not in self.kinds:
            raise ValueError(f"no {kind!r} in this store")
        placed = self._cover(begin, end, label)
        columns = [*STREAM, *_columns(kind)]
        nodes = placed.filter(F.col("level") >= 0).select(*STREAM, *_CELL).distinct()
        # Two numbers per cell, of which a range has at most two per level where all are up to date.
        pairs = [tuple(row) for row in nodes.select(*_CELL).distinct().collect()]
        rolled = self._read(kind).filter(_any_cell(pairs))
        rolled = sized_join(rolled, nodes, [*STREAM, *_CELL], "left_semi").select(*columns)
        single = placed.filter(F.col("level") < 0).select(*STREAM_WINDOW, "seal", "day")
        # One day per day that is not in a cell.
        days = [row[0] for row in single.select("day").distinct().collect()]
        if not days:
            return rolled
        stored = self.store._read(kind).filter(F.col("day").isin(days))
        stored = sized_join(stored, single.drop("day"), [*STREAM_WINDOW, "seal"], "left_semi")
        return rolled.unionByName(stored.select(*columns))

    def _cover(self, begin: Moment | None, end: Moment | None, label: str) -> DataFrame:
        """The windows of a range, each with the largest up-to-date cell around it that lies in the range.

        ``level`` is -1 where there is none. Cells of one stream contain each other or are disjoint, and all windows of
        a cell have it in reach, so that the cells chosen cover every window once.
        """
        named = label_column(label)
        inside = F.lit(True)
        day = _day_number(F.col("window_start"))
        seen = self.store.catalog().withColumn("day", day)
        bounds = F.lit(True)
        # Whole days, so that every cell within them is seen whole.
        if begin is not None:
            inside &= named >= moment(begin)
            first = moment(begin) if label == "start" else later(moment(begin), -self.store._longest_ms())
            seen = seen.filter(F.col("day") >= _day_number(first))
            bounds &= _first_day(F.col("cell")) >= _day_number(first)
        if end is not None:
            inside &= named <= moment(end)
            seen = seen.filter(F.col("day") <= _day_number(moment(end)))
            bounds &= _first_day(F.col("cell") + 1) <= _day_number(moment(end)) + 1
        top = self._read("index").agg(F.max("level")).first()[0]
        seen = written(seen.withColumn("inside", inside), "seen")
        windows = seen.filter("inside")
        dated = F.date_format("window_start", "yyyyMMdd").alias("text")
        if top is None:
            placed = windows.select(*STREAM_WINDOW, "seal", dated, F.lit(-1).alias("level"), F.lit(0).alias("cell"))
            return placed.withColumnRenamed("text", "day")
        counted = _per_cell(seen, top + 1).agg(F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("n_inside"))
        whole = sized_join(
            counted.filter((F.col("n") == F.col("n_inside")) & bounds).drop("n_inside"),
            self._read("index"), [*STREAM, *_CELL, "n"], "left_semi",
        )
        reach = windows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
        reach = reach.withColumn("cell", _cell_of(F.col("day"), F.col("level")))
        found = sized_join(reach, whole.select(*STREAM, *_CELL, F.lit(True).alias("whole")), [*STREAM, *_CELL])
        best = F.max(F.when(F.col("whole"), F.struct("level", "cell"))).alias("best")
        placed = found.groupBy(*STREAM_WINDOW, "seal").agg(best).select(
            *STREAM_WINDOW, "seal", dated,
            F.coalesce("best.level", F.lit(-1)).alias("level"), F.coalesce("best.cell", F.lit(0)).alias("cell"),
        )
        return written(placed.withColumnRenamed("text", "day"), "cover")

    def _days(self, kind: str, days: list[int]) -> DataFrame:
        """The sketches of the windows that begin on ``days``, with their cells of level 0."""
        committed = self.store.catalog().select(*STREAM_WINDOW, "seal")
        texts = [(date(1970, 1, 1) + timedelta(number)).strftime("%Y%m%d") for number in days]
        stored = self.store._read(kind).filter(F.col("day").isin(texts))
        stored = sized_join(stored, committed, [*STREAM_WINDOW, "seal"], "left_semi")
        return stored.withColumn("level", F.lit(0)).withColumn("cell", _day_number(F.col("window_start")))

    def _below(self, kind: str, level: int, cells: list[int]) -> DataFrame:
        """The cells one level below ``cells``, numbered as these."""
        children = [child for cell in cells for child in (2 * cell, 2 * cell + 1)]
        parts = self._read(kind).filter((F.col("level") == level - 1) & F.col("cell").isin(children))
        return parts.withColumn("level", F.lit(level)).withColumn("cell", F.shiftright("cell", 1))

    def _merge(self, kind: str) -> Callable[[DataFrame, list[str]], DataFrame]:
        if kind == "distinct":
            return lambda rows, group: rows.groupBy(*group).agg(F.hll_union_agg("hll").alias("hll"))
        if kind == "cms":
            return countmin.merge
        return lambda rows, group: distinct.merge_kmv(rows, self.store.kmv_size, group)

    def _schema(self, name: str) -> str:
        return _STREAM + SKETCHES.get(name, "n bigint") + _PLACE

    def _folder(self, name: str) -> str:
        return f"{self.store.path}/rolled/{name}"

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._schema(name)).parquet(self._folder(name))

    def _write(self, name: str, rows: DataFrame) -> None:
        """Replace the cells that ``rows`` has."""
        columns = [*STREAM, *(_columns(name) if name in SKETCHES else ["n"]), *_CELL]
        placed = rows.select(*columns).hint("rebalance", *_CELL).sortWithinPartitions(*_CELL, *STREAM)
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*_CELL).parquet(self._folder(name))


def _columns(kind: str) -> list[str]:
    return [column.split()[0] for column in SKETCHES[kind].split(", ")]


def _day_number(ts: Column) -> Column:
    """Days since 1970."""
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))


def _cell_of(day: Column, level: Column) -> Column:
    return F.call_function("shiftright", day, level)


def _first_day(cell: Column) -> Column:
    return F.call_function("shiftleft", cell, F.col("level"))


def _per_cell(windows: DataFrame, levels: int) -> GroupedData:
    """Windows with their ``day``, grouped by stream and every cell around them."""
    placed = windows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    return placed.withColumn("cell", _cell_of(F.col("day"), F.col("level"))).groupBy(*STREAM, *_CELL)


def _any_cell(pairs: list[tuple[int, int]]) -> Column:
    """A condition on the folders of some cells."""
    levels: dict[int, list[int]] = {}
    for level, cell in pairs:
        levels.setdefault(level, []).append(cell)
    condition = F.lit(False)
    for level, cells in sorted(levels.items()):
        condition |= (F.col("level") == level) & F.col("cell").isin(sorted(cells))
    return condition
