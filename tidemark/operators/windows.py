"""Tumbling windows per stream, label conventions and range selection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.functions.times import Moment, moment
from tidemark.operators.joins import sized_join
from tidemark.schema import DAY_MS, DEFAULT_CONFIG, STREAM


def assign_windows(
    records: DataFrame, slide_ms: int | Column = DAY_MS, offset_ms: int | Column = 0
) -> DataFrame:
    """Add ``window_start`` and ``window_end``, the half-open tumbling window of ``ts``."""
    start = times.window_start(F.col("ts"), slide_ms, offset_ms)
    return records.withColumn("window_start", start).withColumn(
        "window_end", times.later(F.col("window_start"), slide_ms)
    )


def with_config(
    records: DataFrame, config: DataFrame, defaults: Mapping[str, int] = DEFAULT_CONFIG
) -> DataFrame:
    """Attach each stream's settings, falling back to the default parameter by parameter."""
    joined = sized_join(records, config.select(*STREAM, *defaults), STREAM)
    return joined.withColumns(
        {name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()}
    )


def assign_configured_windows(
    records: DataFrame, config: DataFrame, defaults: Mapping[str, int] = DEFAULT_CONFIG
) -> DataFrame:
    """Windows by every stream's own slide length and start time."""
    return assign_windows(
        with_config(records, config, defaults), F.col("slide_length_ms"), F.col("start_time_ms")
    )


def label_column(label: str) -> Column:
    """The timestamp that names a window: its ``start`` or its ``end``."""
    if label not in ("start", "end"):
        raise ValueError(f"label must be 'start' or 'end', not {label!r}")
    return F.col(f"window_{label}")


def with_label(windowed: DataFrame, label: str = "start") -> DataFrame:
    """Replace the window bounds by the label text."""
    return windowed.withColumn("label", times.format_label(label_column(label))).drop(
        "window_start", "window_end"
    )


def in_range(
    windowed: DataFrame,
    begin: Moment | None = None,
    end: Moment | None = None,
    as_of: Moment | None = None,
    label: str = "start",
) -> DataFrame:
    """Keep windows whose label lies in the closed range ``[begin, end]``.

    With ``as_of``, the window that is still open at that moment takes part only if the moment
    itself lies in the range, and windows that begin later do not exist yet.
    """
    named = label_column(label)
    inside = _between(named, begin, end)
    if as_of is None:
        return windowed.filter(inside)
    now = moment(as_of)
    sealed = F.col("window_end") <= now
    is_open = (F.col("window_start") <= now) & (F.col("window_end") > now)
    return windowed.filter((sealed & inside) | (is_open & _between(now, begin, end)))


def time_bounds(
    begin: Moment | None,
    end: Moment | None,
    as_of: Moment | None,
    label: str,
    slide_ms: int,
    offset_ms: int,
) -> tuple[Column | None, Column | None]:
    """Constant first and last event time that windows in a label range can hold."""
    first = last = None
    if begin is not None:
        first = moment(begin) if label == "start" else times.later(moment(begin), -slide_ms)
        if as_of is not None:
            # The open window may have started before the range.
            first = F.least(first, times.window_start(moment(as_of), slide_ms, offset_ms))
    if end is not None:
        last = times.later(moment(end), slide_ms) if label == "start" else moment(end)
    if as_of is not None:
        last = moment(as_of) if last is None else F.least(last, moment(as_of))
    return first, last


def select_range(
    records: DataFrame,
    begin: Moment | None = None,
    end: Moment | None = None,
    as_of: Moment | None = None,
    label: str = "start",
    slide_ms: int = DAY_MS,
    offset_ms: int = 0,
) -> DataFrame:
    """Window the records and select a label range, with the range pushed to the scan of ``ts``.

    The bounds on ``ts`` are constants, so they fold into the parquet filters of the source.
    """
    first, last = time_bounds(begin, end, as_of, label, slide_ms, offset_ms)
    if first is not None:
        records = records.filter(F.col("ts") >= first)
    if last is not None:
        records = records.filter(F.col("ts") <= last)
    return in_range(assign_windows(records, slide_ms, offset_ms), begin, end, as_of, label)


def open_window(
    records: DataFrame, as_of: Moment, slide_ms: int = DAY_MS, offset_ms: int = 0
) -> DataFrame:
    """The records of the window that is open at ``as_of``, as far as they have arrived."""
    now = moment(as_of)
    start = times.window_start(now, slide_ms, offset_ms)
    return assign_windows(
        records.filter((F.col("ts") >= start) & (F.col("ts") <= now)), slide_ms, offset_ms
    )


def of_stream(df: DataFrame, service: str, collection: str | None = None) -> DataFrame:
    """One stream, or all streams of a service."""
    df = df.filter(F.col("service") == service)
    return df if collection is None else df.filter(F.col("collection") == collection)


def window_labels(windowed: DataFrame, label: str = "start") -> DataFrame:
    """The labels each stream has, one row per window."""
    return windowed.select(
        *STREAM, times.format_label(label_column(label)).alias("label")
    ).distinct()


def collections(windowed: DataFrame, as_of: Moment | None = None) -> DataFrame:
    """Collections with at least one sealed window."""
    if as_of is not None:
        windowed = windowed.filter(F.col("window_end") <= moment(as_of))
    return windowed.select(*STREAM).distinct()


def _between(value: Column, begin: Moment | None, end: Moment | None) -> Column:
    inside = F.lit(True)
    if begin is not None:
        inside = inside & (value >= moment(begin))
    if end is not None:
        inside = inside & (value <= moment(end))
    return inside
