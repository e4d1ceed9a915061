"""Window labels (ISO basic time, ``yyyyMMddTHHmmss``) and day arithmetic."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the label format.
LABEL_FORMAT = "yyyyMMdd'T'HHmmss"
LABEL_STRPTIME = "%Y%m%dT%H%M%S"

Moment = str | datetime


def parse_label(text: Column) -> Column:
    """Label text to timestamp; malformed text gives null."""
    return F.try_to_timestamp(text, F.lit(LABEL_FORMAT))


def format_label(ts: Column) -> Column:
    return F.date_format(ts, LABEL_FORMAT)


def moment(value: Moment) -> Column:
    """A label or datetime parameter as a timestamp literal in session time."""
    if isinstance(value, str):
        value = datetime.strptime(value, LABEL_STRPTIME)
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def start_of_day(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def next_day(ts: Column) -> Column:
    return F.date_trunc("day", ts) + F.expr("INTERVAL 1 DAY")


def ms_of_day(ts: Column) -> Column:
    """Milliseconds since local midnight."""
    return F.unix_millis(ts) - F.unix_millis(start_of_day(ts))


def later(ts: Column, ms: int | Column) -> Column:
    """``ts`` moved by ``ms`` milliseconds."""
    shift = F.lit(ms).cast("long") if isinstance(ms, int) else ms.cast("long")
    return F.timestamp_millis(F.unix_millis(ts) + shift)


def window_start(ts: Column, slide_ms: int | Column, offset_ms: int | Column = 0) -> Column:
    """Start of the tumbling window that holds ``ts``.

    The offset counts modulo the slide, and ``pmod`` keeps times before 1970 in the window that
    starts at or before them.
    """
    slide = F.lit(slide_ms).cast("long") if isinstance(slide_ms, int) else slide_ms
    offset = F.lit(offset_ms).cast("long") if isinstance(offset_ms, int) else offset_ms
    ms = F.unix_millis(ts)
    return F.timestamp_millis(ms - F.pmod(ms - offset, slide))
