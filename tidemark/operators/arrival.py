"""Windows by arrival order, for imports in which late events are not moved back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import later, start_of_day
from tidemark.operators.ranking import ROWS_PER_BUCKET, running_max
from tidemark.schema import DAY_MS, STREAM


def assign_arrival_windows(
    records: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Day windows in which an event joins the window that is open when it arrives.

    A stream's open day only moves forward with ``seq``; a late event stays in the current day.
    """
    dated = records.withColumn("__day", start_of_day(F.col("ts")))
    opened = running_max(dated, STREAM, "seq", "__day", "window_start", rows_per_bucket)
    return opened.drop("__day").withColumn("window_end", later(F.col("window_start"), DAY_MS))
