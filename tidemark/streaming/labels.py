"""Running label totals over a stream of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators.labels import label_totals
from tidemark.streaming.windows import changes_writer


def track_labels(hits: DataFrame, path: str) -> DataStreamWriter:
    """A writer that logs only the totals that changed since the last micro-batch.

    The trigger decides how often that is, for instance ``processingTime="2 hours"``.
    """
    return changes_writer(label_totals(hits), path)


def latest_totals(changes: DataFrame) -> DataFrame:
    """Current totals from the change log: the newest entry of every label."""
    return changes.groupBy("collection", "label_name").agg(
        F.max_by("hit_docs_num", "epoch").alias("hit_docs_num")
    )
