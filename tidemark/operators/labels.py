"""Running hit counts of property labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_totals(hits: DataFrame) -> DataFrame:
    """Total hits per collection and label."""
    return hits.groupBy("collection", "label_name").agg(F.sum("hits").alias("hit_docs_num"))


def labels_of(totals: DataFrame, collection: str) -> DataFrame:
    """All labels of one collection."""
    return totals.filter(F.col("collection") == collection)


def without_collection(rows: DataFrame, collection: str) -> DataFrame:
    """What is left after all labels of a collection are dropped."""
    return rows.filter(F.col("collection") != collection)
