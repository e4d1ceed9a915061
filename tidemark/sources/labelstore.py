"""Stored label hits: an append-only log in which dropping a collection is an entry too."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.joins import sized_join
from tidemark.operators.labels import label_totals, labels_of

_SCHEMA = "collection string, label_name string, hits bigint, dropped boolean, arrived bigint, entry bigint"


class LabelStore:
    """Label totals below ``path``.

    Every entry notes when it came, which orders drops and adds; a caller's number only says what it
    replaces. An entry written again keeps its place in that order.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = f"{path.rstrip('/')}/labels"
        empty = spark.createDataFrame([], _SCHEMA).write.mode("ignore")
        empty.partitionBy("entry").parquet(self.path)

    def add(self, hits: DataFrame, entry: int | None = None) -> None:
        """Add hits, summed per label first. Adding again under the same number replaces them."""
        summed = label_totals(hits).withColumnRenamed("hit_docs_num", "hits")
        self._write(summed.withColumn("dropped", F.lit(False)), entry)

    def drop(self, collection: str, entry: int | None = None) -> None:
        """Drop all labels a collection has so far."""
        marker = self.spark.createDataFrame(
            [(collection, None, 0, True)],
            "collection string, label_name string, hits bigint, dropped boolean",
        )
        self._write(marker, entry)

    def totals(self) -> DataFrame:
        """Total hits per collection and label since the collection was last dropped."""
        entries = self._entries()
        drops = (
            entries.filter("dropped")
            .groupBy("collection")
            .agg(F.max("arrived").alias("dropped_at"))
        )
        live = sized_join(entries.filter("not dropped"), drops, ["collection"])
        return label_totals(
            live.filter(F.col("dropped_at").isNull() | (F.col("arrived") > F.col("dropped_at")))
        )

    def labels_of(self, collection: str) -> DataFrame:
        return labels_of(self.totals(), collection)

    def _entries(self) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(self.path)

    def _write(self, rows: DataFrame, entry: int | None) -> None:
        arrived = time.time_ns() // 1000
        number = arrived if entry is None else entry
        if entry is not None:
            before = self._entries().filter(F.col("entry") == entry).agg(F.max("arrived")).first()[0]
            arrived = arrived if before is None else before
        (
            rows.withColumn("arrived", F.lit(arrived).cast("long"))
            .withColumn("entry", F.lit(number).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("entry")
            .parquet(self.path)
        )
