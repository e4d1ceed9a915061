"""Running label totals of a stream, kept as a snapshot and the changes since.

Every micro-batch adds its hits per label as a change. Every ``fold_every`` micro-batches snapshot and changes become a
new snapshot and the changes go, so that reading takes in the labels there are and a few micro-batches, never the
history. Changes and snapshots are named after their micro-batch: a replay replaces its own and counts nothing twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators.labels import label_totals
from tidemark.session import written
from tidemark.streaming.epochs import EpochTable, folder_values, remove

_TOTALS = "collection string, label_name string, hit_docs_num bigint, upto bigint"
_CHANGES = "collection string, label_name string, hits bigint, epoch bigint"


@dataclass
class RunningTotals:
    """Label totals below ``path``; null collections and labels are values like any other."""

    spark: SparkSession
    path: str
    fold_every: int = 16

    def writer(self, hits: DataFrame) -> DataStreamWriter:
        """A writer that takes the hits of a stream in; to be started with a checkpoint location."""
        return hits.writeStream.outputMode("append").foreachBatch(self.take)

    def take(self, batch: DataFrame, epoch: int) -> None:
        """Add the hits of one micro-batch."""
        summed = label_totals(batch).withColumnRenamed("hit_docs_num", "hits")
        (
            summed.withColumn("epoch", F.lit(epoch).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("epoch")
            .parquet(f"{self.path}/changes")
        )
        if (epoch + 1) % self.fold_every == 0:
            self._fold(epoch)

    def _fold(self, epoch: int) -> None:
        totals = self._totals(self._snapshots().before(epoch), epoch)
        snapshot = written(totals.withColumn("upto", F.lit(epoch).cast("long")), "totals")
        if not snapshot.isEmpty():
            self._snapshots().write(snapshot, epoch)
        # A replay of this micro-batch starts from the snapshot before; older changes are in that one.
        kept = sorted(folder_values(self.spark, f"{self.path}/snapshots", "epoch", int))[-2:]
        if len(kept) == 2:
            for number in folder_values(self.spark, f"{self.path}/changes", "epoch", int):
                if number <= kept[0]:
                    remove(self.spark, f"{self.path}/changes/epoch={number}")
        self._snapshots().forget(epoch)

    def _snapshots(self) -> EpochTable:
        return EpochTable(self.spark, f"{self.path}/snapshots", _TOTALS)

    def _totals(self, snapshot: DataFrame, last: int | None = None) -> DataFrame:
        upto = snapshot.agg(F.max("upto")).first()[0]
        folded = snapshot.select("collection", "label_name", F.col("hit_docs_num").alias("hits"))
        if not folder_values(self.spark, f"{self.path}/changes", "epoch"):
            return label_totals(folded)
        changes = self.spark.read.schema(_CHANGES).parquet(f"{self.path}/changes")
        if upto is not None:
            changes = changes.filter(F.col("epoch") > upto)
        if last is not None:
            changes = changes.filter(F.col("epoch") <= last)
        return label_totals(folded.unionByName(changes.drop("epoch")))

    def totals(self) -> DataFrame:
        """Total hits per collection and label so far."""
        return self._totals(self._snapshots().before())
