"""What a stream carries from one micro-batch to the next, as a table: one state per epoch.

The state of an epoch is complete, so a reader needs only the newest one, and older ones can go. A replayed micro-batch
reads the state before its own epoch and replaces its own, so it does the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class EpochTable:
    """States below ``path``; ``schema`` is that of a state's rows, as DDL."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark = spark
        self.path = path
        self.schema = f"{schema}, epoch bigint"
        empty = spark.createDataFrame([], self.schema).write.mode("ignore")
        empty.partitionBy("epoch").parquet(path)

    def write(self, rows: DataFrame, epoch: int) -> None:
        """Put the state of an epoch in place of what a lost attempt wrote."""
        (
            rows.withColumn("epoch", F.lit(epoch).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("epoch")
            .parquet(self.path)
        )

    def before(self, epoch: int | None = None) -> DataFrame:
        """The rows of the newest state, or of the newest one before ``epoch``; none if there is none."""
        states = self.spark.read.schema(self.schema).parquet(self.path)
        if epoch is not None:
            states = states.filter(F.col("epoch") < epoch)
        newest = states.agg(F.max("epoch")).first()[0]
        return states.filter(F.col("epoch") == F.lit(newest).cast("long")).drop("epoch")

    def forget(self, epoch: int) -> None:
        """Remove the states that no replay of ``epoch`` or later reads: all but the newest two up to it."""
        for number in sorted(folder_values(self.spark, self.path, "epoch", int))[:-2]:
            if number < epoch:
                remove(self.spark, f"{self.path}/epoch={number}")


def folder_values(spark: SparkSession, path: str, column: str, kind=str) -> list:
    """The values of a partition column that have a folder below ``path``."""
    place, files = _files(spark, path)
    names = [status.getPath().getName() for status in files.listStatus(place)] if files.exists(place) else []
    prefix = f"{column}="
    return [kind(name.removeprefix(prefix)) for name in names if name.startswith(prefix)]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the library's own, whatever file system it is on."""
    place, files = _files(spark, path)
    files.delete(place, True)


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())
