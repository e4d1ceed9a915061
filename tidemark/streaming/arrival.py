"""Arrival-order windows over a stream: the open day of every stream goes from one micro-batch to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.functions.times import later
from tidemark.operators.arrival import assign_arrival_windows
from tidemark.operators.joins import is_small
from tidemark.operators.ranking import ROWS_PER_BUCKET
from tidemark.schema import DAY_MS, STREAM
from tidemark.session import written
from tidemark.streaming.epochs import EpochTable

_OPEN = "service string, collection string, opened timestamp"


def track_arrival_windows(
    stream: DataFrame, path: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataStreamWriter:
    """A writer that puts every event into the day that is open when it arrives, one folder per micro-batch.

    Within a micro-batch events arrive in the order of ``seq``, and micro-batches follow each other, so the result is that
    of :func:`assign_arrival_windows` over all events. One row per stream is carried: its open day.
    """

    def place(batch: DataFrame, epoch: int) -> None:
        # The batch's own session: the one the stream was started with has other settings.
        spark = batch.sparkSession
        open_days = EpochTable(spark, f"{path}/open", _OPEN)
        carried = open_days.before(epoch)
        arrived = assign_arrival_windows(written(batch, "arrived"), rows_per_bucket)
        placed = _carry(arrived, carried)
        (
            placed.withColumn("epoch", F.lit(epoch).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("epoch")
            .parquet(f"{path}/placed")
        )
        reached = (
            spark.read.parquet(f"{path}/placed")
            .filter(F.col("epoch") == epoch)
            .select(*STREAM, F.col("window_start").alias("opened"))
            .unionByName(carried)
            .groupBy(*STREAM)
            .agg(F.max("opened").alias("opened"))
        )
        open_days.write(written(reached, "reached"), epoch)
        open_days.forget(epoch)

    return stream.writeStream.outputMode("append").foreachBatch(place)


def _carry(arrived: DataFrame, carried: DataFrame) -> DataFrame:
    """No event opens a day before the one its stream has reached."""
    named = carried.withColumnsRenamed({name: f"__{name}" for name in STREAM})
    same = F.lit(True)
    for name in STREAM:
        same &= F.col(name).eqNullSafe(F.col(f"__{name}"))
    beside = arrived.join(F.broadcast(named) if is_small(named) else named, same, "left")
    day = F.greatest("window_start", "opened")
    return (
        beside.withColumn("window_start", day)
        .withColumn("window_end", later(F.col("window_start"), DAY_MS))
        .select(*arrived.columns)
    )


def arrival_windows(spark: SparkSession, path: str) -> DataFrame:
    """All events placed so far, with their windows."""
    return spark.read.parquet(f"{path}/placed").drop("epoch")
