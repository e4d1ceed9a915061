"""Micro-batches of the streaming queries."""

from pyspark.sql import functions as F

from tidemark.plans import queries


def test_batches_come_in_turn_and_are_written_by_many_tasks(spark):
    rows = spark.range(0, 1000, 1, 4).select(F.col("id").alias("seq"), F.lit(None).cast("map<string,string>").alias("values"))
    batch = F.when(F.col("seq") < 990, F.col("seq") % queries.STREAM_BATCHES).cast("int")
    seen = {}

    def take(batch, epoch):
        assert batch.columns == rows.columns
        found = batch.withColumn("file", F.input_file_name()).collect()
        seen[epoch] = ({row["seq"] for row in found}, len({row["file"] for row in found}), len(found))

    stream = queries._in_batches(spark, rows, batch)
    queries._drain(spark, stream.writeStream.foreachBatch(take), "batches-state")
    assert sorted(seen) == list(range(queries.STREAM_BATCHES))
    for epoch, (found, files, count) in seen.items():
        assert found == set(range(epoch, 990, queries.STREAM_BATCHES))
        assert count == len(found)
        assert files == 4


def test_a_batch_without_rows_is_a_micro_batch_too(spark):
    rows = spark.range(10).select(F.col("id").alias("seq"))
    seen = {}
    stream = queries._in_batches(spark, rows, F.when(F.col("seq") < 4, 0).otherwise(3))
    queries._drain(spark, stream.writeStream.foreachBatch(lambda df, epoch: seen.update({epoch: df.count()})), "empty-state")
    assert seen == {0: 4, 1: 0, 2: 0, 3: 6, 4: 0}
