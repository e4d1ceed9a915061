"""The test tables in the shape of log records and label hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import Moment, moment
from tidemark.sources.records import label_hits, log_records, token_records


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_attributes() -> dict[str, Column]:
    return {"value": F.col("value"), "k": F.get_json_object("props", "$.k")}


def events_as_records(df: DataFrame) -> DataFrame:
    return log_records(
        df, F.lit("events"), "event_type", "user_id", "ts", "event_id", event_attributes()
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events``: one stream per event type, users as keys."""
    return events_as_records(table(spark, sf_dir, "events"))


def sales_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem``: one stream per return flag, parts as keys."""
    return log_records(
        table(spark, sf_dir, "lineitem"),
        F.lit("sales"),
        "l_returnflag",
        "l_partkey",
        "l_shipdate",
        F.col("l_orderkey") * 8 + F.col("l_linenumber"),
        {"qty": F.col("l_quantity"), "price": F.col("l_extendedprice")},
    )


def word_records(
    spark: SparkSession, sf_dir: str, arrival: Moment = "20240101T000000"
) -> DataFrame:
    """``documents``: one stream per language, the words of the text as keys, one arrival time."""
    docs = table(spark, sf_dir, "documents")
    return token_records(docs, "text", F.lit("docs"), "lang", moment(arrival))


def source_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents``: one hit per document on its source, languages as collections."""
    return label_hits(table(spark, sf_dir, "documents"), "lang", "source", F.lit(1))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream. The path is written as a pattern, which takes a file or a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of records."""
    return events_as_records(_stream(spark, sf_dir, "events"))


def source_hit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a stream of label hits."""
    return label_hits(_stream(spark, sf_dir, "documents"), "lang", "source", F.lit(1))
