"""Adapters from any DataFrame to log records and label hits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.attributes import attribute_map, row_attributes
from tidemark.functions.times import Moment, moment, parse_label

# Fixed value: the characters that separate tokens of a text.
WHITESPACE = "[ \\t\\n\\x0B\\f\\r]+"


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def log_records(
    df: DataFrame,
    service: Column,
    collection: str | Column,
    key: str | Column,
    ts: str | Column | None = None,
    seq: str | Column | None = None,
    values: Column | Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rows as log records, batch or streaming.

    Without ``ts`` an event happens when it arrives. ``values`` is a map column, a mapping from
    attribute to column, or nothing for events without attributes.
    """
    if values is None:
        values = F.lit(None).cast("map<string,string>")
    elif not isinstance(values, Column):
        values = attribute_map(values)
    return df.select(
        service.cast("string").alias("service"),
        _column(collection).cast("string").alias("collection"),
        _column(key).cast("string").alias("key"),
        (F.current_timestamp() if ts is None else _column(ts)).cast("timestamp").alias("ts"),
        (F.lit(0) if seq is None else _column(seq)).cast("long").alias("seq"),
        values.alias("values"),
    )


def token_records(
    df: DataFrame,
    text: str,
    service: Column,
    collection: str | Column,
    ts: str | Column | Moment | None = None,
) -> DataFrame:
    """Every whitespace-separated token of a text as the key of an event.

    The outer form spares a derived is-not-empty filter, which would split each text twice; rows
    without tokens are dropped with the empty ones.
    """
    tokens = df.withColumn("__token", F.explode_outer(F.split(F.col(text), WHITESPACE)))
    return log_records(tokens.filter(F.col("__token") != ""), service, collection, "__token", ts)


def imported_records(
    table: DataFrame,
    service: Column,
    since: Moment,
    collection: str = "collection",
    time: str = "TimeStamp",
    key: str = "query",
    hits: str = "hit_docs_num",
    seq: str | Column | None = None,
) -> DataFrame:
    """A query-log table as records: rows since a time that had hits, whole rows as attributes.

    ``time`` is a timestamp or label text; label text compares as text. Both filters stay plain
    column comparisons, so the source can apply them.
    """
    is_text = table.schema[time].dataType.typeName() == "string"
    threshold = F.lit(since) if is_text else moment(since)
    kept = table.filter((F.col(time) >= threshold) & (F.col(hits) > 0))
    ts = parse_label(F.col(time)) if is_text else F.col(time)
    return log_records(kept, service, collection, key, ts, seq, row_attributes(table.columns))


def label_hits(
    df: DataFrame,
    collection: str | Column = "collection",
    label_name: str | Column = "label_name",
    hits: str | Column = "hit_docs_num",
) -> DataFrame:
    """Rows as label hits; text counts are read as numbers."""
    return df.select(
        _column(collection).cast("string").alias("collection"),
        _column(label_name).cast("string").alias("label_name"),
        _column(hits).cast("long").alias("hits"),
    )
