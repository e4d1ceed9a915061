"""What the operators share: document keys, ordered buckets and worker set-up.

A document is identified by its ``doc_id`` and its text. Rows that repeat both are one document to
every operator and get equal results; a null ``doc_id`` sorts before all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.joins import is_small

#: Stands for a null doc_id where ids are compared.
NULL_ID = -(2**63)
ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it outside their path."""
    environment = spark.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", ""):
        environment["PYTHONPATH"] = ":".join(filter(None, [environment.get("PYTHONPATH"), ROOT]))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_key(column: str = "doc_id") -> Column:
    """``doc_id`` as a long that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def whole_text(column: str = "text") -> Column:
    """The text; a null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(column: str = "text") -> Column:
    """Tells rows with one ``doc_id`` apart by their text."""
    return F.xxhash64(whole_text(column))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``docs`` has it: for working columns beside a user's own."""
    taken = {c.lower() for c in docs.columns}
    free = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        free.append(name)
    return free


def own_columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` by their exact names, dots included."""
    return [F.col(f"`{name}`") for name in docs.columns]


def with_keys(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with ``id_key`` and ``text_key`` under names that are free, and these names."""
    names = free_names(docs, "id", "h")
    return docs.withColumns(dict(zip(names, (id_key(), text_key())))), names


def among(docs: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` that are (``left_semi``) or are not (``left_anti``) among the keys ``id``, ``h`` of ``listed``.

    Only a list whose counted rows allow it is broadcast. Else both sides meet on keys that single documents have, and
    adaptive execution splits what repeated rows make large.
    """
    keyed, names = with_keys(docs)
    keys = listed.select(*[F.col(a).alias(b) for a, b in zip(("id", "h"), names)])
    keys = F.broadcast(keys) if is_small(keys) else keys
    return keyed.join(keys, names, how).select(*own_columns(docs))


def row_key(docs: DataFrame) -> Column:
    """``text_key``, or a constant where no two rows share a ``doc_id``: 8 bytes less to carry around."""
    shared = docs.select(id_key().alias("id")).groupBy("id").count().filter("count > 1")
    return F.lit(0).cast("long") if shared.isEmpty() else text_key()


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that working memory is bounded
    by that or by one document."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(text)).to_pylist()
        first = size = 0
        for row, length in enumerate(lengths):
            if row > first and size + (length or 0) > most:
                yield batch.slice(first, row - first)
                first, size = row, 0
            size += length or 0
        if first < len(lengths):
            yield batch.slice(first)
    # What the batches took goes back: workers live on between tasks.
    pa.default_memory_pool().release_unused()


def split_ids(df: DataFrame, column: str, buckets: int) -> list[int]:
    """At most ``buckets`` - 1 ascending values that cut ``column`` into ranges of similar size.

    A quantile sketch: its accuracy shapes the ranges and never decides which rows they hold.
    """
    shares = [i / buckets for i in range(1, buckets)]
    if not shares:
        return []
    points = df.agg(F.percentile_approx(column, F.lit(shares), 20 * buckets)).first()[0]
    return sorted(set(points or []))


def with_range(df: DataFrame, column: str, points: list[int], name: str) -> DataFrame:
    """Add the number of the range that ``column`` falls in; a range begins at its split point."""
    if not points:
        return df.withColumn(name, F.lit(0))
    return df.withColumn(name, _position(F.col(column), points))


def _position(value: Column, points: list[int]) -> Column:
    """How many of ``points`` are at most ``value``, by bisection written as nested conditions."""

    def cut(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(points[middle]), cut(low, middle)).otherwise(cut(middle + 1, high))

    return cut(0, len(points))
