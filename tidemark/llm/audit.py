"""How filters interact: what each removes after the others, in every order, from one count per set of failures.

A document is reduced to the set of filters it fails. Counts per part and set, at most 32 rows a part, hold all that the
audit needs. Over them runs the removal game: the worth of a coalition of filters is the number of documents that fail at
least one of them. Its potential follows recursively over the 32 coalitions,

    P(empty) = 0,    P(S) = (worth(S) + sum of P(S without i) over i in S) / |S|,

a filter's Shapley value is the potential of all filters minus the potential without it, and a step of an
order removes the worth of the coalition up to it minus that of the coalition before.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, slices, whole_text
from tidemark.llm.words import pieces

FILTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
_UPPER = bytes(range(0x41, 0x5B))
_SIGNS = b"#$%&*|"
#: Bytes that continue a code point.
_CONTINUED = bytes(range(0x80, 0xC0))


def failures(raw: bytes) -> int:
    """The filters that look at one text alone, as bits: A few words, B repeated words, C upper case, D signs."""
    words, distinct = 0, set()
    for piece in pieces(raw):
        # bytes.split cuts at the six ASCII white space characters.
        found = piece.split()
        words += len(found)
        distinct.update(found)
    points = len(raw) - _count(raw, _CONTINUED)
    fails = (
        words < MIN_WORDS,
        100 * len(distinct) < DISTINCT_PERCENT * words,
        100 * _count(raw, _UPPER) > UPPER_PERCENT * points,
        _count(raw, _SIGNS) > 0,
    )
    return sum(fail << i for i, fail in enumerate(fails))


def _count(raw: bytes, what: bytes) -> int:
    return len(raw) - len(raw.translate(None, what))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = batch.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("part"),
                pa.array([failures(t) for t in texts], pa.int32()),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
            ],
            names=["id", "part", "fails", "digest"],
        )


def failure_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``part``, ``fails`` (bits of ``FILTERS``), ``n``, ``good`` and ``toxic`` documents: at most 32 rows a part.

    Filter E, a text that a smaller id has too, needs the smallest id of every text. Copies are counted per text
    before anything is gathered by text, and only the counts are, so a group with a third of all rows is a few rows.
    """
    prepare(docs.sparkSession)
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        whole_text().alias("text"),
    )
    judged = keyed.mapInArrow(_judged, "id long, part string, fails int, digest binary")
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # Null ids have no label: numbers below zero of a second key keep them apart and spread.
    salt = F.when(F.col("id").isNull(), F.lit(-1) - F.monotonically_increasing_id()).otherwise(F.lit(0))
    joined = judged.withColumn("salt", salt).join(marks.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    marked = joined.select(
        "id", "part", "fails", "digest", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )
    kind = ["digest", "part", "fails", "good", "toxic"]
    # A null id is the smallest of all.
    first = F.struct(F.col("id").isNotNull(), F.col("id"))
    texts = (
        marked.groupBy(*kind, "id")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy(*kind)
        .agg(F.sum("rows").alias("rows"), F.min(first).alias("first"), F.min_by("rows", first).alias("at_first"))
    )
    # One row per text, part and label from here on.
    smallest = F.min("first").over(Window.partitionBy("digest"))
    kept = F.when(F.col("first") == smallest, F.col("at_first")).otherwise(F.lit(0))
    split = texts.withColumn("kept", kept).select(
        "part",
        "good",
        "toxic",
        F.inline(
            F.array(
                F.struct("fails", F.col("kept").alias("n")),
                F.struct(
                    F.col("fails").bitwiseOR(F.lit(1 << FILTERS.index("E"))).alias("fails"), (F.col("rows") - F.col("kept")).alias("n")
                ),
            )
        ),
    )
    return (
        split.filter("n > 0")
        .groupBy("part", "fails")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    )


def potentials(worth: Column, filters: int) -> Column:
    """The potential of every coalition, times ``filters`` factorial, as an array; ``worth`` is indexed by coalition.

    Coalitions are numbers whose bits are filters; one follows all that it contains, so a fold over the numbers has
    every potential it needs. The factor makes all of them whole numbers.
    """
    scale = factorial(filters)

    def add(known: Column, coalition: Column) -> Column:
        below = F.lit(0).cast("long")
        size = F.bit_count(coalition)
        for i in range(filters):
            bit = F.lit(1 << i)
            without = F.get(known, coalition.bitwiseXOR(bit))
            below = below + F.when(coalition.bitwiseAND(bit) != 0, without).otherwise(F.lit(0))
        total = F.get(worth, coalition) * scale + below
        # Exact: the potential times the factorial is whole.
        return F.concat(known, F.array((total / size).cast("long")))

    empty = F.array(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), empty, add)


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All orders of the filters, step by step, from the counts of :func:`failure_counts`.

    Per part, ``filter_order`` and ``step``: ``kept`` after the step, ``removed`` by it, ``redundant`` (fails its filter, removed
    before), ``unique_fails`` (fails this filter only), ``good_lost``, ``toxic_lost`` and ``shapley`` (removals of the filter
    summed over all orders). Parts without documents do not exist; all other rows are there, zeros included.
    """
    size = len(filters)
    everything = (1 << size) - 1

    def worth(column: str) -> Column:
        sums = [F.sum(F.when(F.col("fails").bitwiseAND(F.lit(s)) != 0, F.col(column)).otherwise(0)) for s in range(everything + 1)]
        return F.array(*sums)

    alone = F.array(*[F.sum(F.when(F.col("fails") == 1 << i, F.col("n")).otherwise(0)) for i in range(size)])
    games = counts.groupBy("part").agg(
        F.sum("n").alias("documents"),
        worth("n").alias("worth"),
        worth("good").alias("good"),
        worth("toxic").alias("toxic"),
        alone.alias("alone"),
    )
    games = games.withColumn("potential", potentials(F.col("worth"), size))
    steps = [
        {"filter_order": "".join(order), "step": k + 1, "filter": filters.index(f), "before": sum(1 << filters.index(x) for x in order[:k])}
        for order in permutations(filters)
        for k, f in enumerate(order)
    ]
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,filter:int,before:int>>")
    placed = games.select("*", F.inline(plan)).withColumn("bit", F.expr("shiftleft(1, filter)"))
    before, after = F.col("before"), F.col("before").bitwiseOR(F.col("bit"))

    def added(column: str) -> Column:
        return F.get(F.col(column), after) - F.get(F.col(column), before)

    return placed.select(
        "part",
        "filter_order",
        "step",
        (F.col("documents") - F.get("worth", after)).alias("kept"),
        added("worth").alias("removed"),
        (F.get("worth", F.col("bit")) - added("worth")).alias("redundant"),
        F.get("alone", F.col("filter")).alias("unique_fails"),
        added("good").alias("good_lost"),
        added("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(everything)) - F.get("potential", F.lit(everything).bitwiseXOR(F.col("bit")))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The interactions of the five filters over ``docs``, per value of ``part``.

    A null ``part`` is the empty text, a null text is empty. A null ``doc_id`` is smaller than all others and has no
    label; rows that repeat a ``doc_id`` are not copies of each other, since neither id is smaller. A document with
    several labels counts as good, or toxic, if one of them says so. An empty table gives no rows. Other columns, whatever
    their names, are not looked at.
    """
    return interactions(failure_counts(docs, labels, part))
