"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source's documents, in ``doc_id`` order, form blocks. Were the mix a fluid, a source of weight w would get
w of every slot; once a source has run out, the others share its part by their weights. Let t(x) be the slot time by
which the fluid has given a source x blocks. Its block j, counted from 0, may run from slot floor(t(j)) and must
run before slot ceil(t(j + 1)): earliest deadline first over these windows gives every slot to one block, and at any
time every source has had its share but for less than one block.

The schedule is not worked out in one go. It is cut into segments of equal length, and what every source has had at a
cut follows from the cut alone: its share rounded down, and one more block for as many sources as slots remain. Of those
with a block begun there, the choice takes in deadline order as many as their fractions add up to, earliest release
first. Rounding along both orders at once like this leaves enough slots on either side of the cut, so every segment
runs from its first cut to its second one, apart from all others, and the whole still meets every window. For that
no window may contain two cuts, so a segment is at least as long as the longest window: one over the smallest share.

Weights are whole parts, and all floors, remainders and sums are in whole numbers.

Numbering the documents of a hot source would sort it in one task. They are numbered within
ranges of ``doc_id`` instead, on top of counted totals of the ranges before.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from fractions import Fraction
from math import ceil, lcm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import NULL_ID, free_names, id_key, own_columns, partitions, split_ids, text_key, with_keys, with_range
from tidemark.operators.joins import sized_join
from tidemark.session import written

BLOCK_DOCS = 16
#: Weights without a common denominator of at most so much are rounded to parts of it: after n blocks that is
#: less than n / PARTS of a block.
PARTS = 10**9
SEGMENT_SLOTS = 256
RANGES_PER_PARTITION = 4
NO_SOURCE = ""
RATES = "array<struct<source:string,i:int,part:long,blocks:long,gone:long,parts:long,start:long>>"


def whole_parts(weights: dict[str, float]) -> dict[str, int]:
    """The weights in proportion, as whole numbers."""
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) / total for s, w in weights.items()}
    parts = lcm(*(x.denominator for x in exact.values()))
    return {s: max(1, round(x * min(parts, PARTS))) for s, x in exact.items()}


def fluid_rates(parts: dict[str, int], blocks: dict[str, int]) -> list[dict]:
    """One entry per source with blocks, in the order in which they run out.

    From slot ``start`` until the source runs out, the sources before it are gone with their ``gone`` blocks and those
    from it on have ``parts`` in all. Whole blocks only say when a slot begins or ends, so ``start`` is rounded up.
    """
    order = sorted((s for s in blocks if blocks[s]), key=lambda s: (Fraction(blocks[s], parts[s]), s))
    rates, gone, start, left = [], 0, 0, sum(parts[s] for s in order)
    for i, s in enumerate(order):
        rates.append({"source": s, "i": i, "part": parts[s], "blocks": blocks[s], "gone": gone, "parts": left, "start": start})
        start = gone + ceil(Fraction(blocks[s] * left, parts[s]))
        gone, left = gone + blocks[s], left - parts[s]
    return rates


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _while_given(rates: Column, part: Column, given: Column) -> Column:
    """The entry that holds when a source of ``part`` has been given so many blocks."""
    run_out = F.size(F.filter(rates, lambda s: s["blocks"] * part <= given * s["part"]))
    return F.get(rates, F.least(run_out, F.size(rates) - 1))


def _release(rates: Column, part: Column, block: Column) -> Column:
    return _let(_while_given(rates, part, block), lambda now: now["gone"] + _div(block * now["parts"], part))


def _deadline(rates: Column, part: Column, block: Column) -> Column:
    end = block + 1
    return _let(_while_given(rates, part, end), lambda now: now["gone"] + _div(end * now["parts"] + part - 1, part))


def _begun(rates: Column, now: Column, cut: Column) -> Column:
    """Per source: whole blocks ``had`` by the fluid at the cut and what it has of the next one, in ``now.parts``."""
    share = lambda s: s["part"] * (cut - now["gone"])
    return F.transform(
        rates,
        lambda s: F.when(s["i"] < now["i"], F.struct(s["blocks"].alias("had"), F.lit(0).cast("long").alias("rest"))).otherwise(
            F.struct(_div(share(s), now["parts"]).alias("had"), (share(s) % now["parts"]).alias("rest"))
        ),
    )


def _rounded_up(rates: Column, now: Column, begun: Column) -> Column:
    """Numbers of the sources that have had the block they have begun at the cut."""

    def open_block(s: Column) -> Column:
        had = F.get(begun, s["i"])["had"]
        return F.struct(
            _deadline(rates, s["part"], had).alias("deadline"),
            _release(rates, s["part"], had).alias("release"),
            s["i"].alias("i"),
            F.get(begun, s["i"])["rest"].alias("rest"),
        )

    by_deadline = F.array_sort(F.transform(F.filter(rates, lambda s: F.get(begun, s["i"])["rest"] > 0), open_block))
    nothing = F.struct(
        F.from_json(F.lit("[]"), "array<struct<release:long,deadline:long,i:int>>").alias("open"),
        F.lit(0).cast("long").alias("sum"),
        F.from_json(F.lit("[]"), "array<int>").alias("taken"),
    )

    def step(state: Column, block: Column) -> Column:
        total = state["sum"] + block["rest"]
        blocks = F.array_append(state["open"], F.struct(block["release"], block["deadline"], block["i"]))
        first = F.array_min(blocks)
        return F.when(
            _div(total, now["parts"]) > F.size(state["taken"]),
            F.struct(
                F.array_except(blocks, F.array(first)).alias("open"),
                total.alias("sum"),
                F.array_append(state["taken"], first["i"]).alias("taken"),
            ),
        ).otherwise(F.struct(blocks.alias("open"), total.alias("sum"), state["taken"].alias("taken")))

    return F.aggregate(by_deadline, nothing, step, lambda state: state["taken"])


def _earliest_deadline_first(rates: Column, first: Column, last: Column, had: Column, will: Column) -> Column:
    """The blocks of one segment, each with its slot."""

    def waiting(part: Column, i: Column, block: Column, end: Column) -> Column:
        return _let(
            _deadline(rates, part, block),
            lambda deadline: F.struct(
                F.least(deadline, last).alias("due"),
                _release(rates, part, block).alias("release"),
                i.alias("i"),
                block.alias("block"),
                deadline.alias("deadline"),
                end.alias("end"),
                part.alias("part"),
            ),
        )

    def step(state: Column, slot: Column) -> Column:
        def run(best: Column) -> Column:
            others = F.array_except(state["waiting"], F.array(best))
            following = waiting(best["part"], best["i"], best["block"] + 1, best["end"])
            done = F.struct(best["i"], best["block"], best["release"], best["deadline"], slot.alias("slot"))
            return F.struct(
                F.when(best["block"] + 1 < best["end"], F.array_append(others, following)).otherwise(others).alias("waiting"),
                F.array_append(state["done"], done).alias("done"),
            )

        return _let(F.array_min(F.filter(state["waiting"], lambda block: block["release"] <= slot)), run)

    all_waiting = F.transform(rates, lambda s: waiting(s["part"], s["i"], F.get(had, s["i"]), F.get(will, s["i"])))
    start = F.struct(
        F.filter(all_waiting, lambda block: block["block"] < block["end"]).alias("waiting"),
        F.from_json(F.lit("[]"), "array<struct<i:int,block:long,release:long,deadline:long,slot:long>>").alias("done"),
    )
    return F.aggregate(F.sequence(first, last - 1), start, step, lambda state: state["done"])


def block_slots(
    spark: SparkSession, parts: dict[str, int], blocks: dict[str, int], segment: int = SEGMENT_SLOTS
) -> DataFrame:
    """``source``, ``block``, ``release``, ``deadline`` and ``slot`` of every block of every source.

    The slots are those from 0 to the number of blocks, each taken once. One row of ``segment`` blocks is the
    unit of work, so the schedule is spread over the cluster; only the rates, one entry per source, are everywhere.
    A segment is no shorter than the time in which the source of the smallest weight gets one block.
    """
    known = fluid_rates(parts, blocks)
    total = sum(blocks.values())
    # No block may be open at two cuts, where the choices could differ: windows are longest before any source is gone.
    segment = max([segment, *(-(-s["parts"] // r["part"]) + 1 for s in known[:1] for r in known)])
    segments = -(-total // segment)
    rates = F.from_json(F.lit(json.dumps(known)), RATES)
    cuts = (
        spark.range(0, segments, 1, max(1, min(segments, partitions(spark))))
        .select((F.col("id") * segment).alias("first"), F.least((F.col("id") + 1) * segment, F.lit(total)).alias("last"))
        .withColumn("rates", rates)
    )
    for cut, had in (("first", "had"), ("last", "will")):
        held = F.size(F.filter("rates", lambda s: s["start"] <= F.col(cut)))
        cuts = cuts.withColumn("now", F.get("rates", held - 1))
        cuts = cuts.withColumn("begun", _begun(F.col("rates"), F.col("now"), F.col(cut)))
        cuts = cuts.withColumn("up", _rounded_up(F.col("rates"), F.col("now"), F.col("begun")))
        one_more = lambda x, i: x["had"] + F.array_contains(F.col("up"), i).cast("long")
        cuts = cuts.withColumn(had, F.transform("begun", one_more))
    run = _earliest_deadline_first(*(F.col(c) for c in ("rates", "first", "last", "had", "will")))
    done = cuts.select("rates", F.explode(run).alias("b"))
    return done.select(F.get("rates", F.col("b.i"))["source"].alias("source"), "b.block", "b.release", "b.deadline", "b.slot")


def _numbered(docs: DataFrame, source: str) -> DataFrame:
    """``id``, ``source`` and ``place`` of every document within its source, in order, from 0."""
    points = split_ids(docs.select(id_key().alias("id")), "id", RANGES_PER_PARTITION * partitions(docs.sparkSession))
    keyed = docs.select(
        id_key().alias("id"), text_key().alias("h"), F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("source")
    )
    ranged = written(with_range(keyed, "id", points, "range"), "ranged")
    # One row per range and source.
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(
        ranged.groupBy("source", "range").count().select(
            "source", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")
        ),
        "bases",
    )
    within = Window.partitionBy("range", "source").orderBy("id", "h")
    local = ranged.withColumn("local", F.row_number().over(within) - 1)
    return sized_join(local, bases, ["source", "range"], "inner").select(
        "id", "h", "source", (F.col("base") + F.col("local")).alias("place")
    )


def capped_weights(docs: DataFrame, cap: float, source: str = "source") -> dict[str, Fraction]:
    """Every source's share of the documents, but at most ``cap`` for any: one number per source.

    With so few sources that they cannot all stay below ``cap``, it is one over their number. The shares are
    exact and add up to one.
    """
    name = F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE))
    counts = {row[0]: row[1] for row in docs.groupBy(name.alias("source")).count().collect()}
    if not counts:
        return {}
    most = max(Fraction(cap), Fraction(1, len(counts)))
    capped: set[str] = set()
    while True:
        rest = sum(n for s, n in counts.items() if s not in capped)
        left = 1 - most * len(capped)
        over = {s for s, n in counts.items() if s not in capped and n * left > most * rest}
        if not over:
            return {s: most if s in capped else n * left / rest for s, n in counts.items()}
        capped |= over


def schedule(
    docs: DataFrame, weights: dict[str, float], source: str = "source", block_docs: int = BLOCK_DOCS
) -> DataFrame:
    """``doc_id``, ``source``, ``block``, ``release``, ``deadline``, ``slot`` and ``in_mix`` of every document.

    ``block`` counts a source's blocks of ``block_docs`` documents from 0; ``slot`` is the block's place in
    the mix. ``in_mix`` marks the documents up to where the first source would run out: so many of every
    source that the target weights hold, within one document. Slots go on beyond, for whoever wants all. A null source
    is the empty one, a null ``doc_id`` comes first, repeated rows follow each other. A source that has a weight but no
    documents leaves nothing in the mix. Sources without a weight raise an error.
    """
    columns = ("source", "block", "release", "deadline", "slot", "in_mix")
    return _scheduled(docs, weights, source, block_docs).select(F.nullif("id", F.lit(NULL_ID)).alias("doc_id"), *columns)


def _scheduled(docs: DataFrame, weights: dict[str, float], source: str, block_docs: int) -> DataFrame:
    """``schedule`` with the keys ``id`` and ``h`` of the documents."""
    spark = docs.sparkSession
    numbered = written(_numbered(docs, source), "numbered")
    # One number per source.
    counts = {row[0]: row[1] for row in numbered.groupBy("source").agg(F.max("place") + 1).collect()}
    if missing := sorted(set(counts) - set(weights)):
        raise ValueError(f"no weight for sources {missing[:5]}")
    # The mix holds the target weights up to where the first source would run out.
    total = sum(Fraction(w) for w in weights.values())
    held = min((Fraction(counts.get(s, 0)) * total / Fraction(w) for s, w in weights.items()), default=Fraction(0))
    limits = [(s, ceil(held * Fraction(w) / total - Fraction(1, 10**6))) for s, w in weights.items()]
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    slots = block_slots(spark, whole_parts(weights) if weights else {}, blocks)
    limited = sized_join(numbered, spark.createDataFrame(limits, "source string, limit long"), ["source"], "inner")
    # A block has a few documents, so no key is hot. The slots grow with the documents, which Spark cannot tell from a
    # range of segments, so they are kept from being broadcast.
    blocked = limited.withColumn("block", F.floor(F.col("place") / block_docs).cast("long"))
    placed = blocked.join(slots.hint("merge"), ["source", "block"])
    return placed.select(
        "id", "h", "source", "block", "release", "deadline", "slot", (F.col("place") < F.col("limit")).alias("in_mix")
    )


def mix(docs: DataFrame, weights: dict[str, float], source: str = "source", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The rows of ``docs`` that are in the mix, with their columns.

    Cut at one ``doc_id`` per source, the last one in the mix; rows that share it are all kept.
    """
    last = (
        schedule(docs, weights, source, block_docs)
        .filter("in_mix")
        .groupBy("source")
        .agg(F.max(F.coalesce("doc_id", F.lit(NULL_ID))).alias("__last"))
        .withColumnRenamed("source", "__source")
    )
    named = docs.withColumn("__source", F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)))
    kept = sized_join(named, written(last, "cut"), ["__source"], "inner").filter(id_key() <= F.col("__last"))
    return kept.select(*docs.columns)


def in_order(
    docs: DataFrame, weights: dict[str, float], source: str = "source", block_docs: int = BLOCK_DOCS, name: str = "mix_slot"
) -> DataFrame:
    """All rows of ``docs`` with the slot of their block as the column ``name``: the order of the mix.

    Once a source has run out the others share its slots by their weights, so nothing is lost. Repeated rows get the slot of
    the first of them. A column of ``docs`` that has that name already gives way to the slot.
    """
    docs = docs.drop(name)
    if not weights and docs.isEmpty():
        return docs.withColumn(name, F.lit(0).cast("long"))
    slots = _scheduled(docs, weights, source, block_docs).groupBy("id", "h", "source").agg(F.min("slot").alias(name))
    keyed, keys = with_keys(docs)
    (key,) = free_names(keyed, "source_key")
    renamed = dict(zip(("id", "h", "source"), (*keys, key)))
    slots = written(slots.withColumnsRenamed(renamed), "slots")
    keyed = keyed.withColumn(key, F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)))
    return keyed.join(slots, [*keys, key]).select(*own_columns(docs), name)
