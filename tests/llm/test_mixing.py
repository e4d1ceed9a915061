"""The schedule in segments beside earliest deadline first from end to end, with exact fractions."""

import heapq
import random
from fractions import Fraction
from math import ceil, floor

import pytest

from tidemark.llm import mixing


def fluid(parts, blocks):
    """A function: blocks that the fluid has given each source after so many slots."""
    order = sorted(blocks, key=lambda s: Fraction(blocks[s], parts[s]))

    def given(slots):
        gone, left = Fraction(0), sum(parts.values())
        for s in order:
            level = (slots - gone) / Fraction(left)
            if level * parts[s] < blocks[s]:
                return {x: min(Fraction(blocks[x]), level * parts[x]) for x in blocks}
            gone, left = gone + blocks[s], left - parts[s]
        return {x: Fraction(blocks[x]) for x in blocks}

    return given


def time_of(parts, blocks, source, block):
    """The time by which the fluid has given a source so many blocks."""
    level = Fraction(block, parts[source])
    return sum(min(level * parts[s], Fraction(blocks[s])) for s in blocks)


def one_heap(parts, blocks):
    """(source, block) by slot: earliest deadline first over all blocks, one slot after the other."""
    waiting = {}
    for i, s in enumerate(sorted(blocks, key=lambda s: (Fraction(blocks[s], parts[s]), s))):
        for j in range(blocks[s]):
            release, end = floor(time_of(parts, blocks, s, j)), ceil(time_of(parts, blocks, s, j + 1))
            waiting.setdefault(release, []).append((end, release, i, j, s))
    ready, order = [], []
    for slot in range(sum(blocks.values())):
        for block in waiting.get(slot, ()):
            heapq.heappush(ready, block)
        *_, j, s = heapq.heappop(ready)
        order.append((s, j))
    return order


def check(rows, parts, blocks):
    assert sorted(r.slot for r in rows) == list(range(sum(blocks.values())))
    assert sorted((r.source, r.block) for r in rows) == sorted((s, j) for s in blocks for j in range(blocks[s]))
    parts = {s: parts[s] for s in blocks}
    given, taken = fluid(parts, blocks), dict.fromkeys(blocks, 0)
    for r in sorted(rows, key=lambda r: r.slot):
        assert r.release == floor(time_of(parts, blocks, r.source, r.block))
        assert r.deadline == ceil(time_of(parts, blocks, r.source, r.block + 1))
        assert r.release <= r.slot < r.deadline
        assert r.block == taken[r.source]
        taken[r.source] += 1
        assert all(abs(taken[s] - x) < 1 for s, x in given(r.slot + 1).items())


CASES = {
    "equal": ({"a": 1, "b": 1, "c": 1}, {"a": 40, "b": 40, "c": 40}),
    "one": ({"a": 7}, {"a": 33}),
    "empty source": ({"a": 2, "b": 3}, {"a": 0, "b": 21}),
    "one hot, many rare": ({"hot": 50} | {f"s{i}": 1 for i in range(50)}, {"hot": 100} | {f"s{i}": 3 for i in range(50)}),
    "heavy pairs": ({"a": 45, "b": 44, "c": 11}, {"a": 90, "b": 95, "c": 9}),
    "far apart": ({"a": 500, "b": 1, "c": 499}, {"a": 50, "b": 1, "c": 50}),
    "thirty": ({f"s{i}": 10 * i * i + 1 for i in range(30)}, {f"s{i}": 1 + i * i // 8 for i in range(30)}),
    "out of proportion": ({"a": 99_999, "b": 1}, {"a": 12, "b": 150}),
}


@pytest.mark.parametrize("case", CASES)
def test_cases(spark, case):
    parts, blocks = CASES[case]
    some = {s: n for s, n in blocks.items() if n}
    for segment in (5, 10_000):
        rows = mixing.block_slots(spark, parts, blocks, segment).collect()
        check(rows, parts, some)
    assert [(r.source, r.block) for r in sorted(rows, key=lambda r: r.slot)] == one_heap(parts, some)


@pytest.mark.parametrize("seed", range(6))
def test_any_weights_in_segments_of_any_length(spark, seed):
    rng = random.Random(seed)
    parts = {f"s{i}": rng.choice([rng.randint(1, 9), rng.randint(1, 1000)]) for i in range(rng.randint(2, 12))}
    blocks = {s: rng.choice([rng.randint(1, 60), 1 + p // 8]) for s, p in parts.items()}
    check(mixing.block_slots(spark, parts, blocks, rng.randint(1, 9)).collect(), parts, blocks)


def test_weights_that_no_short_frame_holds(spark):
    weights = {"a": 0.33333, "b": 0.66662, "c": 0.00005}
    parts = mixing.whole_parts(weights)
    assert all(abs(parts[s] - w * 10**9) <= 1 for s, w in weights.items())
    assert mixing.whole_parts({"x": Fraction(1, 3), "y": Fraction(2, 3)}) == {"x": 1, "y": 2}
    # Five blocks of the rare source: 100,000 slots.
    blocks = {"a": 33_333, "b": 66_662, "c": 5}
    rows = mixing.block_slots(spark, parts, blocks).filter("source = 'c'").collect()
    assert all(r.release <= r.slot < r.deadline for r in rows)
    for j, r in enumerate(sorted(rows, key=lambda r: r.slot)):
        assert r.block == j and abs(j + 1 - (r.slot + 1) * 0.00005) < 1
    with pytest.raises(ValueError):
        mixing.whole_parts({"a": 0.0})


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.schedule(empty, {"a": 1.0}).count() == 0
    assert mixing.schedule(empty, {}).count() == 0
    assert mixing.in_order(empty, {}).columns == ["doc_id", "source", "text", "mix_slot"]
