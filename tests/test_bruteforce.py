"""Range questions beside a plain loop over the same events."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from tests.helpers import records, rows
from tidemark.operators import distinct, frequency, values, windows

SLIDE = timedelta(hours=6)
OFFSET = timedelta(hours=1)
START = datetime(2013, 5, 9)
EPOCH = datetime(1970, 1, 1)
MS = 3_600_000


def label(moment):
    return moment.strftime("%Y%m%dT%H%M%S")


def window_of(ts):
    start = ts - (ts - EPOCH - OFFSET) % SLIDE
    return start, start + SLIDE


def chosen(events, begin, end, as_of, by):
    for key, ts, attributes in events:
        start, stop = window_of(ts)
        name = start if by == "start" else stop
        if as_of is None:
            taken = begin <= name <= end
        elif ts > as_of:
            taken = False
        elif stop <= as_of:
            taken = begin <= name <= end
        else:
            taken = begin <= as_of <= end
        if taken:
            yield key, ts, attributes, start


@pytest.fixture(scope="module")
def events():
    rng = random.Random(23)
    made = []
    for n in range(600):
        # Quarter hours, so that events fall on window bounds too; one key has a third of them.
        ts = START + timedelta(minutes=15 * rng.randrange(4 * 72))
        key = "hot" if rng.random() < 1 / 3 else f"k{rng.randrange(25)}"
        made.append((key, ts, {"n": str(n)} if rng.random() < 0.5 else None))
    return made


@pytest.mark.parametrize("seed", range(6))
def test_ranges_equal_the_loop(spark, events, seed):
    rng = random.Random(seed)
    begin = START + timedelta(hours=rng.randrange(0, 40))
    end = begin + timedelta(hours=rng.randrange(0, 40))
    as_of = rng.choice([None, begin - timedelta(hours=2), begin + (end - begin) / 2, end])
    as_of = as_of and as_of.replace(minute=0)
    by = rng.choice(["start", "end"])
    want = list(chosen(events, begin, end, as_of, by))

    rec = records(spark, [(k, str(ts), a) for k, ts, a in events])
    place = (label(begin), label(end), as_of and label(as_of), by, 6 * MS, MS)
    found = windows.select_range(rec, *place).cache()

    counts = Counter(key for key, *_ in want)
    assert rows(frequency.total_counts(found), "key", "n") == sorted(counts.items())
    best = sorted(counts.items(), key=lambda item: (-item[1], item[0]))[:5]
    assert [tuple(r) for r in frequency.top_keys_of_stream(found, 5).select("key", "n").collect()] == best
    assert rows(distinct.distinct_keys(found), "n_distinct") == ([(len(counts),)] if counts else [])

    newest = {}
    for order, (key, ts, attributes, start) in enumerate(want):
        if attributes is None:
            continue
        rank = (-start.timestamp(), ts, order)
        if key not in newest or rank < newest[key][0]:
            newest[key] = (rank, attributes)
    listed = values.values_with_counts(found).collect()
    assert {r["key"]: (r["values"], r["n"]) for r in listed} == {
        key: (attributes, counts[key]) for key, (_, attributes) in newest.items()
    }

    per_window = {}
    for key, _, _, start in want:
        per_window.setdefault(start, Counter())[key] += 1
    heads = Counter()
    for counter in per_window.values():
        for key, n in sorted(counter.items(), key=lambda item: (-item[1], item[0]))[:4]:
            heads[key] += n
    merged = sorted(heads.items(), key=lambda item: (-item[1], item[0]))[:3]
    truncated = frequency.top_keys_truncated(frequency.key_counts(found), 3)
    assert [row[1:] for row in rows(truncated, "rk", "key", "n")] == merged
    found.unpersist()
