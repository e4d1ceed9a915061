"""The Merkle manifest against a tree built by hand, on small tables with awkward rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
ROWS = [(i, "hot", "en", 3 * i, f"Text {i} Ä") for i in range(300)]
ROWS += [(1000 + i, f"s{i % 5}", None, None, f"T{i}") for i in range(40)]
ROWS += [
    (None, "hot", "en", 1, "No id"),
    (None, None, None, None, None),
    (5, "hot", "en", 15, "Text 5 Ä"),  # a repeated row
    (6, "hot", "en", 15, "another text under one id"),
    (2000, "", "en", 0, ""),
    (2001, None, "en", 0, "A"),
    (2002, "ünï", "x", 7, "LONG " * 30000),
    (2003, "alone", "en", 1, "B"),
]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(level, fanout):
    """Root, and per first place the (before, after) texts on the way up."""
    paths = {i: [] for i in range(len(level))}
    at = {i: i for i in paths}
    while len(level) > 1:
        for i, place in at.items():
            first = place // fanout * fanout
            run = level[first : first + fanout]
            paths[i].append(("".join(run[: place - first]), "".join(run[place - first + 1 :])))
            at[i] = place // fanout
        level = [h(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
    return level[0], paths


def low(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def expected(rows, fanout):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        ordered = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = (ordered, *climb([leaf(r) for r in ordered], fanout))
    root, crown = climb([trees[name][1] for name in names], fanout)
    want = Counter()
    for k, name in enumerate(names):
        ordered, subroot, paths = trees[name]
        for i, row in enumerate(ordered):
            path = paths[i] + crown[k]
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            now = leaf((*row[:4], low(row[4]))) if hit else leaf(row)
            for before, after in path:
                now = h(before, now, after)
            proof = h(*(a + b for a, b in path))
            want[row[0], leaf(row), subroot, root, proof, now, now == root] += 1
    return want


@pytest.mark.parametrize("fanout", [16, 3])
def test_manifest_equals_a_tree_built_by_hand(spark, fanout):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    for name in ("id", "h", "n", "place", "tree", "path", "now", "root", "run_range", "right_tree", "copy"):
        docs = docs.withColumn(name, F.lit("x"))
    got = Counter(tuple(r) for r in merkle.check_tampered(docs, fanout).collect())
    want = expected(ROWS, fanout)
    assert got == want
    assert 0 < sum(n for r, n in got.items() if not r[-1]) < len(ROWS) / 2


@pytest.mark.parametrize("count", [0, 1, 2, 16, 17])
def test_small_tables(spark, count):
    rows = ROWS[:count]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = Counter(tuple(r) for r in merkle.check_tampered(docs).collect())
    assert got == (expected(rows, 16) if rows else Counter())


def test_paths_are_proofs(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for row in merkle.manifest(docs).filter("doc_id % 7 = 0").collect():
        now = row.leaf
        for before, after in row.path:
            now = h(before, now, after)
        assert now == row.root and row.verified


def test_numbering_over_many_ranges(spark):
    rows = [(g, i // 3) for g in ("a", "b", None) for i in range(200)]
    frame = spark.createDataFrame(rows, "g string, v int").repartition(7)
    found = merkle.numbered(frame, ["g"], ["v"]).collect()
    for g in ("a", "b", None):
        mine = sorted((r for r in found if r.g == g), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(200)) and {r.n for r in mine} == {200}
        assert [r.v for r in mine] == [i // 3 for i in range(200)]
