"""The filter audit against every order applied to every document."""

import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from tidemark.llm import audit
from tidemark.llm.words import pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def fails(row, rows):
    doc_id, text, _ = row
    words = WORD.findall(text or "")
    points = text or ""
    key = (doc_id is not None, doc_id or 0)
    smaller = any((t or "") == points and (d is not None, d or 0) < key for d, t, _ in rows)
    found = ""
    found += "A" if len(words) < 100 else ""
    found += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    found += "C" if 100 * len(re.findall("[A-Z]", points)) > 10 * len(points) else ""
    found += "D" if re.search("[#$%&*|]", points) else ""
    return found + ("E" if smaller else "")


def expected(rows, labels):
    failed = [(row, fails(row, rows)) for row in rows]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    want, shapley = {}, Counter()
    for part in {row[2] or "" for row in rows}:
        mine = [(row[0], f) for row, f in failed if (row[2] or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [(d, f) for d, f in left if name in f]
                left = [(d, f) for d, f in left if name not in f]
                shapley[part, name] += len(gone)
                want[part, "".join(order), step] = (
                    len(left),
                    len(gone),
                    sum(name in f for _, f in mine) - len(gone),
                    sum(f == name for _, f in mine),
                    sum(d in good for d, _ in gone),
                    sum(d in toxic for d, _ in gone),
                )
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def table():
    rng = random.Random(11)
    rows = [(None, "x", "en"), (None, "x", "de"), (None, None, None), (3, "", ""), (3, "", ""), (4, "", "fr"), (4, "w", "fr")]
    for i in range(160):
        vocabulary = rng.choice([40, 150, 400])
        words = [rng.choice(["w", "W", "é", "Ü"]) + str(rng.randrange(vocabulary)) for _ in range(rng.choice([20, 99, 100, 140]))]
        if rng.random() < 0.2:
            words.append(rng.choice(["#", "a&b", "|", "~"]))
        rows.append((10 + i, rng.choice([" ", "\n", " \t"]).join(words), rng.choice(["en", "de", None])))
    rows += [(rng.randrange(400), rows[rng.randrange(len(rows))][1], "en") for _ in range(60)]
    rows += [(500 + i, "one copy of many " * 30, "en") for i in range(50)]
    rows.append((900, "A b " * 60000, "de"))
    labels = [(rng.randrange(500), rng.randrange(2), rng.randrange(2)) for _ in range(300)]
    return rows, [*labels, (None, 1, 1), (10, None, None), (999, 1, 1)]


def test_audit_equals_every_order_applied(spark):
    rows, labels = table()
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    for name in ("id", "part", "fails", "n", "salt", "digest", "rows", "good", "toxic", "quality"):
        docs = docs.withColumn(name, F.lit("x"))
    got = audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    want = expected(rows, labels)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.audit(docs, labels).count() == 0
    one = audit.audit(spark.createDataFrame([(1, None, None)], DOCS), labels)
    assert one.count() == 600 and one.agg(F.sum("removed")).first()[0] == 120
    assert {r.shapley for r in one.select("shapley").distinct().collect()} == {0, 120}


def test_potentials_give_shapley_values(spark):
    rng = random.Random(2)
    worth = [0] + [rng.randrange(1000) for _ in range(31)]
    frame = spark.createDataFrame([(worth,)], "w array<long>")
    potential = frame.select(audit.potentials(F.col("w"), 5)).first()[0]
    for i in range(5):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += worth[before | 1 << i] - worth[before]
        assert potential[31] - potential[31 ^ 1 << i] == total


def test_pieces_cut_at_white_space():
    raw = b"ab cd\tef\x0bgh\xc3\xa9 \n  ij" * 50
    for most in (1, 2, 7, 64):
        parts = list(pieces(raw, most))
        assert b"".join(parts) == raw and [w for p in parts for w in p.split()] == raw.split()
    assert list(pieces(b"")) == [b""]
