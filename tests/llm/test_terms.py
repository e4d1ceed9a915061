"""Terms that give entities away: whole words around an entity, over lines, however long."""

import random

import pytest

from tidemark.llm import pii


@pytest.mark.parametrize("seed", range(30))
def test_words_before_are_the_last_whole_words(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("ab") * rng.choice([1, 3, 60, 300]) + rng.choice([" ", "\n", "  \t"]) for _ in range(rng.randrange(40)))
    for near in (1, 3, 8):
        start = rng.randrange(len(text) + 1)
        words = [m.span() for m in pii._WORD.finditer(text, 0, start)]
        assert pii._words_before(text, start, near) == words[-near:]


def test_a_name_above_the_address_gives_it_away(spark):
    long = "x" * 400
    rows = [(i, f"Filler{i} words{i}\nZaphod Quux{i}\n{long}{i} zaphod.b@example.com\nback{i}") for i in range(4)]
    rows += [(i, f"nothing to see here {i}") for i in range(4, 60)] + [(None, None), (60, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(found) == 62
    for i in range(4):
        text = rows[i][1]
        start = text.index("Zaphod")
        assert f"term:{start}:{start + 6}" in found[i].spans.split(",")
        assert pii.sanitise(text, found[i].spans) == f"Filler{i} words{i}\n[TERM] Quux{i}\n{long}{i} [EMAIL]\nback{i}"
    assert all("term" not in found[i].spans for i in [None, *range(4, 61)])
