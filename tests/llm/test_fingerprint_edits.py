"""Incremental fingerprints equal those of whole texts, wherever an edit meets a line feed."""

from itertools import product

from tidemark.llm import multiset


def test_every_cut_around_line_feeds():
    texts = ["".join(letters) for n in range(9) for letters in product("a\n", repeat=n)]
    for following in ("", "b", "\n", "b\nc", "\n\n\n"):
        edits = [multiset.edited_text(text, following) for text in texts]
        changes = [multiset._change(text, edited, len(text) // 4) for text, edited in zip(texts, edits)]
        whole, want = multiset.fingerprints(texts), multiset.fingerprints(edits)
        out = multiset.fingerprints([c[0] for c in changes])
        put = multiset.fingerprints([c[1] for c in changes])
        for text, mine, removed, added, other in zip(texts, whole, out, put, want):
            assert (mine - removed + added).hex() == other.hex(), (text, following)
