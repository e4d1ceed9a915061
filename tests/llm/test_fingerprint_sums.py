"""Fingerprints of many texts at once: exact sums, kept paragraphs read once, working memory that follows the words."""

import random
import tracemalloc
from time import process_time

import numpy as np
import pyarrow as pa

from tidemark.llm import multiset, words


def plain_signs(text):
    """Each run of one to three words of each paragraph adds 1 or -1 to every lane."""
    sums = np.zeros(multiset.LANES, np.int64)
    for paragraph in text.encode().split(b"\n"):
        found = words.split(*words.text_bytes(pa.array([paragraph.decode()], pa.large_string())))
        for n in range(1, multiset.RUNS + 1):
            for value in words.grams(found.hashes(), n):
                pair = np.array([value, words.mix(np.array([value + np.uint64(n)]))[0]])
                sums += 2 * np.unpackbits(pair.astype("<u8").view(np.uint8)).astype(np.int64) - 1
    return (sums & 0xFFFF).astype(np.uint16)


def _batch(texts):
    columns = [[0] * len(texts), list(range(len(texts))), texts, [False] * len(texts)]
    types = [pa.int32(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["range", "id", "text", "next"])


def test_sums_equal_plain_ones_around_whole_blocks():
    rng = random.Random(4)
    sizes = [0, 1, 2, 3, 4, *(n + d for n in (multiset.BLOCK, 2 * multiset.BLOCK) for d in range(-1, 4))]
    texts = [" ".join(rng.choice(["a", "é", "日本", f"w{i}"]) for i in range(n)) for n in sizes]
    texts += ["same " * 40, "\n", "\n\n", " \n\t", "a\nb c\n\nd e f\n", "a b c\n" * 20, "a\n" * 33]
    for got, text in zip(multiset.fingerprints(texts), texts):
        assert got.signs.tolist() == plain_signs(text).tolist(), text
    assert multiset.fingerprints([]) == []


def test_counts_go_on_from_one_lot_of_blocks_to_the_next(monkeypatch):
    texts = ["x " * 500, "", "a b", " ".join(map(str, range(700))), "z"]
    want = [f.hex() for f in multiset.fingerprints(texts)]
    monkeypatch.setattr(multiset, "BLOCKS", 3)
    assert [f.hex() for f in multiset.fingerprints(texts)] == want


def test_rows_equal_those_of_single_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab\n é", k=rng.randrange(30))) for _ in range(400)] + ["\n", "\na", "", "a\n"]
    got = pa.Table.from_batches(multiset._pairs(iter([_batch(texts)]))).to_pylist()
    assert len(got) == len(texts) - 1
    for row, text, after in zip(got, texts, texts[1:]):
        mine, other, following = multiset.fingerprints([text, multiset.edited_text(text, after), after])
        assert (row["fingerprint"], row["edited_fingerprint"]) == (mine.hex(), other.hex())
        assert (row["near_edited"], row["near_next"]) == (mine.likeness(other), mine.likeness(following))


def test_paragraphs_an_edit_keeps_are_read_once(monkeypatch):
    read = []
    monkeypatch.setattr(multiset, "split", lambda data, edges: read.append(len(data)) or words.split(data, edges))
    texts = ["some words here\n" * 100 for _ in range(50)]
    list(multiset._pairs(iter([_batch(texts)])))
    # Each text, and of each edited one the quarter put in and the paragraph around the cut.
    assert sum(read) < 1.3 * sum(map(len, texts))


def test_memory_and_time_follow_the_words():
    text = " ".join(f"w{i % 977}" for i in range(200_000))
    multiset.fingerprints([text])
    tracemalloc.start()
    multiset.fingerprints([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # A byte for each bit of the runs is 25 MB for each length; so counted they once took 142 MB, now 19 MB.
    assert peak < 50_000_000

    def seconds(work):
        times = []
        for _ in range(3):
            begun = process_time()
            work()
            times.append(process_time() - begun)
        return min(times)

    def hashed():
        hashes = words.split(*words.text_bytes(pa.array([text], pa.large_string()))).hashes()
        for n in range(1, multiset.RUNS + 1):
            words.mix(words.grams(hashes, n))

    assert seconds(lambda: multiset.fingerprints([text])) < 10 * seconds(hashed)
