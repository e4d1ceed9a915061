"""Document fingerprints by homomorphic multiset hashing.

Every paragraph (a stretch between line feeds) is hashed to a wide vector, and a document's fingerprint is the
sum of its paragraphs' vectors modulo powers of two. So the order of paragraphs does not matter, two documents
with the same multiset of paragraphs are equal, and inserting or deleting a paragraph adds or
subtracts its vector without reading the rest.

A vector has two parts. Four 64-bit numbers are a cryptographic hash of the paragraph, summed modulo 2**64:
they decide equality. 128 numbers modulo 2**16 count, for hashed signs, the paragraph's runs of one to
three words: the difference of two such sums estimates how many runs the documents do not share, which
gives a likeness from 0 to 1.

For neighbours in ``doc_id`` order texts are dealt to ranges of ``doc_id`` that follow its quantiles; the first
document of each range also goes to the range before, so every document meets the next one in its own task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, id_key, partitions, prepare, slices, split_ids, whole_text, with_range
from tidemark.llm.words import grams, mix, split, text_bytes

LANES = 128
RUNS = 3
RANGES_PER_PARTITION = 4
#: Runs are counted by this many at once, a power of two below 256, and so many blocks of them in one go.
BLOCK = 16
BLOCKS = 2048
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


class Fingerprint:
    """A sum of paragraph vectors; supports ``+`` and ``-``. With a row for each text, the sums of many texts."""

    __slots__ = ("equal", "signs")

    def __init__(self, equal: np.ndarray | None = None, signs: np.ndarray | None = None) -> None:
        self.equal = np.zeros(4, np.uint64) if equal is None else equal
        self.signs = np.zeros(LANES, np.uint16) if signs is None else signs

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal + other.equal, self.signs + other.signs)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal - other.equal, self.signs - other.signs)

    def __getitem__(self, rows: int | slice | np.ndarray) -> Fingerprint:
        return Fingerprint(self.equal[rows], self.signs[rows])

    def hex(self) -> str:
        return self.equal.astype("<u8").tobytes().hex() + self.signs.astype("<u2").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints, about 0 for documents that share nothing."""
        return float(self.likenesses(other))

    def likenesses(self, other: Fingerprint) -> np.ndarray:
        """``likeness`` row by row."""
        apart = _length(self.signs - other.signs)
        both = _length(self.signs) + _length(other.signs)
        near = np.where(both > 0, np.clip(1.0 - apart / np.maximum(both, 1.0), 0.0, 1.0), 0.0)
        return np.where((self.equal == other.equal).all(axis=-1), 1.0, near)


def _length(signs: np.ndarray) -> np.ndarray:
    """The squared length of each row, exactly."""
    return (signs.view(np.int16).astype(np.float64) ** 2).sum(axis=-1)


def fingerprints(texts: list[str]) -> list[Fingerprint]:
    """Of each text: the sum over its paragraphs. An empty text has none."""
    sums = _sums(texts)
    return [sums[i] for i in range(len(texts))]


def _sums(texts: list[str]) -> Fingerprint:
    """The fingerprints of all texts, one in each row."""
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    # Words never span a line feed but runs of words could: a paragraph is a text of its own.
    feeds = np.flatnonzero(data == 0x0A)
    edges = np.unique(np.concatenate([offsets, feeds + 1]))
    words = split(data, edges)
    hashes = words.hashes()
    begin, end = words.first[:-1], words.first[1:]
    paragraph = np.searchsorted(edges, offsets)
    signs = np.zeros((len(texts), LANES), np.uint16)
    for n in range(1, RUNS + 1):
        # Run i begins at word i. Where none does, and after the last word, zeros stand for it and add nothing.
        values = grams(hashes, n)
        runs = np.zeros((2, len(hashes) + 1), np.uint64)
        runs[0, : len(values)] = values
        runs[1] = mix(runs[0] + np.uint64(n))
        for k in range(1, n):
            runs[:, (end - k)[end - k >= begin]] = 0
        runs[:, -1] = 0
        ones = _ones(runs, words.first[paragraph])
        totals = np.concatenate([[0], np.cumsum(np.maximum(end - begin - n + 1, 0))])[paragraph]
        signs += ones + ones - np.diff(totals).astype(np.uint16)[:, None]
    parts = [data[a:b].tobytes().split(b"\n") if b > a else [] for a, b in zip(offsets[:-1], offsets[1:])]
    digests = b"".join([blake2b(p, digest_size=32).digest() for of_text in parts for p in of_text])
    running = np.zeros((len(digests) // 32 + 1, 4), np.uint64)
    np.cumsum(np.frombuffer(digests, "<u8").reshape(-1, 4), axis=0, out=running[1:])
    last = np.cumsum([0, *map(len, parts)])
    return Fingerprint(np.diff(running[last], axis=0), signs)


def _ones(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of the numbers ``first[t]`` to ``first[t + 1]`` have each bit set, for each text t, modulo 2**16.

    ``values`` has two 64-bit numbers in each column, and zeros in the last one. Columns are added up bit by bit
    in blocks: plane p of a block holds bit p of all its counts.
    """
    blocks = -(-np.diff(first) // BLOCK)
    text = np.repeat(np.arange(len(blocks)), blocks)
    start = first[text] + BLOCK * (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    counts = np.zeros((len(blocks), LANES), np.uint16)
    for a in range(0, len(text), BLOCKS):
        owner = text[a : a + BLOCKS]
        columns = start[a : a + BLOCKS] + np.arange(BLOCK)[:, None]
        columns[columns >= first[owner + 1]] = values.shape[1] - 1
        planes = [values.take(columns, axis=1)]
        while (half := planes[0].shape[1] // 2):
            planes = _plus([p[:, :half] for p in planes], [p[:, half:] for p in planes])
        found = np.zeros((len(owner), LANES), np.uint8)
        for p, plane in enumerate(planes):
            found += np.unpackbits(plane[:, 0].T.astype("<u8", order="C").view(np.uint8), axis=1) << np.uint8(p)
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        counts[owner[begins]] += np.add.reduceat(found.astype(np.uint16), begins, axis=0)
    return counts


def _plus(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of numbers whose bits p are those of ``a[p]`` and ``b[p]``, in one more plane."""
    total, carry = [a[0] ^ b[0]], a[0] & b[0]
    for x, y in zip(a[1:], b[1:]):
        one = x ^ y
        total.append(one ^ carry)
        carry = (x & y) | (one & carry)
    return [*total, carry]


def edited_text(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _change(text: str, edited: str, cut: int) -> tuple[str, str]:
    """The paragraphs an edit of the last ``cut`` characters takes out, and those it puts in, as texts."""
    begin = text.rfind("\n", 0, len(text) - cut) + 1
    if begin and begin == len(edited):
        # What is left ends with a line feed, and so with an empty paragraph, which an empty text has not.
        begin = text.rfind("\n", 0, begin - 1) + 1
    if begin == 1:
        begin = 0  # the empty paragraph before it, by itself, would be an empty text
    return text[begin:], edited[begin:]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document of a range with the text that follows it; the first row of the next range closes it."""
    held: list[tuple] = []  # (range, doc_id, text, whether it is the next range's)
    for batch in slices(batches, "text"):
        held += zip(*(batch.column(c).to_pylist() for c in ("range", "id", "text", "next")))
        yield from _compare(held)
        held = held[-1:]


def _compare(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    todo = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[3]]
    if not todo:
        return
    edits, texts = [], []
    for a, b in todo:
        edited = edited_text(a[2], b[2])
        out, put = _change(a[2], edited, len(a[2]) // 4)
        edits.append(edited)
        # The paragraphs that the edit leaves are read once, for the text and for the edited text.
        texts += [a[2][: max(0, len(a[2]) - len(out) - 1)], out, put]
    known = np.array([b is c for (_, b), (c, _) in zip(todo, todo[1:])] + [False])
    prints = _sums([*texts, *(b[2] for (_, b), k in zip(todo, known) if not k)])
    left, removed, added = (prints[k : len(texts) : 3] for k in range(3))
    own, other, rest = left + removed, left + added, prints[len(texts) :]
    place = np.arange(1, len(todo) + 1)
    place[~known] = len(todo) + np.arange(len(rest.equal))
    following = Fingerprint(np.concatenate([own.equal, rest.equal]), np.concatenate([own.signs, rest.signs]))[place]
    columns = [
        [None if a[1] == NULL_ID else a[1] for a, _ in todo],
        [len(a[2]) for a, _ in todo],
        [sha256(edited.encode()).hexdigest() for edited in edits],
        [own[i].hex() for i in range(len(todo))],
        [other[i].hex() for i in range(len(todo))],
        own.likenesses(other),
        own.likenesses(following),
    ]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next text.

    The edited text has the last quarter of the characters replaced by as many of the next document's
    first ones (or all it has), the next being that with the next larger ``doc_id``, after the last the first. Its
    fingerprint is the text's without the paragraphs taken out and with those put in. Null texts are
    empty; a null ``doc_id`` comes first; rows with one ``doc_id`` follow each other by text. A lone document
    is its own next.
    """
    spark = docs.sparkSession
    prepare(spark)
    count = partitions(spark)
    points = split_ids(docs.select(id_key().alias("id")), "id", RANGES_PER_PARTITION * count)
    keyed = with_range(docs.select(id_key().alias("id"), whole_text().alias("text")), "id", points, "range")
    # One row per range, at most RANGES_PER_PARTITION times the shuffle's partitions.
    heads = sorted(
        with_range(docs.select(id_key().alias("id")), "id", points, "range").groupBy("range").agg(F.min("id")).collect()
    )
    before = {first: heads[i - 1][0] for i, (_, first) in enumerate(heads)}
    copies = F.array(F.struct("range", F.lit(False).alias("next")))
    if before:
        earlier = spark.createDataFrame(list(before.items()), "id long, earlier int")
        keyed = keyed.join(F.broadcast(earlier), "id", "left")
        twice = F.array(
            F.struct("range", F.lit(False).alias("next")), F.struct(F.col("earlier").alias("range"), F.lit(True).alias("next"))
        )
        copies = F.when(F.col("earlier").isNull(), copies).otherwise(twice)
        keyed = keyed.select("id", "text", copies.alias("copies")).select("id", "text", F.inline("copies"))
    else:
        keyed = keyed.select("id", "text", "range", F.lit(False).alias("next"))
    return (
        keyed.repartition(count, "range")
        .sortWithinPartitions("range", "next", "id", "text")
        .select("range", "id", "text", "next")
        .mapInArrow(_pairs, RESULT)
    )
