"""Substring deduplication: remove every word covered by a window of words that occurs earlier.

Method: super-k-mer partitioning. A window of ``width`` words has a minimiser, the least hash among
its runs of ``gram`` words. Consecutive windows with one minimiser overlap in all but one word each,
so they travel as one packed string, a super-k-mer, to the bucket of that minimiser. Equal windows
have equal minimisers and so meet in one bucket, where sorting them finds every window's first
occurrence exactly: hashes only order the windows, and equal hashes are confirmed on the words.

Skew: each map batch sends only the first of its occurrences of a window and flags the others
itself. A passage that fills a third of all rows is one super-k-mer per batch after that, and a bucket
keeps, besides the super-k-mers just read, only its distinct windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_key, partitions, prepare, row_key, slices, whole_text
from tidemark.llm.words import (
    Words,
    gram_places,
    grams,
    mix,
    sliding_min,
    spaced,
    split,
    text_bytes,
)

WIDTH = 20
GRAM = 4
BUCKETS_PER_PARTITION = 12
#: A bucket is sorted whenever so many new bytes, or as many as it keeps, have come in.
SORT_BYTES = 4 << 20

PACKED = "bucket int, flags boolean, blob binary"
FLAGS = "id long, h long, runs binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


@dataclass
class Runs:
    """Stretches of consecutive words: their document, first word and number of words."""

    id: np.ndarray
    h: np.ndarray
    start: np.ndarray
    n: np.ndarray

    def take(self, rows: np.ndarray) -> Runs:
        return Runs(self.id[rows], self.h[rows], self.start[rows], self.n[rows])


def _later_windows(words: Words, runs: Runs, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of ``runs``: its run, its offset there, and whether it also starts earlier."""
    run, offset = gram_places(runs.n, width)
    first = words.first[run] + offset
    value = grams(words.hashes(), width)[first]
    later = np.zeros(len(run), bool)
    if not len(run):
        return run, offset, later
    ids, hs, starts = runs.id[run], runs.h[run], runs.start[run] + offset
    data = words.data.tobytes()
    at, to = words.start[first], words.end[first + width - 1]
    while True:
        order = np.argsort(value, kind="stable")
        same = value[order][1:] == value[order][:-1]
        groups = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        rows = order[groups]  # windows whose hash is not alone
        rows = rows[np.lexsort((starts[rows], hs[rows], ids[rows], value[rows]))]
        new = np.ones(len(rows), bool)
        new[1:] = value[rows][1:] != value[rows][:-1]
        leader = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))] if len(rows) else rows
        other = [
            r for r, a, b, c, d in zip(
                rows.tolist(), at[rows].tolist(), to[rows].tolist(), at[leader].tolist(), to[leader].tolist()
            ) if a != c and data[a:b] != data[c:d]
        ]
        if not other:
            break
        for r in other:  # one hash for two windows: tell them apart by a longer one and sort again
            digest = blake2b(data[at[r] : to[r]], digest_size=8).digest()
            value[r] = np.frombuffer(digest, np.uint64)[0]
    later[rows] = (ids[rows] != ids[leader]) | (hs[rows] != hs[leader]) | (starts[rows] != starts[leader])
    return run, offset, later


def _stretches(keys: list[np.ndarray], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions and lengths of runs of kept entries with equal keys, entries being neighbours."""
    if not keep.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.ones(len(keep) + 1, bool)
    cut[1:-1] = keep[1:] != keep[:-1]
    for key in keys:
        cut[1:-1] |= key[1:] != key[:-1]
    edges = np.flatnonzero(cut)
    first, length = edges[:-1], np.diff(edges)
    kept = keep[first]
    return first[kept], length[kept]


def _pack(runs: Runs, texts: list[bytes]) -> bytes:
    long = np.stack([runs.id, runs.h]).astype("<i8")
    short = np.stack([runs.start, runs.n, np.fromiter(map(len, texts), np.int64, len(texts))]).astype("<i4")
    parts = [np.int64(len(texts)).tobytes(), long.tobytes(), short.tobytes(), *texts]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpack(blob: bytes) -> tuple[Runs, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    long = np.frombuffer(raw, "<i8", 2 * count, 8).reshape(2, count)
    short = np.frombuffer(raw, "<i4", 3 * count, 8 + 16 * count).reshape(3, count).astype(np.int64)
    return Runs(long[0], long[1], short[0], short[1]), short[2], np.frombuffer(raw, np.uint8, offset=8 + 28 * count)


def _flag_rows(ids: np.ndarray, hs: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[tuple]:
    """One row per document with its stretches of flagged words as pairs of first word and length."""
    order = np.lexsort((start, hs, ids))
    ids, hs = ids[order], hs[order]
    pairs = np.stack([start[order], n[order]], 1).astype("<i4")
    cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (hs[1:] != hs[:-1])])) if len(ids) else []
    edges = [*cut, len(ids)]
    return [(int(ids[a]), int(hs[a]), pairs[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]


def _super_kmers(batches: Iterator[pa.RecordBatch], width: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``PACKED``: super-k-mers by bucket, and what the batch itself finds repeated."""
    schema = pa.schema([("bucket", pa.int32()), ("flags", pa.bool_()), ("blob", pa.binary())])
    spread = 0
    for batch in slices(batches, "text"):
        words = spaced(split(*text_bytes(batch.column("text"))))
        runs = Runs(
            batch.column("id").to_numpy(zero_copy_only=False),
            batch.column("h").to_numpy(zero_copy_only=False),
            np.zeros(batch.num_rows, np.int64),
            words.counts,
        )
        run, offset, later = _later_windows(words, runs, width)
        if not len(run):
            continue
        least = sliding_min(grams(words.hashes(), gram), width - gram + 1)[words.first[run] + offset]
        at, n = _stretches([run], later)
        rows = _flag_rows(runs.id[run[at]], runs.h[run[at]], offset[at], n + width - 1)
        out: list[tuple] = []
        if rows:
            spread += 1
            flags = pa.table({"id": [r[0] for r in rows], "h": [r[1] for r in rows], "runs": pa.array([r[2] for r in rows], pa.binary())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, flags.schema) as writer:
                writer.write_table(flags)
            spot = int((int(least[0]) + spread) % buckets)
            out.append((spot, True, zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())))
        at, n = _stretches([run, least], ~later)
        bucket = (mix(least[at]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at, n, bucket = at[order], n[order] + width - 1, bucket[order]
        kmers = Runs(runs.id[run[at]], runs.h[run[at]], offset[at], n)
        first = words.first[run[at]] + offset[at]
        raw = words.data.tobytes()
        texts = [raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first + n - 1].tolist())]
        edges = [*np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket)] if len(bucket) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            out.append((int(bucket[a]), False, _pack(kmers.take(slice(a, b)), texts[a:b])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], schema.field(i).type) for i in range(3)], schema=schema
        )


class _Bucket:
    """Sorts the windows of one bucket as they come; keeps each distinct window's first occurrence."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.parts: list[tuple[Runs, np.ndarray, np.ndarray]] = []
        self.new = self.kept = 0

    def add(self, blob: bytes) -> list[tuple]:
        self.parts.append(_unpack(blob))
        self.new += len(self.parts[-1][2])
        return self.sort() if self.new >= max(SORT_BYTES, self.kept) else []

    def sort(self) -> list[tuple]:
        if not self.parts:
            return []
        runs = Runs(*(np.concatenate([getattr(p[0], f) for p in self.parts]) for f in ("id", "h", "start", "n")))
        lengths = np.concatenate([p[1] for p in self.parts])
        data = np.concatenate([p[2] for p in self.parts])
        words = split(data, np.concatenate([[0], np.cumsum(lengths)]))
        run, offset, later = _later_windows(words, runs, self.width)
        at, n = _stretches([run], later)
        rows = _flag_rows(runs.id[run[at]], runs.h[run[at]], runs.start[run[at]] + offset[at], n + self.width - 1)
        at, n = _stretches([run], ~later)
        n = n + self.width - 1
        first = words.first[run[at]] + offset[at]
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first + n - 1].tolist())]
        kept = Runs(runs.id[run[at]], runs.h[run[at]], runs.start[run[at]] + offset[at], n)
        joined = np.frombuffer(b"".join(texts), np.uint8)
        self.parts = [(kept, np.fromiter(map(len, texts), np.int64, len(texts)), joined)]
        self.new, self.kept = 0, len(joined)
        return rows


def _flag_batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("runs", pa.binary())])
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], schema.field(i).type) for i in range(3)], schema=schema
    )


def _sorted_buckets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Flags of the buckets of a partition, whose rows come bucket by bucket."""
    current, bucket = None, _Bucket(width)
    for batch in batches:
        for number, flags, blob in zip(*(batch.column(i) for i in range(3))):
            if flags.as_py():
                with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob.as_py())) as reader:
                    yield from reader
                continue
            rows = []
            if number.as_py() != current:
                rows = bucket.sort()
                current, bucket = number.as_py(), _Bucket(width)
            rows += bucket.add(blob.as_py())
            if rows:
                yield _flag_batch(rows)
    if rows := bucket.sort():
        yield _flag_batch(rows)


def _removed(batches: Iterator[pa.RecordBatch], text: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        out: list[tuple] = []
        for doc_id, content, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs"))):
            words = content.encode().split()
            removed = 0
            if runs:
                pairs = np.frombuffer(b"".join(runs), "<i4").reshape(-1, 2)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, pairs[:, 0], 1)
                np.add.at(change, pairs[:, 0] + pairs[:, 1], -1)
                keep = np.cumsum(change[:-1]) == 0
                removed = len(words) - int(keep.sum())
                words = list(compress(words, keep.tolist()))
            kept = b" ".join(words)
            out.append((doc_id, len(words) + removed, removed, sha256(kept).hexdigest(), kept.decode() if text else None))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)


def repeated_windows(docs: DataFrame, key: Column, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Per document (``id``, ``h``) stretches of words covered by windows that also start earlier.

    ``key`` is ``h``, which tells documents with one id apart.

    ``runs`` holds pairs of 32-bit numbers, first word and number of words; a document may have
    several rows, and stretches may overlap.
    """
    spark = docs.sparkSession
    prepare(spark)
    count = partitions(spark)
    buckets = BUCKETS_PER_PARTITION * count
    keyed = docs.select(id_key().alias("id"), key.alias("h"), whole_text().alias("text"))
    return (
        keyed.mapInArrow(lambda it: _super_kmers(it, width, gram, buckets), PACKED)
        .repartition(count, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(lambda it: _sorted_buckets(it, width), FLAGS)
    )


def dedup_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text`` of every document.

    Words are runs of characters other than ASCII white space. Every word covered by a window of
    ``width`` words that also starts earlier, in a smaller ``doc_id`` or earlier in the same document,
    is removed; all windows are judged on the input. ``gram`` is at most ``width``.

    Null texts are empty, texts shorter than a window stay whole. Documents with one ``doc_id`` but
    different texts follow each other in a fixed order; fully repeated rows are one document.
    Columns besides ``doc_id`` and ``text`` are not looked at.
    """
    if not 1 <= gram <= width:
        raise ValueError("gram must be between 1 and width")
    key = row_key(docs)
    flags = repeated_windows(docs, key, width, gram).groupBy("id", "h").agg(F.collect_list("runs").alias("runs"))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), id_key().alias("id"), key.alias("h"), whole_text().alias("text")
    )
    joined = keyed.join(flags, ["id", "h"], "left").select("doc_id", "text", "runs")
    result = joined.mapInArrow(lambda it: _removed(it, keep_text), RESULT)
    return result if keep_text else result.drop("kept_text")
