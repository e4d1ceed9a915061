"""Token ids of a corpus in binary files, in ascending ``doc_id`` order or that of a given column.

Texts are dealt to ranges of that order, several per task, that follow its quantiles, so no
range depends on how much one source holds. A task sorts its ranges, encodes them in order and
writes segments of whole documents in the format of ``pfor``: rows of Parquet files whose ``data`` is a
segment. Spark's writer commits them, so a lost executor leaves nothing half written, and a segment can be
read on its own. Where a document starts in the whole corpus follows from its place in the segment, the
segment's in its range, and the totals of the ranges before, of which there are few.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import encoder
from tidemark.llm.common import NULL_ID, id_key, partitions, prepare, slices, split_ids, whole_text, with_range
from tidemark.llm.pfor import PERCENTILE, decode_segment, encode_segment
from tidemark.llm.words import text_bytes
from tidemark.session import fresh_folder

END_ID = 0
RANGES_PER_PARTITION = 4
SEGMENT_TOKENS = 1 << 18
#: Texts encoded together; the more there are, the fewer pieces are looked up twice.
SLICE_BYTES = 4 << 20
#: The same where workers have little memory: more pieces are looked up twice.
SMALL_SLICE_BYTES = 1 << 20
SEGMENTS = "range int, segment int, first long, tokens long, data binary"
ROWS = "doc_id long, range int, place long, n_tokens long, ids_crc32 long"


def _segments(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int, percentile: int, slice_bytes: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    codes = encoder(path)
    schema = pa.schema(
        [("range", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("tokens", pa.int64()), ("data", pa.binary())]
    )
    current, segment, first = None, 0, 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal segment, first, held
        if held:
            doc_ids, lengths, ids = (np.concatenate(x) for x in zip(*held))
            row = [current, segment, first, len(ids), encode_segment(doc_ids, lengths, ids, percentile)]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)
            segment, first, held = segment + 1, first + len(ids), []

    for batch in slices(batches, "text", slice_bytes):
        numbers = batch.column("range").to_numpy()
        for a, b in zip(*_edges(numbers)):
            if numbers[a] != current:
                yield from flush()
                current, segment, first = int(numbers[a]), 0, 0
            part = batch.slice(a, b - a)
            ids, begin = codes.encode(*text_bytes(part.column("text")))
            lengths = np.diff(begin) + 1
            with_end = np.full(len(ids) + len(lengths), end_id, np.uint32)
            kept = np.ones(len(with_end), bool)
            kept[np.cumsum(lengths) - 1] = False
            with_end[kept] = ids
            held.append((part.column("id").to_numpy(), lengths, with_end))
            if sum(len(x[2]) for x in held) >= SEGMENT_TOKENS:
                yield from flush()
    yield from flush()


def _edges(numbers: np.ndarray) -> tuple[list[int], list[int]]:
    cut = np.flatnonzero(numbers[1:] != numbers[:-1]) + 1
    return [0, *cut.tolist()], [*cut.tolist(), len(numbers)]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, first, data in zip(*(batch.column(c) for c in ("range", "first", "data"))):
            doc_ids, lengths, ids = decode_segment(data.as_py())
            ends = np.cumsum(lengths)
            raw = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids),
                    pa.array(np.full(len(ends), number.as_py(), np.int32)),
                    pa.array(first.as_py() + ends - lengths),
                    pa.array(lengths),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "range", "place", "n_tokens", "ids_crc32"],
            )


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int = END_ID,
    percentile: int = PERCENTILE,
    order: str | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> None:
    """Write the ids of every text, each followed by ``end_id``, to ``folder`` in ``doc_id`` order.

    ``order`` names a column of whole numbers that goes before ``doc_id``; nulls in it come first. A worker encodes about
    ``slice_bytes`` of text at once.

    ``tokenizer`` is the path of a tokenizer file that every worker can read. Null texts are empty and so
    just an end id; a null ``doc_id`` comes first; rows with one ``doc_id`` follow each other by text.
    """
    spark = docs.sparkSession
    prepare(spark)
    count = partitions(spark)
    rank = id_key(order or "doc_id").alias("rank")
    points = split_ids(docs.select(rank), "rank", RANGES_PER_PARTITION * count)
    keyed = with_range(docs.select(rank, id_key().alias("id"), whole_text().alias("text")), "rank", points, "range")
    keyed.repartition(count, "range").sortWithinPartitions("range", "rank", "id", "text").mapInArrow(
        lambda it: _segments(it, tokenizer, end_id, percentile, slice_bytes), SEGMENTS
    ).write.parquet(folder)


def read_tokens(spark, folder: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, decoded from the files.

    ``start`` counts the ids of all documents before it.
    """
    prepare(spark)
    files = spark.read.schema(SEGMENTS).parquet(folder)
    # One number per range: at most RANGES_PER_PARTITION times the writer's partitions.
    totals = sorted(tuple(row) for row in files.groupBy("range").agg(F.sum("tokens")).collect())
    ends = accumulate((tokens for _, tokens in totals), initial=0)
    bases = spark.createDataFrame([(k, base) for (k, _), base in zip(totals, ends)], "range int, base long")
    rows = files.select("range", "first", "data").mapInArrow(_documents, ROWS)
    return rows.join(F.broadcast(bases), "range").select(
        F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"),
        (F.col("base") + F.col("place")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def token_ids(
    docs: DataFrame, tokenizer: str, folder: str | None = None, order: str | None = None, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Write the ids of ``docs`` to a new folder and return what reading the files back gives."""
    spark = docs.sparkSession
    folder = folder or fresh_folder(spark, "tokens")
    write_tokens(docs, tokenizer, folder, order=order, slice_bytes=slice_bytes)
    return read_tokens(spark, folder)
