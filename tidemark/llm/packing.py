"""Training sequences by power-of-two decomposition: no sequence holds two documents, none is padded.

A document of n tokens becomes n // longest pieces of the longest length and, for the rest, one piece per bit of the
remainder, longer ones first. Every piece is a sequence of its own; sequences of one length form a bucket, a folder of
the output, so a batch of one length is read from one place. Whatever a bucket's share of all tokens, adaptive
execution deals it out by size.

The ids of a piece are kept as little-endian 32-bit numbers in a binary column.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, slices, whole_text
from tidemark.llm.wordbpe import word_encoder
from tidemark.llm.words import pieces
from tidemark.session import fresh_folder

LONGEST = 4096
END_ID = 2
_BATCH_BYTES = 4 << 20
PIECES = "doc_id long, start long, doc_tokens long, ids binary, length int"
PACKED = "doc_id long, start long, doc_tokens long, ids binary, sequence_id long, length int"


def decompose(tokens: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of a document, in order: the longest ones, then the bits of the remainder."""
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, longest: int) -> Iterator[pa.RecordBatch]:
    encoder = word_encoder(path)
    end = end_id.to_bytes(4, "little")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
    names = ["doc_id", "start", "doc_tokens", "ids", "length"]
    rows: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in slices(batches, "text"):
        texts = batch.column("text").cast(pa.large_string()).cast(pa.large_binary())
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), texts.to_pylist()):
            ids = encoder.encode(pieces(raw)) + end
            tokens, start = len(ids) // 4, 0
            for length in decompose(tokens, longest):
                rows.append((doc_id, start, tokens, ids[4 * start : 4 * (start + length)], length))
                start += length
                held += 4 * length
                if held >= _BATCH_BYTES:
                    yield flush()
                    rows, held = [], 0
    if rows:
        yield flush()


def write_packed(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, longest: int = LONGEST) -> None:
    """Write every text's ids, followed by ``end_id``, as sequences of power-of-two lengths below ``folder``.

    ``tokenizer`` is the path of a tokenizer file that every worker can read. A null text is empty and so one sequence
    with the end id; a null ``doc_id`` stays null; repeated rows are documents of their own. An empty table writes
    files without rows. Other columns, whatever their names, are not looked at.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    cut = texts.mapInArrow(lambda it: _pieces(it, tokenizer, end_id, longest), PIECES)
    # To the buckets: small ones are merged, large ones split by size.
    dealt = cut.hint("rebalance", "length").sortWithinPartitions("length")
    numbered = dealt.withColumn("sequence_id", F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").partitionBy("length").parquet(folder)


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``ids``, ``sequence_id`` and ``offset`` there."""
    files = spark.read.schema(PACKED).parquet(folder)
    # A sequence is one piece.
    return files.withColumn("offset", F.lit(0).cast("long")).withColumn("length", F.col("length").cast("long"))


def pack(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, longest: int = LONGEST) -> DataFrame:
    """Pack ``docs`` into a new folder and return what reading it gives, with a checksum of the ids in their place."""
    spark = docs.sparkSession
    folder = folder or fresh_folder(spark, "packed")
    write_packed(docs, tokenizer, folder, end_id, longest)
    return read_packed(spark, folder).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
