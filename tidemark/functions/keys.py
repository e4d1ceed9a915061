"""Key canonicalisation and the md5-based hashes of the table-shaped sketches.

md5 is slower than xxhash64, but every SQL engine computes the same digest, so a sketch can be
rebuilt and compared outside Spark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how a key that already is a 128-bit digest looks.
HEX_DIGEST = "^[0-9a-fA-F]{32}$"

BUCKETS_PER_DIGEST = 4
KMV_HASH_BITS = 60


def canonical_key(key: Column) -> Column:
    """The 128-bit identity of a key as 32 lower-case hex digits.

    A key that is such a digest stands for itself whatever its case; any other key is hashed. The
    length check spares most keys the pattern.
    """
    is_digest = (F.octet_length(key) == 32) & key.rlike(HEX_DIGEST)
    return F.when(is_digest, F.lower(key)).otherwise(F.md5(key))


def hex_digest(number: Column) -> Column:
    """A binary or integral value as 32 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(number), 32, "0"))


def sketch_buckets(key: Column, depth: int, width: int | Column) -> Column:
    """One bucket per sketch row, as an array of ``depth`` longs in ``[0, width)``.

    A digest yields four independent 32-bit hashes, so four rows cost a single md5.
    """
    size = F.lit(width).cast("long")
    buckets = []
    for row in range(depth):
        block, part = divmod(row, BUCKETS_PER_DIGEST)
        digest = F.md5(F.concat(F.lit(f"{block}|"), key))
        chunk = F.substring(digest, 8 * part + 1, 8)
        buckets.append(F.pmod(F.conv(chunk, 16, 10).cast("long"), size))
    return F.array(*buckets)


def kmv_hash(key: Column) -> Column:
    """A uniform hash in ``[0, 2**60)``."""
    return F.conv(F.substring(F.md5(key), 1, KMV_HASH_BITS // 4), 16, 10).cast("long")
