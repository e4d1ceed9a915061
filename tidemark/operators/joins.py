"""Joins with a side that is expected, but not guaranteed, to be small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
SALTS = 32


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than one row beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def sized_join(
    large: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``large`` with ``small``, broadcasting ``small`` only when its counted size allows it.

    Beyond ``max_rows`` the rows of each join key in ``large`` are spread over ``salts`` groups and
    ``small`` is repeated once per group, so that a key with a third of all rows still fills many
    tasks. ``how`` is one of left, inner, left_semi and left_anti, for which repeating the right
    side leaves the result unchanged.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    on = list(on)
    if is_small(small, max_rows):
        return large.join(F.broadcast(small), on, how)
    # Maps cannot be hashed, so they are left out of the salt.
    hashable = [
        F.col(f"`{field.name}`") for field in large.schema if field.dataType.typeName() != "map"
    ]
    salted = large.withColumn("__salt", F.pmod(F.xxhash64(*hashable), F.lit(salts)))
    every_salt = F.array(*[F.lit(salt).cast("long") for salt in range(salts)])
    repeated = small.withColumn("__salt", F.explode(every_salt))
    # Spark sizes a file before its rows are repeated, and would broadcast what has just been counted as too many.
    return salted.join(repeated.hint("merge"), [*on, "__salt"], how).drop("__salt")
