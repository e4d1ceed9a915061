"""Reading import tables from a SQL database over JDBC."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def sql_table(
    spark: SparkSession,
    url: str,
    name: str,
    options: Mapping[str, str] | None = None,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 1,
    predicates: Sequence[str] | None = None,
) -> DataFrame:
    """A database table, read in parallel ranges of ``partition_column`` or one per predicate.

    Filters and column choices made on the result are sent to the database. The driver jar and the
    credentials come from the caller's ``options``.
    """
    settings = {"url": url, "dbtable": name, "fetchsize": "10000", **(options or {})}
    if predicates:
        rest = {key: value for key, value in settings.items() if key not in ("url", "dbtable")}
        return spark.read.jdbc(url, name, predicates=list(predicates), properties=rest)
    if partition_column:
        if bounds is None:
            raise ValueError("a partition column needs its bounds")
        settings |= {
            "partitionColumn": partition_column,
            "lowerBound": bounds[0],
            "upperBound": bounds[1],
            "numPartitions": str(partitions),
        }
    return spark.read.format("jdbc").options(**settings).load()
