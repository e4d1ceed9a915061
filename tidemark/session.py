"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_LOCAL_FOLDERS: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the library relies on to ``spark``.

    * UTC, so that window labels do not depend on where the driver runs;
    * last-wins map building, so that a later attribute replaces an earlier one;
    * a group-limit threshold above the default top-list capacity, so that top lists are cut
      inside every map task before they are shuffled;
    * room for a thousand sketches per task before Spark sorts the rows by sketch instead;
    * adaptive execution, for coalescing, skewed joins and rebalanced writes;
    * state in RocksDB on a cluster, where it outgrows the executor heap.
    """
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "4096")
    conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "1024")
    conf.set("spark.sql.adaptive.enabled", "true")
    if not is_local(spark):
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_STATE)
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets one temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL_FOLDERS[application]


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, for results that are read more than once.

    Unlike a cache it survives lost executors without computing anything again.
    """
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
