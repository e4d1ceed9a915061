"""Small builders shared by the tests."""

from __future__ import annotations

from datetime import datetime

from tidemark.schema import RECORD


def at(text: str) -> datetime:
    """``2013-05-09`` or ``2013-05-09 10:00:00``."""
    return datetime.fromisoformat(text)


def records(spark, rows, service="s", collection="c"):
    """Records from ``(key, time, attributes or None)`` in arrival order."""
    full = [
        (service, collection, key, at(time), seq, attributes)
        for seq, (key, time, attributes) in enumerate(rows)
    ]
    # Naive times are session times: build through text so the driver's zone plays no part.
    texts = [(s, c, k, t.strftime("%Y-%m-%d %H:%M:%S.%f"), q, v) for s, c, k, t, q, v in full]
    schema = (
        "service string, collection string, key string, ts string, seq bigint, "
        "values map<string,string>"
    )
    df = spark.createDataFrame(texts, schema)
    return df.withColumn("ts", df["ts"].cast("timestamp")).select(*RECORD.names)


def rows(df, *columns):
    return sorted(tuple(row) for row in (df.select(*columns) if columns else df).collect())
