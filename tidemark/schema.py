"""Schemas of the tables the library reads, keeps and returns."""

from __future__ import annotations

from pyspark.sql import types as T

STREAM = ["service", "collection"]
WINDOW = ["window_start", "window_end"]
STREAM_WINDOW = STREAM + WINDOW

_text = T.StringType()
_long = T.LongType()
_attributes = T.MapType(_text, _text)

RECORD = T.StructType(
    [
        T.StructField("service", _text),
        T.StructField("collection", _text),
        T.StructField("key", _text),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", _long),
        T.StructField("values", _attributes),
    ]
)

LABEL_HITS = T.StructType(
    [
        T.StructField("collection", _text),
        T.StructField("label_name", _text),
        T.StructField("hits", _long),
    ]
)

STREAM_CONFIG = T.StructType(
    [
        T.StructField("service", _text),
        T.StructField("collection", _text),
        T.StructField("start_time_ms", _long),
        T.StructField("slide_length_ms", _long),
        T.StructField("sketch_width", _long),
        T.StructField("sketch_max_value", _long),
        T.StructField("topk_max_count", T.IntegerType()),
    ]
)

# What a stream without its own settings gets.
DEFAULT_CONFIG = {
    "start_time_ms": 24 * 60 * 60 * 1000,
    "slide_length_ms": 24 * 60 * 60 * 1000,
    "sketch_width": 1 << 20,
    "sketch_max_value": 1 << 31,
    "topk_max_count": 1024,
}

DAY_MS = 24 * 60 * 60 * 1000
TOP_LIST_CAPACITY = DEFAULT_CONFIG["topk_max_count"]
SKETCH_WIDTH = DEFAULT_CONFIG["sketch_width"]
SKETCH_MAX_VALUE = DEFAULT_CONFIG["sketch_max_value"]
SKETCH_DEPTH = 3
HLL_LG_K = 12
MONITORED_CAPACITY = 400
