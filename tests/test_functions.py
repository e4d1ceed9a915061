import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.helpers import rows
from tidemark.functions import attributes, keys, times

A_DIGEST = "0cc175b9c0f1b6a831c399e269772661"


def value(spark, column, **inputs):
    names = list(inputs) or ["x"]
    df = spark.createDataFrame([tuple(inputs.values()) or (1,)], names)
    return df.select(column.alias("v")).first()["v"]


def test_digests_of_either_case_and_their_text_are_one_key(spark):
    for key in ("a", A_DIGEST, A_DIGEST.upper()):
        assert value(spark, keys.canonical_key(F.col("k")), k=key) == A_DIGEST


@pytest.mark.parametrize("key", ["0" * 31, "g" * 32, "+" + "0" * 31, " " + "0" * 31])
def test_only_strict_digests_stand_for_themselves(spark, key):
    assert value(spark, keys.canonical_key(F.col("k")), k=key) != key


def test_numbers_are_padded_to_a_digest(spark):
    assert value(spark, keys.hex_digest(F.col("n")), n=255) == "ff".rjust(32, "0")


def test_sketch_buckets_are_in_range_and_differ_by_row(spark):
    found = value(spark, keys.sketch_buckets(F.col("k"), 9, 1000), k="a")
    assert len(found) == 9 and all(0 <= b < 1000 for b in found)
    assert len(set(found)) > 5


def test_packing_orders_attributes(spark):
    packed = attributes.pack(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))
    assert value(spark, packed) == "a#1$b#2"
    assert value(spark, attributes.pack(F.expr("map()").cast("map<string,string>"))) == ""


@pytest.mark.parametrize(
    "text, parsed",
    [
        ("a#1$b#2#3$a#9", {"a": "9", "b": "2#3"}),
        ("a#1$bad", None),
        ("a#", {"a": ""}),
        ("", None),
    ],
)
def test_parsing_packed_text(spark, text, parsed):
    assert value(spark, attributes.parse(F.col("t")), t=text) == parsed


def test_packed_maps_parse_back(spark):
    m = F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit(""))
    assert value(spark, attributes.parse(attributes.pack(m))) == {"x": "1", "y": ""}


def test_the_key_replaces_an_attribute_of_that_name(spark):
    m = F.create_map(F.lit("key"), F.lit("old"), F.lit("a"), F.lit("1"))
    assert value(spark, attributes.with_key(m, F.lit("new"))) == {"key": "new", "a": "1"}


def test_null_columns_are_no_attributes(spark):
    m = attributes.attribute_map({"a": F.lit(1), "b": F.lit(None).cast("string")})
    assert value(spark, m) == {"a": "1"}


def test_labels_parse_and_format(spark):
    ts = times.parse_label(F.col("t"))
    assert value(spark, times.format_label(ts), t="20130509T101112") == "20130509T101112"
    assert value(spark, ts, t="2013-05-09") is None
    assert value(spark, times.format_label(times.next_day(ts)), t="20131231T235959") == (
        "20140101T000000"
    )
    assert value(spark, times.ms_of_day(ts), t="20130509T000001") == 1000


def test_windows_start_at_or_before_times_in_the_past(spark):
    ts = F.col("t").cast("timestamp")
    start = times.format_label(times.window_start(ts, 3_600_000, 60_000))
    assert value(spark, start, t="1969-12-31 23:30:00") == "19691231T230100"
    # The offset counts modulo the slide.
    same = times.format_label(times.window_start(ts, 3_600_000, 60_000 + 5 * 3_600_000))
    assert value(spark, same, t="1969-12-31 23:30:00") == "19691231T230100"


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("12",), ("x",)], ["t"])
    assert rows(df.select(F.coalesce(F.col("t").try_cast("long"), F.lit(-1)))) == [(-1,), (12,)]


def test_a_bad_moment_is_refused():
    with pytest.raises(ValueError):
        times.moment("2013-05-09")
    with pytest.raises((PySparkException, ValueError)):
        times.moment("")
