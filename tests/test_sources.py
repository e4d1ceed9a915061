import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from tidemark.schema import RECORD
from tidemark.session import fresh_folder
from tidemark.sources import export, records
from tidemark.sources.sqltable import sql_table


def test_tokens_of_a_text(spark):
    df = spark.createDataFrame([("  shoes\tbag\n\nshoes ",), ("",), (" ",)], ["text"])
    tokens = records.token_records(df, "text", F.lit("s"), F.lit("c"))
    assert rows(tokens, "key") == [("bag",), ("shoes",), ("shoes",)]


def test_tokens_of_text_files(spark):
    path = fresh_folder(spark, "text")
    spark.createDataFrame([("shoes bag",), ("bag",)], ["value"]).write.text(path)
    tokens = records.token_records(spark.read.text(path), "value", F.lit("s"), F.lit("c"))
    assert rows(tokens, "key") == [("bag",), ("bag",), ("shoes",)]


def test_records_have_one_schema(spark):
    df = spark.createDataFrame([(7, "x")], "id bigint, text string")
    plain = records.log_records(df, F.lit("s"), F.lit("c"), "id")
    assert [(f.name, f.dataType) for f in plain.schema] == [(f.name, f.dataType) for f in RECORD]
    assert plain.first()["values"] is None and plain.first()["ts"] is not None
    carrying = records.log_records(df, F.lit("s"), "text", "id", values={"t": F.col("text")})
    row = carrying.first()
    assert (row["collection"], row["key"], row["values"]) == ("x", "7", {"t": "x"})


def test_imported_rows_become_records(spark):
    log = spark.createDataFrame(
        [
            ("shop", "20130516T000000", "shoes", 3, None),
            ("shop", "20130515T235959", "early", 3, "x"),
            ("shop", "20130517T000000", "nothing", 0, "x"),
        ],
        "collection string, TimeStamp string, query string, hit_docs_num long, extra string",
    )
    found = records.imported_records(log, F.lit("s"), "20130516T000000").collect()
    assert [row["key"] for row in found] == ["shoes"]
    assert found[0]["values"] == {
        "collection": "shop",
        "TimeStamp": "20130516T000000",
        "query": "shoes",
        "hit_docs_num": "3",
    }
    assert str(found[0]["ts"]).startswith("2013-05-1")


@pytest.fixture
def shares(spark):
    return spark.createDataFrame(
        [
            (5, "x" * 11, "i5", "web"),
            (1, "x" * 10, "i1", "web"),
            (2, "x" * 11, None, "web"),
            (3, "x" * 11, "NULL", "web"),
            (9, "x" * 12, "i9", None),
            (7, "x" * 13, "i7", "app"),
            (4, "é" * 6, "i4", "web"),  # twelve bytes
        ],
        "id bigint, content string, img string, shareSourceName string",
    )


def test_exported_page(shares):
    page = export.export_page(export.exportable(shares), 1, 2)
    assert rows(page, "id") == [(5,), (7,)]
    block = page.filter("id = 7").first()["block"]
    assert block == f"<DOCID>7\n<Content>{'x' * 13}\n<Img>i7\n<ShareSourceName>app"


def test_export_file_is_in_id_order(spark, shares):
    path = fresh_folder(spark, "export")
    export.write_export(export.export_page(export.exportable(shares), 0, 10), path)
    lines = [row["value"] for row in spark.read.text(path).collect()]
    assert [line for line in lines if line.startswith("<DOCID>")] == [
        "<DOCID>4",
        "<DOCID>5",
        "<DOCID>7",
        "<DOCID>9",
    ]
    assert lines[-1] == "<ShareSourceName>"


def test_a_partitioned_sql_read_needs_bounds(spark):
    with pytest.raises(ValueError):
        sql_table(spark, "jdbc:none:", "t", partition_column="id")
