import pytest

from tests.helpers import rows
from tidemark.operators import labels
from tidemark.session import fresh_folder
from tidemark.sources.labelstore import LabelStore
from tidemark.sources.records import label_hits

HITS = [("c1", "red", 2), ("c1", "red", 3), ("c1", "blue", 1), ("c2", "red", 4)]
SCHEMA = "collection string, label_name string, hits bigint"


@pytest.fixture
def hits(spark):
    return spark.createDataFrame(HITS, SCHEMA)


def test_totals_and_drop(hits):
    totals = labels.label_totals(hits)
    assert rows(totals) == [("c1", "blue", 1), ("c1", "red", 5), ("c2", "red", 4)]
    assert rows(labels.labels_of(totals, "c1"), "label_name") == [("blue",), ("red",)]
    assert rows(labels.without_collection(totals, "c1")) == [("c2", "red", 4)]


def test_text_counts_are_read_as_numbers(spark):
    table = spark.createDataFrame(
        [("c", "red", "12")], "collection string, label_name string, hit_docs_num string"
    )
    assert rows(label_hits(table)) == [("c", "red", 12)]


def test_stored_labels(spark, hits):
    store = LabelStore(spark, fresh_folder(spark, "labels"))
    assert rows(store.totals()) == []
    store.add(hits, 1)
    store.add(hits, 1)  # a repeated entry replaces itself
    store.add(hits, 2)
    assert rows(store.labels_of("c1"), "label_name", "hit_docs_num") == [("blue", 2), ("red", 10)]
    store.drop("c1", 3)
    store.drop("never seen", 4)
    assert rows(store.totals()) == [("c2", "red", 8)]
    store.add(hits, 5)
    assert rows(store.totals()) == [("c1", "blue", 1), ("c1", "red", 5), ("c2", "red", 12)]


def test_a_callers_number_does_not_hide_labels(spark, hits):
    store = LabelStore(spark, fresh_folder(spark, "labels"))
    store.add(hits)
    store.drop("c1")
    store.add(hits, 5)
    store.add(hits, 5)
    assert rows(store.labels_of("c1"), "label_name", "hit_docs_num") == [("blue", 1), ("red", 5)]
