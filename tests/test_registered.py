import pytest

import __spark_entry__ as entry
from tidemark.plans.oracle import all_oracles
from tidemark.plans.queries import all_queries
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_equals_its_sql(spark, db, name):
    same, detail = compare(spark, db, SF_DIR, name)
    assert same, detail


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
