from types import SimpleNamespace

import pytest

from tests.helpers import rows
from tidemark import session


def fake(folder, master="local[2]", application="app-1"):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: folder or default),
        sparkContext=SimpleNamespace(master=master, applicationId=application),
    )


def test_the_folder_the_cluster_names_is_used():
    assert session.shared_folder(fake("hdfs:///shared", "yarn")) == "hdfs:///shared"
    assert session.fresh_folder(fake("hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError):
        session.shared_folder(fake(None, "spark://host:7077"))


def test_a_local_session_keeps_one_folder():
    first = session.shared_folder(fake(None))
    assert session.shared_folder(fake(None)) == first
    assert session.shared_folder(fake(None, application="app-2")) != first


def test_settings(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.mapKeyDedupPolicy") == "LAST_WIN"


def test_written_tables_keep_rows_and_types(spark):
    df = spark.range(5).selectExpr("id", "map('a', cast(id as string)) as m")
    again = session.written(df, "table")
    assert again.schema.simpleString() == df.schema.simpleString()
    assert rows(again, "id") == rows(df, "id")
