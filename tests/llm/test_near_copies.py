"""What the near-duplicate stage of the pipeline needs: memory of a worker, and texts shuffled."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, simhash
from tidemark.operators import joins


def test_a_worker_shingles_half_a_megabyte_at_a_time(monkeypatch):
    taken = []
    inner = simhash.simhashes
    monkeypatch.setattr(simhash, "simhashes", lambda texts, n: taken.append(sum(len(t.as_py()) for t in texts)) or inner(texts, n))
    texts = [f"w{i} and some more words " * 2_000 for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], names=["id", "text"])
    made = pa.Table.from_batches(simhash._fingerprint_batches(iter([batch]), 3))
    assert max(taken) <= 1 << 19 and sum(taken) == sum(map(len, texts))
    assert made["fp"].to_pylist() == pa.array(inner(pa.array(texts)).view("int64")).to_pylist()


def _rows():
    def text(name):
        return " ".join(f"{name}{i}" for i in range(40))

    # 40 texts; copies of 4 of them under larger ids; one row twice; ids that are null or shared.
    rows = [(i, text(f"t{i}_")) for i in range(40)] + [(100 + i, text(f"t{i}_")) for i in range(4)]
    rows += [(7, text("t7_")), (None, text("n")), (None, text("m")), (5, text("o")), (200, text("n"))]
    return rows, {*rows} - {(100 + i, text(f"t{i}_")) for i in range(4)} - {(200, text("n"))}


@pytest.mark.parametrize("most", [0, 10, 1000])
def test_lists_of_any_size_leave_the_same_documents(spark, monkeypatch, most):
    for module in (simhash, common):
        monkeypatch.setattr(module, "is_small", lambda df: joins.is_small(df, most), raising=False)
    rows, expected = _rows()
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(expected)


def test_texts_stay_where_they_are_while_few_documents_go(spark, monkeypatch):
    for module in (simhash, common):
        monkeypatch.setattr(module, "is_small", lambda df: joins.is_small(df, 10), raising=False)
    rows, expected = _rows()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert kept.select(F.countDistinct("text")).first()[0] == len({t for _, t in expected})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
