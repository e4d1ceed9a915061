"""What a worker keeps and is sent for the toxicity stage."""

import numpy as np
import pyarrow as pa

from tidemark.llm import toxicity, words


def _model():
    return toxicity.Model(lexicon=np.array([1], np.uint64), weights=np.zeros(toxicity._KINDS + 4))


def test_tables_of_powers_follow_the_slice_and_not_the_batch(monkeypatch):
    monkeypatch.setattr(words, "_POWERS", {})
    batch = pa.RecordBatch.from_arrays([pa.array(["some words " * 5_000] * 60)], names=["0"])
    kept = list(toxicity._fine(iter([batch]), _model(), 2.0, "0", 1))
    assert sum(b.num_rows for b in kept) == 60
    assert max(len(up) for up, _ in words._POWERS.values()) <= 1 << 20


def test_texts_are_sent_to_a_worker_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "")], "doc_id bigint, text string")
    kept = toxicity.keep_fine(docs, _model(), 2.0)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "coalesce" not in plan
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b"), (2, None), (None, "")], key=str)


def test_texts_that_are_no_strings_are_still_read(spark):
    docs = spark.createDataFrame([(1, 5), (2, None)], "doc_id bigint, text int")
    kept = toxicity.keep_fine(docs, _model(), 2.0)
    assert kept.dtypes == docs.dtypes
    assert sorted(map(tuple, kept.collect())) == [(1, 5), (2, None)]
