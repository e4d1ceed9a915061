"""What a worker of the pipeline's token stage encodes at once."""

import corpus_pipeline
import pyarrow as pa

from tidemark.llm import tokens
from tidemark.llm.queries import tokenizer_path


def test_the_pipeline_encodes_a_megabyte_at_a_time(monkeypatch):
    asked = {}
    monkeypatch.setattr(tokens, "write_tokens", lambda *args, **named: asked.update(named))
    monkeypatch.setattr(tokens, "read_tokens", lambda *args: None)
    monkeypatch.setattr(tokens, "fresh_folder", lambda *args: "")

    class Docs:
        sparkSession = None

    corpus_pipeline.write_token_files(None, Docs(), "")
    assert asked["order"] == "mix_slot" and asked["slice_bytes"] <= 1 << 20


def test_slices_of_any_size_give_the_same_ids():
    texts = [f"word{i} some more, and\nothers {i * i} " * (i % 40) for i in range(120)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([i // 50 for i in range(120)], pa.int32()), pa.array(range(120)), pa.array(texts)], names=["range", "id", "text"]
    )
    found = []
    for size in (tokens.SLICE_BYTES, 3_000):
        made = list(tokens._segments(iter([batch]), tokenizer_path(), 0, tokens.PERCENTILE, size))
        rows = pa.Table.from_batches(tokens._documents(iter(made))).to_pylist()
        found.append(rows)
    assert found[0] == found[1] and len(found[0]) == 120
