"""Added tokens in a text, compared with a tokenizer that is loaded afresh."""

import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import AddedToken, Tokenizer

from tidemark.llm import bpe, queries, tokens
from tidemark.llm.words import text_bytes

END = "<|endoftext|>"
TEXTS = ["", END, f"end {END} x", f"a b{END}{END}\n c", "<|endof", "text|> y", f"it's {END[:-1]}", "plain words, here", f"é {END}", f"{END} tail"]


def plain(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("more", [None, AddedToken("[[M]]", lstrip=True, rstrip=True), AddedToken("ord", single_word=True)])
def test_pieces_with_added_tokens(tmp_path, more):
    fresh = Tokenizer.from_file(queries.tokenizer_path())
    if more:
        fresh.add_tokens([more])
    path = str(tmp_path / "tokenizer.json")
    fresh.save(path)
    assert json.load(open(path))["added_tokens"]
    fresh, encoder = Tokenizer.from_file(path), bpe.Encoder(path)
    texts = [*TEXTS, "go  [[M]] \n on", "word ord fjord"]
    found, first = encoder.encode(*text_bytes(pa.array(texts)))
    assert [found[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [plain(fresh, t) for t in texts]


def test_token_files_hold_added_tokens(spark):
    fresh = Tokenizer.from_file(queries.tokenizer_path())
    assert 50256 in plain(fresh, TEXTS[2])
    want, at = [], 0
    for i, text in enumerate(TEXTS):
        own = [*plain(fresh, text), 0]
        want.append((i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert sorted(map(tuple, tokens.token_ids(docs, queries.tokenizer_path()).collect())) == want
