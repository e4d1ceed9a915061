"""Packing against the tokenizers library and the rules of the decomposition."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing, queries, wordbpe
from tidemark.session import fresh_folder

SCHEMA = "doc_id long, text string"
TEXTS = [
    "One two, three!! it's we'll 'TIS y'all's a_b 3.14 10,000 x",
    "CAFÉ Ünï straße Ÿ é Å İstanbul ΣΑΣ 日本語 text　wide  nbsp line",
    "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|> <| endoftext |> x<|",
    "tab\tvertical\x0bform\x0cfeed\r\nend \x1c\x1d sep\x85next",
    "don't DON'T 'S 's s' rock'n'roll ''' word's.", "\U0001f600 smile ﬁ ligature Å", "  ", "", "%$# ~~ -- --a --1 a1b2",
]


def path():
    return queries.tokenizer_path(queries.WORD_TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(path())


def ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_encoder_equals_the_library(library, monkeypatch):
    monkeypatch.setattr(wordbpe, "REMEMBERED", 64)  # forgets and learns again
    encoder = wordbpe.WordEncoder(path())
    assert encoder.by_word
    corpus = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    rng = random.Random(4)
    letters = "aZé ß'.,\n|<>1́ Ñ"
    noise = ["".join(rng.choices(letters, k=80)) for _ in range(300)]
    for text in [*TEXTS, *corpus, *noise]:
        text = text or ""
        got = np.frombuffer(encoder.encode(packing.pieces(text.encode(), 50)), "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text


def test_other_tokenizers_are_used_whole():
    other = queries.tokenizer_path()
    encoder = wordbpe.WordEncoder(other)
    assert not encoder.by_word
    text = "Two  words\nand <|endoftext|> more"
    want = Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(packing.pieces(text.encode())), "<u4").tolist() == want


def test_decompose():
    for longest in (1, 8, 4096):
        for n in [*range(1, 40), 4095, 4096, 4097, 12345]:
            found = packing.decompose(n, longest)
            assert sum(found) == n and found == sorted(found, reverse=True)
            assert all(x <= longest and x & (x - 1) == 0 for x in found)
            assert max(Counter(x for x in found if x < longest).values(), default=1) == 1


def test_every_id_is_in_one_piece(spark, library):
    rows = [*enumerate(TEXTS), (50, None), (None, "no id"), (None, "no id"), (7, "one id twice"), (60, "long words " * 20000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for name in ("id", "start", "length", "ids", "sequence_id", "offset", "doc_tokens"):
        docs = docs.withColumn(name, F.lit("x"))
    folder = fresh_folder(spark, "packed")
    packed = packing.pack(docs, path(), folder).collect()
    pieces = packing.read_packed(spark, folder).collect()
    assert len({r.sequence_id for r in packed}) == len(packed) == len(pieces)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and 1 <= r.length <= packing.LONGEST for r in packed)
    sums = {(r.sequence_id, r.ids_crc32) for r in packed}
    assert sums == {(r.sequence_id, zlib.crc32(bytes(r.ids))) for r in pieces}
    found = defaultdict(list)
    for r in pieces:
        assert len(r.ids) == 4 * r.length
        found[r.doc_id, r.doc_tokens].append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    want = defaultdict(list)
    for doc_id, text in rows:
        got = ids(library, text)
        start = 0
        for length in packing.decompose(len(got)):
            want[doc_id, len(got)].append((start, got[start : start + length]))
            start += length
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    # Buckets are folders, and sequences of one length follow each other in them.
    assert spark.read.parquet(f"{folder}/length=1").count() == sum(r.length == 1 for r in packed)


def test_empty_table_and_lengths(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack(none, path()).count() == 0
    with pytest.raises(ValueError):
        packing.write_packed(none, path(), fresh_folder(spark, "packed"), longest=100)
