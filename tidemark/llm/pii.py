"""Personal data: patterns, and terms that give the protected entities away.

Emails, IP addresses, card and phone numbers are found by their patterns; these are the protected
entities. Information-theoretic sanitisation then asks which other words reveal them: a term's pointwise mutual
information with an entity, over all documents, against what the entity's own probability allows at most. Of
terms standing near an entity, those above ``disclosure`` are spans as well, and are generalised to
their kind when the text is rewritten. A term must have been seen near the entity in ``support`` different
contexts: what occurs once tells nothing.

One pass over the texts finds the entities, the terms near them and, summed per batch, how many documents
hold each word. All that is written once; the rest are joins of those small tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, id_key, prepare, slices, text_key, whole_text
from tidemark.llm.words import split, text_bytes
from tidemark.operators.joins import sized_join
from tidemark.session import written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
NEAR = 8
SUPPORT = 2
DISCLOSURE = 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_STRIPPED = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())

RESULT = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
)


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from the at sign outwards."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base matches, by start, then kind in the order of ``KINDS``."""
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [
        (m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    ]
    for m in _CARD.finditer(text):
        if len(m[0]) >= 14 and 14 <= len(digits := _digits(m[0])) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _term(word: str) -> str:
    return word.strip(_STRIPPED).lower()


def _words_before(text: str, start: int, near: int) -> list[tuple[int, int]]:
    """The last ``near`` words before ``start``, each whole however long."""
    reach = 32 * near
    while True:
        low = max(0, start - reach)
        found = [m.span() for m in _WORD.finditer(text, low, start)]
        if low and found and found[0][0] == low:
            del found[0]  # may begin further left
        if low == 0 or len(found) >= near:
            return found[-near:]
        reach *= 4


def _near(text: str, spans: list[tuple[str, int, int]], near: int) -> list[tuple[str, str, int, int, str]]:
    """(entity, term, start, end, context) of the words within ``near`` words of each entity, lines above and below included."""
    out = []
    for kind, start, end in spans:
        entity = f"{kind}:{text[start:end].lower()}"
        left = _words_before(text, start, near)
        right = []
        for m in _WORD.finditer(text, end):
            if len(right) == near:
                break
            right.append(m.span())
        around = [s for s in left + right if not any(s[0] < e and b < s[1] for _, b, e in spans)]
        terms = [(_term(text[a:b]), a, b) for a, b in around]
        context = " ".join(t for t, _, _ in terms)
        out += [(entity, t, a, b, context) for t, a, b in terms if len(t) > 2 and not t.isdigit()]
    return out


def _hash(texts: list[str]) -> pa.Array:
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    everything = np.ones(256, bool)
    words = split(data, offsets, everything)
    values = np.zeros(len(texts), np.uint64)
    values[words.counts > 0] = words.hashes()
    return pa.array(values.view(np.int64))


def _word_counts(lowered: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of some texts and how many of the texts hold each.

    A word is taken without the signs around it, as terms are.
    """
    data, offsets = text_bytes(lowered)
    words = split(data, offsets)
    sign = np.zeros(256, bool)
    sign[[ord(c) for c in _STRIPPED]] = True
    while len(words.start):
        inside = words.end > words.start
        first = inside & sign[data[np.minimum(words.start, len(data) - 1)]]
        last = inside & ~first & sign[data[words.end - 1]]
        if not first.any() and not last.any():
            break
        words.start = words.start + first
        words.end = words.end - last
    owner = np.repeat(np.arange(len(offsets) - 1), words.counts)
    filled = words.end - words.start > 2
    values, owner = words.hashes()[filled], owner[filled]
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return np.unique(values[new], return_counts=True)


_FOUND = pa.schema(
    [
        ("row", pa.int8()), ("doc_id", pa.int64()), ("h", pa.int64()), ("base", pa.string()), ("entity", pa.int64()),
        ("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("context", pa.int64()), ("n", pa.int64()),
    ]
)
_FOUND_SQL = (
    "row tinyint, doc_id long, h long, base string, entity long, term long, start int, end int, context long, n long"
)


def _rows(kind: int, count: int, **columns: pa.Array) -> pa.RecordBatch:
    filled = {"row": pa.array(np.full(count, kind, np.int8))} | columns
    return pa.RecordBatch.from_arrays(
        [filled[f.name] if f.name in filled else pa.nulls(count, f.type) for f in _FOUND], schema=_FOUND
    )


def _find(batches: Iterator[pa.RecordBatch], near: int) -> Iterator[pa.RecordBatch]:
    """Rows of three kinds: 0 a document with its base spans, 1 a term near an entity, 2 a word's documents."""
    held_values: list[np.ndarray] = []
    held_counts: list[np.ndarray] = []

    def sums() -> pa.RecordBatch:
        values, place = np.unique(np.concatenate(held_values), return_inverse=True)
        counts = np.bincount(place, np.concatenate(held_counts), len(values)).astype(np.int64)
        held_values.clear()
        held_counts.clear()
        return _rows(2, len(values), term=pa.array(values.view(np.int64)), n=pa.array(counts))

    for batch in slices(batches, "text"):
        texts = batch.column("text").to_pylist()
        spans = [base_spans(t) for t in texts]
        ids, hs = batch.column("id"), batch.column("h")
        yield _rows(0, len(texts), doc_id=ids, h=hs, base=pa.array(map(_listed, spans), pa.string()))
        terms = [(i, *x) for i, (t, s) in enumerate(zip(texts, spans)) if s for x in _near(t, s, near)]
        if terms:
            owner = pa.array([t[0] for t in terms])
            yield _rows(
                1, len(terms), doc_id=ids.take(owner), h=hs.take(owner),
                entity=_hash([t[1] for t in terms]), term=_hash([t[2] for t in terms]),
                start=pa.array([t[3] for t in terms], pa.int32()), end=pa.array([t[4] for t in terms], pa.int32()),
                context=_hash([t[5] for t in terms]),
            )
        values, counts = _word_counts(pa.array([t.lower() for t in texts], pa.large_string()))
        held_values.append(values)
        held_counts.append(counts)
        if sum(map(len, held_values)) > 1_000_000:
            yield sums()
    if held_values:
        yield sums()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, base, terms in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "base", "terms"))):
            spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
            more = [(TERM, t["start"], t["end"]) for t in terms or []]
            rank = {k: i for i, k in enumerate((*KINDS, TERM))}
            every = sorted({*spans, *more}, key=lambda x: (x[1], rank[x[0]], x[2]))
            counts = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
            out.append((doc_id, *counts, sha256(base.encode()).hexdigest(), _listed(every)))
        types = [*[pa.int64()] * 5, pa.string(), pa.string()]
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)


def find(
    docs: DataFrame, near: int = NEAR, support: int = SUPPORT, disclosure: float = DISCLOSURE
) -> DataFrame:
    """``doc_id``, counts of base spans per kind, ``base_sha256`` and all ``spans`` of every document.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, joined by commas; the
    method's own have the kind ``term``. ``disclosure`` is the share of an entity's information that a
    term may give away. Null texts are empty; repeated rows repeat. Other columns are not looked at.
    """
    prepare(docs.sparkSession)
    keyed = docs.select(id_key().alias("id"), text_key().alias("h"), whole_text().alias("text"))
    found = written(keyed.mapInArrow(lambda it: _find(it, near), _FOUND_SQL), "personal")
    documents = found.filter("row = 0").select("doc_id", "h", "base")
    terms = found.filter("row = 1").select("doc_id", "h", "entity", "term", "start", "end", "context")
    total = documents.count()

    entities = terms.select("entity", "doc_id", "h").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = (
        terms.groupBy("entity", "term", "doc_id", "h").agg(F.min("context").alias("context"))
        .groupBy("entity", "term").agg(F.count("*").alias("n_pair"), F.countDistinct("context").alias("contexts"))
        .filter(F.col("contexts") >= support)
    )
    pairs = written(pairs, "pairs")
    words = found.filter("row = 2").select("term", "n")
    held = sized_join(words, pairs.select("term").distinct(), ["term"], "left_semi").groupBy("term").agg(F.sum("n").alias("n_term"))
    most = F.log(F.lit(float(max(total, 2))) / F.col("n_entity"))
    shared = F.log(F.col("n_pair") * float(max(total, 2)) / (F.col("n_term") * F.col("n_entity")))
    telling = (
        sized_join(sized_join(pairs, written(held, "held"), ["term"], "inner"), written(entities, "entities"), ["entity"], "inner")
        .filter((most > 0) & (shared >= disclosure * most))
        .select("entity", "term")
    )
    marked = sized_join(terms, written(telling, "telling"), ["entity", "term"], "inner")
    spans = marked.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "end")).alias("terms"))
    joined = sized_join(documents, written(spans, "spans"), ["doc_id", "h"], "left")
    return joined.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "base", "terms").mapInArrow(_digest, RESULT)


def sanitise(text: str, spans: str) -> str:
    """``text`` with every span generalised to its kind in brackets; overlapping spans become one."""
    out, done = [], 0
    for kind, start, end in (x.split(":") for x in spans.split(",") if x):
        if int(start) >= done:
            out += [text[done : int(start)], f"[{kind.upper()}]"]
        done = max(done, int(end))
    return "".join([*out, text[done:]])
