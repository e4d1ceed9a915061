"""Toxicity by a linear-chain conditional random field over tokens.

Labels say which documents are toxic, not which words. So the tokens are labelled first: over the training
documents, words and word beginnings are counted by the documents of either label that hold them, and
those tied to the toxic ones beyond chance form a lexicon; a training token is toxic if its document is and
the lexicon has it. The field is trained on such tokens, with the lexicon entries, the kind of match and
the neighbours' matches as features. A document's score comes from the forward-backward marginals: the
probability that any token is toxic, put on the scale of the labels by a logistic curve that is fitted on
training documents which took no part in the rest. Tokens more likely toxic than not are the offending ones.

The model is fitted on about ``TRAIN_DOCS`` labelled documents, chosen by a hash; scoring reads every document
once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_names, prepare, slices, whole_text
from tidemark.llm.crf import CHAIN, Chain, train
from tidemark.llm.words import MULTIPLIER, Words, gram_places, grams, mix, powers, split, text_bytes

#: Bounds of the labelled sample that the model is fitted on.
TRAIN_DOCS = 20_000
CHAINS = 6_000
#: The share of those documents that only the final curve is fitted on, in hundredths.
CURVE_SHARE = 30
BEGINNINGS = (4, 5, 6, 7, 8, 9)
#: Least likelihood-ratio statistic and least ratio of rates of a lexicon entry.
EVIDENCE = 25.0
RATIO = 8.0
THRESHOLD = 0.7
#: Texts worked on together; a worker's arrays are some sixty times that.
SLICE_BYTES = 1 << 19
_KINDS = 1 + len(BEGINNINGS)

_LETTERS = np.zeros(256, bool)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True
RESULT = "doc_id long, held_out boolean, score double, predicted int, spans string"


def _lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals lower-cased; every byte keeps its place."""
    result = data.copy()
    result[(data >= 0x41) & (data <= 0x5A)] += 0x20
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    result[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return result


def _tokens(texts: pa.Array) -> Words:
    data, offsets = text_bytes(texts)
    return split(_lowered(data), offsets, _LETTERS)


def _features(words: Words) -> np.ndarray:
    """Of every token: the hash of the word and of its beginnings of 4 to 9 bytes, or 0 where it has none."""
    up, down = powers(MULTIPLIER, len(words.data))
    sums = np.zeros(len(words.data) + 1, np.uint64)
    np.cumsum((words.data.astype(np.uint64) + np.uint64(1)) * up[: len(words.data)], out=sums[1:])
    result = np.zeros((_KINDS, len(words.start)), np.uint64)
    result[0] = mix((sums[words.end] - sums[words.start]) * down[words.start])
    for kind, length in enumerate(BEGINNINGS, 1):
        long = np.flatnonzero(words.end - words.start > length)
        to = words.start[long] + length
        whole = (words.data[to] & 0xC0) != 0x80  # not inside a character
        long, to = long[whole], to[whole]
        result[kind, long] = mix((sums[to] - sums[words.start[long]]) * down[words.start[long]] + np.uint64(length))
    return result


def _owners(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.counts)), words.counts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents hold each feature, summed per batch."""
    for batch in slices(batches, "text", SLICE_BYTES):
        words = _tokens(batch.column("text"))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        owner = _owners(words)
        found = []
        for values in _features(words):
            has = np.flatnonzero(values)
            order = has[np.lexsort((owner[has], values[has]))]
            v, o = values[order], owner[order]
            once = np.ones(len(v), bool)
            once[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
            found.append((v[once], toxic[o[once]]))
        values = np.concatenate([v for v, _ in found])
        marks = np.concatenate([m for _, m in found])
        distinct, place = np.unique(values, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(distinct.view(np.int64)),
                pa.array(np.bincount(place, marks, len(distinct)).astype(np.int64)),
                pa.array(np.bincount(place, ~marks, len(distinct)).astype(np.int64)),
            ],
            names=["feature", "toxic", "fine"],
        )


def _sum(a: Column, b: Column) -> Column:
    return F.when(a > 0, a * F.log(a / b)).otherwise(F.lit(0.0))


@dataclass
class Model:
    """Everything a score needs; ``lexicon`` is ascending."""

    lexicon: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(_KINDS + 3))
    chain: Chain = field(default_factory=Chain)
    curve: tuple[float, float] = (-20.0, 0.0)

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token, kind of match and lexicon entry of everything the lexicon has."""
        if not len(self.lexicon) or not len(words.start):
            return (np.empty(0, np.int64),) * 3
        sieve = np.zeros(1 << 20, bool)
        sieve[self.lexicon & np.uint64((1 << 20) - 1)] = True
        kinds, tokens, entries = [], [], []
        for kind, values in enumerate(_features(words)):
            near = np.flatnonzero(sieve[values & np.uint64((1 << 20) - 1)])
            at = np.minimum(np.searchsorted(self.lexicon, values[near]), len(self.lexicon) - 1)
            hit = self.lexicon[at] == values[near]
            tokens.append(near[hit])
            entries.append(at[hit])
            kinds.append(np.full(int(hit.sum()), kind))
        return np.concatenate(tokens), np.concatenate(kinds), np.concatenate(entries)

    def chains(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """First token, length and document of every chain with a match, and their (row, place, feature)
        triples. Features: lexicon entries, kinds of match, a match before, a match after, every token."""
        token, kind, entry = self.matches(words)
        owner = _owners(words)
        document = owner[token] if len(token) else token
        number = (token - words.first[document]) // CHAIN if len(token) else token
        key = document * (1 << 40) + number
        keys, row = np.unique(key, return_inverse=True)
        chain_doc, chain_no = keys >> 40, keys & ((1 << 40) - 1)
        first = words.first[chain_doc] + chain_no * CHAIN
        length = np.minimum(words.first[chain_doc + 1] - first, CHAIN)
        place = token - first[row]
        base = len(self.lexicon)
        once = np.unique(row * CHAIN + place)
        r, p = once // CHAIN, once % CHAIN
        before, after = p + 1 < length[r], p > 0
        every_row = np.repeat(np.arange(len(keys)), length)
        every_place = np.arange(len(every_row)) - np.repeat(np.cumsum(length) - length, length)
        triples = [
            (row, place, entry),
            (row, place, base + kind),
            (r[before], p[before] + 1, np.full(int(before.sum()), base + _KINDS)),
            (r[after], p[after] - 1, np.full(int(after.sum()), base + _KINDS + 1)),
            (every_row, every_place, np.full(len(every_row), base + _KINDS + 2)),
        ]
        return first, length, chain_doc, triples

    def tag(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds per text that any token is toxic, and the tokens that are, with their probability."""
        texts = len(words.counts)
        if not len(self.lexicon):
            return np.full(texts, -30.0), np.empty(0, np.int64), np.empty(0)
        first, length, document, triples = self.chains(words)
        emissions = np.zeros((len(first), CHAIN))
        for row, place, feature in triples:
            np.add.at(emissions, (row, place), self.weights[feature])
        none = np.zeros(texts)
        # Chains without a match are alike: one for each length there can be.
        plain = np.full((CHAIN, CHAIN), self.weights[-1])
        lengths = np.arange(1, CHAIN + 1)
        background = np.log1p(-np.minimum(self.chain.marginals(plain, lengths)[1], 1 - 1e-9)).sum(axis=1)
        counts = words.counts
        none += (counts // CHAIN) * background[-1] + np.where(counts % CHAIN, background[counts % CHAIN - 1], 0)
        token, sure = np.empty(0, np.int64), np.empty(0)
        if len(first):
            found = np.minimum(self.chain.marginals(emissions, length)[1], 1 - 1e-9)
            np.add.at(none, document, np.log1p(-found).sum(axis=1) - background[length - 1])
            row, place = np.nonzero(found >= 0.5)
            token, sure = first[row] + place, found[row, place]
        any_toxic = -np.expm1(np.minimum(none, -1e-12))
        odds = np.log(any_toxic) - np.minimum(none, -1e-12)
        return np.clip(odds, -30, 30), token, sure

    def score(self, odds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * odds, -40, 40)))


def held_out(column: str = "doc_id") -> Column:
    """Whether ``crc32`` of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 3 == 1


def _copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes that near copies mostly share: the least of their word 5-grams, in two orders."""
    for batch in slices(batches, "text", SLICE_BYTES):
        words = _tokens(batch.column("text"))
        hashes, counts = words.hashes(), words.counts
        keys = []
        for salt in (1, 2):
            least = np.full(len(counts), np.iinfo(np.uint64).max, np.uint64)
            for n in (1, 5):  # texts of fewer words go by their words
                text, place = gram_places(np.where(counts < 5, counts, 0) if n == 1 else counts, n)
                if len(text):
                    np.minimum.at(least, text, mix(grams(hashes, n)[words.first[text] + place] + np.uint64(salt)))
            keys.append(pa.array(least.view(np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns, *keys], names=[*batch.schema.names, "k1", "k2"])


def _training(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """About ``most`` labelled documents that are not held out: ``text``, ``toxic`` and ``part`` (0 to 99).

    Of near copies among them one is kept, or the words of a copied document would seem telling.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .dropna()
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
        .filter(~held_out("id"))
    )
    share = min(1.0, most / max(1, known.count()))
    hashed = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000))
    chosen = known.filter(hashed < int(share * 1_000_000)).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(100)))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))
    marked = texts.join(F.broadcast(chosen), "id").select("id", "text", "toxic", "part")
    marked = marked.mapInArrow(_copy_keys, "id long, text string, toxic int, part long, k1 long, k2 long")
    for key in ("k1", "k2"):
        row = F.min(F.struct(*[c for c in marked.columns if c != key])).alias("row")
        marked = marked.groupBy(key).agg(row).select("row.*")
    return marked.select("text", "toxic", "part")


def _lexicon(training: DataFrame) -> np.ndarray:
    sizes = {bool(r[0]): r[1] for r in training.groupBy(F.col("toxic") > 0).count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        return np.empty(0, np.uint64)
    n1, n0 = float(sizes[True]), float(sizes[False])
    counted = training.select("text", (F.col("toxic") > 0).alias("toxic")).mapInArrow(_count, "feature long, toxic long, fine long")
    summed = counted.groupBy("feature").agg(F.sum("toxic").cast("double").alias("a"), F.sum("fine").cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    all_ = n0 + n1
    evidence = 2 * (
        _sum(a, (a + b) * (n1 / all_)) + _sum(b, (a + b) * (n0 / all_))
        + _sum(n1 - a, (all_ - a - b) * (n1 / all_)) + _sum(n0 - b, (all_ - a - b) * (n0 / all_))
    )
    ratio = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
    # Entries beyond chance: their number is bounded by the sampled documents' words over the evidence.
    rows = summed.filter((evidence >= EVIDENCE) & (ratio >= RATIO)).select("feature").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _chain_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Chains with matches, with what the field needs of each."""
    base = len(model.lexicon)
    for batch in slices(batches, "text", SLICE_BYTES):
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        first, length, document, triples = model.chains(_tokens(batch.column("text")))
        row, place, feature = (np.concatenate(x) for x in zip(*triples[:-1]))
        order = np.argsort(row, kind="stable")
        edges = np.searchsorted(row[order], np.arange(len(first) + 1))
        out = [
            (int(length[i]), int(toxic[document[i]] > 0), place[order[a:b]].tolist(), feature[order[a:b]].tolist())
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))
        ]
        types = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["length", "toxic", "place", "feature"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)


def _odds(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        odds, _, _ = model.tag(_tokens(batch.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array(odds), batch.column("toxic")], names=["odds", "toxic"])


def _curve(odds: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic regression by Newton's steps, slightly penalised."""
    x = np.stack([np.ones_like(odds), odds], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (toxic - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(0.0, w[1]))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, chains: int = CHAINS) -> Model:
    """Fit the model on about ``most`` of the labelled documents that are not held out.

    Only bounded things reach the driver: the lexicon, at most ``chains`` chains of 64 tokens, and two
    numbers for each document of the curve's share. Without documents of both labels all scores are 0.
    """
    from tidemark.session import written

    prepare(docs.sparkSession)
    training = written(_training(docs, labels, most), "training")
    learn, rest = training.filter(F.col("part") >= CURVE_SHARE), training.filter(F.col("part") < CURVE_SHARE)
    model = Model(lexicon=_lexicon(learn))
    if not len(model.lexicon):
        return model
    base = len(model.lexicon)
    found = learn.select("text", "toxic").mapInArrow(
        lambda it: _chain_rows(it, model), "length int, toxic int, place array<int>, feature array<int>"
    )
    rows = found.limit(chains).collect()
    lengths = np.array([r[0] for r in rows])
    tags = np.zeros((len(rows), CHAIN), np.int64)
    triples = []
    for i, (_, toxic, place, feature) in enumerate(rows):
        place, feature = np.array(place), np.array(feature)
        triples.append((np.full(len(place), i), place, feature))
        if toxic:
            tags[i, place[feature < base]] = 1
    every = np.repeat(np.arange(len(rows)), lengths)
    spots = np.arange(len(every)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    triples.append((every, spots, np.full(len(every), base + _KINDS + 2)))
    model.weights, model.chain = train(triples, base + _KINDS + 3, tags, lengths)
    pairs = rest.select("text", "toxic").mapInArrow(lambda it: _odds(it, model), "odds double, toxic int").collect()
    odds, toxic = np.array([r[0] for r in pairs]), np.array([r[1] > 0 for r in pairs], float)
    if len(pairs) and 0 < toxic.sum() < len(toxic):
        model.curve = _curve(odds, toxic)
    else:
        model.curve = (0.0, 1.0)
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        words = _tokens(batch.column("text"))
        odds, token, _ = model.tag(words)
        score = model.score(odds)
        spans: list[list[str]] = [[] for _ in range(batch.num_rows)]
        if len(token):
            starts = (words.data & 0xC0) != 0x80
            before = np.zeros(len(words.data) + 1, np.int64)
            np.cumsum(starts, out=before[1:])
            _, offsets = text_bytes(batch.column("text"))
            token = np.sort(token)
            owner = np.searchsorted(words.first, token, side="right") - 1
            for o, a, b in zip(owner.tolist(), words.start[token].tolist(), words.end[token].tolist()):
                zero = before[offsets[o]]
                spans[o].append(f"{before[a] - zero}:{before[b] - zero}")
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(score),
                pa.array((score >= threshold).astype(np.int32)),
                pa.array([",".join(s) for s in spans]),
            ],
            names=["doc_id", "held_out", "score", "predicted", "spans"],
        )


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` and ``spans`` of every document.

    ``spans`` lists the offending tokens as start:end in code points, joined by commas. Only texts enter a
    score. Null texts are empty; an empty text has the score of one without toxic tokens. Labels that
    repeat a document count as toxic if one of them is; null labels are ignored.
    """
    prepare(docs.sparkSession)
    model = model or fit(docs, labels)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), whole_text().alias("text"))
    return keyed.mapInArrow(lambda it: _scored(it, model, threshold), RESULT)


def _fine(
    batches: Iterator[pa.RecordBatch], model: Model, threshold: float, text: str, width: int
) -> Iterator[pa.RecordBatch]:
    """The first ``width`` columns of the rows whose column ``text`` scores below the threshold."""
    for batch in slices(batches, text, SLICE_BYTES):
        odds, _, _ = model.tag(_tokens(batch.column(text)))
        kept = batch.filter(pa.array(model.score(odds) < threshold))
        yield kept.select(batch.schema.names[:width])


def keep_fine(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``threshold``.

    Null and empty texts have no toxic token and stay, rows that repeat are judged alike, an empty table stays
    empty. Other columns are carried along, whatever their names.
    """
    prepare(docs.sparkSession)
    # By place, since workers take no names with dots.
    places = [str(i) for i in range(len(docs.columns))]
    # Texts go to a worker once: nulls among them count as empty there.
    texts = [place for place, (name, kind) in zip(places, docs.dtypes) if (name.lower(), kind) == ("text", "string")]
    if len(texts) == 1:
        numbered, text = docs.toDF(*places), texts[0]
    else:
        text = "text"
        numbered = docs.withColumn(free_names(docs, "text_")[0], whole_text()).toDF(*places, text)
    kept = numbered.mapInArrow(lambda it: _fine(it, model, threshold, text, len(places)), numbered.select(*places).schema)
    return kept.toDF(*docs.columns)
