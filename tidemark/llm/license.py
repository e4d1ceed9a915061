"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Of every ``GUARANTEE`` - ``GRAM`` + 1 consecutive word grams of a template the one with the least hash enters an
inverted index. Every gram of a document is looked up in it, so a run of ``GUARANTEE`` template words never
goes unnoticed. Hits of one template on nearby diagonals form a candidate, and a local alignment within
a band around them reports how much of the template is matched, and where.

The templates are a parameter, small enough to go along with the tasks; documents are read once and not
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, slices, whole_text
from tidemark.llm.words import Words, gram_places, grams, sliding_min, split, text_bytes

GRAM = 3
GUARANTEE = 6
BAND = 8
COVERAGE = 0.7
#: Most words of a template, so that an alignment stays small.
TEMPLATE_WORDS = 2_000

# Opening words and short notices of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "rights-reserved": "All rights reserved.",
}

_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x41:0x5B] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

RESULT = "doc_id long, license string, coverage double, n_matched int, start int, end int"


@dataclass
class Index:
    """Ascending gram hashes with the template and place of each, and the templates' word hashes."""

    names: list[str]
    words: list[list[int]]
    grams: np.ndarray
    template: np.ndarray
    place: np.ndarray


def _words(texts: pa.Array) -> Words:
    data, offsets = text_bytes(texts)
    return split(_LOWER[data], offsets, _IN_WORD)


def build_index(templates: dict[str, str], gram: int = GRAM, guarantee: int = GUARANTEE) -> Index:
    """The winnowed grams of all templates. A template shorter than ``guarantee`` words keeps its least gram;
    one shorter than ``gram`` cannot be found and is refused."""
    names = sorted(templates)
    words = _words(pa.array([templates[n] for n in names], pa.large_string()))
    hashes, rows = words.hashes(), []
    listed = []
    for i, name in enumerate(names):
        own = hashes[words.first[i] : words.first[i + 1]]
        if not gram <= len(own) <= TEMPLATE_WORDS:
            raise ValueError(f"template {name} has {len(own)} words")
        listed.append(own.tolist())
        values = grams(own, gram)
        least = set(sliding_min(values, min(guarantee - gram + 1, len(values))).tolist())
        rows += [(v, i, place) for place, v in enumerate(values.tolist()) if v in least]
    rows.sort()
    values, template, place = zip(*rows) if rows else ((), (), ())
    return Index(names, listed, np.array(values, np.uint64), np.array(template, np.int64), np.array(place, np.int64))


def align(template: list[int], words: list[int], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, end) of the best local alignment of ``template`` with ``words`` in which
    template word i meets a word no further than ``band`` from i + ``diagonal``.

    A match counts 2, a replaced, missing or added word -1; of equal scores the earliest is taken.
    """
    best = (0, 0, 0, 0)
    width = 2 * band + 1
    # (score, matched, first word) for every offset in the band of the row above
    above = [(0, 0, -1)] * width
    for i, wanted in enumerate(template):
        row: list[tuple[int, int, int]] = []
        for k in range(width):
            j = i + diagonal - band + k
            choice = (0, 0, -1)
            if 0 <= j < len(words):
                score, matched, first = above[k]
                if words[j] == wanted:
                    choice = (score + 2, matched + 1, first if first >= 0 else j)
                elif score > 1:
                    choice = (score - 1, matched, first)
                if k + 1 < width and above[k + 1][0] - 1 > choice[0]:
                    choice = (above[k + 1][0] - 1, *above[k + 1][1:])
                if k and row[k - 1][0] - 1 > choice[0]:
                    choice = (row[k - 1][0] - 1, *row[k - 1][1:])
                if words[j] == wanted and choice[0] > best[0]:
                    best = (*choice, j + 1)
            row.append(choice)
        above = row
    return best[1], best[2], best[3]


def _matches(index: Index, words: list[int], hits: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int, int]]:
    """(template, matched, first, end) of all matches in a document, none inside a larger one.

    ``hits`` are (template, template place, document place).
    """
    found = set()
    hits = sorted((t, d - p) for t, p, d in hits)
    for i, (template, diagonal) in enumerate(hits):
        if i and hits[i - 1][0] == template and diagonal - hits[i - 1][1] <= 0:
            continue
        size = len(index.words[template])
        low = max(0, diagonal - BAND)
        part = words[low : diagonal + size + BAND]
        # The band may cover several copies: what one has taken is masked before the next is looked for.
        while True:
            matched, first, end = align(index.words[template], part, diagonal - low)
            if not matched or matched < least * size:
                break
            found.add((template, matched, low + first, low + end))
            part[first:end] = [-1] * (end - first)
    kept: list[tuple[int, int, int, int]] = []
    taken: set[int] = set()
    for match in sorted(found, key=lambda m: (-m[1], m[2], m[0])):
        span = range(match[2], match[3])
        if not any(w in taken for w in span):
            kept.append(match)
            taken.update(span)
    return sorted(kept, key=lambda m: m[2])


def _scan(batches: Iterator[pa.RecordBatch], index: Index, gram: int, least: float) -> Iterator[pa.RecordBatch]:
    sieve = np.zeros(1 << 16, bool)
    sieve[index.grams & np.uint64(0xFFFF)] = True
    for batch in slices(batches, "text"):
        words = _words(batch.column("text"))
        hashes = words.hashes()
        text, place = gram_places(words.counts, gram)
        values = grams(hashes, gram)[words.first[text] + place] if len(text) else np.empty(0, np.uint64)
        near = np.flatnonzero(sieve[values & np.uint64(0xFFFF)])
        begin = np.searchsorted(index.grams, values[near], "left")
        end = np.searchsorted(index.grams, values[near], "right")
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for at, a, b in zip(near.tolist(), begin.tolist(), end.tolist()):
            for row in range(a, b):
                hits.setdefault(int(text[at]), []).append((int(index.template[row]), int(index.place[row]), int(place[at])))
        out = []
        for document, own in hits.items():
            base = int(words.first[document])
            listed = hashes[base : int(words.first[document + 1])].tolist()
            content = None
            for template, matched, first, stop in _matches(index, listed, own, least):
                if content is None:
                    content = batch.column("text")[document].as_py().encode()
                    zero = int(text_bytes(batch.column("text"))[1][document])
                    doc_id = batch.column("doc_id")[document].as_py()
                start = len(content[: int(words.start[base + first]) - zero].decode())
                finish = len(content[: int(words.end[base + stop - 1]) - zero].decode())
                out.append((doc_id, index.names[template], matched / len(index.words[template]), matched, start, finish))
        types = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
        names = ["doc_id", "license", "coverage", "n_matched", "start", "end"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, gram: int = GRAM, guarantee: int = GUARANTEE
) -> DataFrame:
    """A row for every license text found: ``doc_id``, ``license``, ``coverage`` (share of the template's words
    that are matched), ``n_matched``, ``start`` and ``end`` (code points, end exclusive).

    Words are lower-cased runs of letters, digits and characters beyond ASCII. Of overlapping matches the
    one with more matched words is reported. Null and empty texts give no rows; repeated rows repeat.
    Other columns are not looked at.
    """
    prepare(docs.sparkSession)
    index = build_index(templates or TEMPLATES, gram, guarantee)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return keyed.mapInArrow(lambda it: _scan(it, index, gram, coverage), RESULT)
