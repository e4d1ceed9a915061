"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
WORD_MULTIPLIER = np.uint64(0xC2B2AE3D27D4EB4F)

#: True for bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Texts beyond this are taken in parts where whole lists of their words would be large.
PIECE_BYTES = 1 << 22

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to ``count`` of an odd number and of its inverse, modulo 2**64."""
    kept = _POWERS.get(int(base))
    if kept is None or len(kept[0]) <= count:
        size = 1 << max(16, int(count).bit_length())
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(int(base), -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        kept = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 1 << 23:  # tables for a rare long text are not kept
            _POWERS[int(base)] = kept
    return kept


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """``data[start[i]:end[i]]`` is word i; the words of text t are ``first[t]`` to ``first[t + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of the bytes of each word."""
        up, down = powers(MULTIPLIER, len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])


def split(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = NOT_SPACE) -> Words:
    """Words of the texts ``data[offsets[t]:offsets[t + 1]]``; no word spans two texts."""
    inside = in_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive words; entry i covers words i to i + n - 1."""
    count = max(0, len(hashes) - n + 1)
    up, down = powers(WORD_MULTIPLIER, len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:count]) * down[:count]) if count else np.empty(0, np.uint64)


def gram_places(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word, within the text, of every run of ``n`` words that stays in its text."""
    runs = np.maximum(counts - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), runs)
    ends = np.cumsum(runs)
    return text, np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - runs, runs)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        values = np.minimum(values[:-step], values[step:])
        reach += step
    return values


def spaced(words: Words) -> Words:
    """The same words with one space after each, so that equal sequences are equal bytes."""
    lengths = words.end - words.start + 1
    end = np.cumsum(lengths) - 1
    data = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    if len(end):
        change = np.zeros(len(words.data) + 1, np.int8)
        change[words.start] += 1
        change[words.end] -= 1
        filled = np.ones(len(data), bool)
        filled[end] = False
        data[filled] = words.data[np.cumsum(change[:-1], dtype=np.int8).astype(bool)]
    return Words(data, end - lengths + 1, end, words.first)


def pieces(raw: bytes, most: int = PIECE_BYTES) -> Iterator[bytes]:
    """``raw`` in parts of at least ``most`` bytes that end after ASCII white space: the words of the parts are its words."""
    at = 0
    while len(raw) - at > most:
        end = at + most
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:] if at else raw
