"""Patched frame-of-reference blocks for token ids.

A segment holds whole documents::

    magic 'PFR1' | documents u32 | tokens u64 | blocks u32
    doc ids i64 x documents | tokens per document u32 x documents
    block starts u32 x blocks, in bytes from the first block
    blocks

A block covers ``BLOCK`` consecutive ids; the last one is filled up with its last id::

    minimum u32 | width u8 | exceptions u16 | low ``width`` bits of every id minus the minimum
    | place u16 x exceptions | high bits u32 x exceptions

The width is that of the ``percentile`` of the block's differences; the few larger ones keep their low bits in
place and their high bits in the exception list. All numbers are little-endian.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
PERCENTILE = 95
MAGIC = b"PFR1"
HEAD_TYPE = np.dtype([("least", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
HEAD = HEAD_TYPE.itemsize


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits needed by each value."""
    return np.where(values == 0, 0, np.floor(np.log2(np.maximum(values, 1))).astype(np.int64) + 1)


def _blocks(ids: np.ndarray, percentile: int) -> tuple[bytes, np.ndarray]:
    """All blocks one after another, and the size of each."""
    count = -(-len(ids) // BLOCK)
    if not count:
        return b"", np.empty(0, np.int64)
    padded = np.full(count * BLOCK, ids[-1], np.int64)
    padded[: len(ids)] = ids
    table = padded.reshape(count, BLOCK)
    least = table.min(axis=1)
    deltas = table - least[:, None]
    at = max(0, -(-BLOCK * percentile // 100) - 1)
    widths = _widths(np.partition(deltas, at, axis=1)[:, at])
    high = deltas >> widths[:, None]
    row, place = np.nonzero(high)
    exceptions = np.bincount(row, minlength=count)
    bodies = BLOCK * widths // 8
    sizes = HEAD + bodies + 6 * exceptions
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    heads = np.zeros(count, HEAD_TYPE)
    heads["least"], heads["width"], heads["exceptions"] = least, widths, exceptions
    out[starts[:, None] + np.arange(HEAD)] = heads.view(np.uint8).reshape(count, HEAD)
    for width in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == width)
        packed = _pack(deltas[rows], width).view(np.uint8).reshape(len(rows), -1)
        out[(starts[rows] + HEAD)[:, None] + np.arange(BLOCK * width // 8)] = packed
    places, values = _exception_places(starts + HEAD + bodies, exceptions)
    out[places[:, None] + np.arange(2)] = place.astype("<u2").view(np.uint8).reshape(-1, 2)
    out[values[:, None] + np.arange(4)] = high[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), sizes


def _exception_places(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the place and the high bits of every exception stand, given where each block's exceptions begin."""
    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.repeat(first, counts)
    return begin + 2 * nth, begin + np.repeat(2 * counts, counts) + 4 * nth


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each row's values one after another, in 64-bit words; all rows at once."""
    words = np.zeros((BLOCK * width // 64, len(values)), np.uint64)
    columns = (values & ((1 << width) - 1)).astype(np.uint64).T.copy()
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        words[word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8")


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    words = packed.T.copy()
    columns = np.empty((BLOCK, packed.shape[0]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value |= words[word + 1] << np.uint64(64 - shift)
        columns[i] = value & mask
    return columns.T.astype(np.int64)


def encode_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """A segment of documents with ``lengths`` ids each, given one after another."""
    if len(ids) != int(np.sum(lengths)):
        raise ValueError("lengths do not add up to the ids")
    blocks, sizes = _blocks(np.asarray(ids, np.int64), percentile)
    return b"".join(
        [
            MAGIC,
            np.uint32(len(lengths)).tobytes(),
            np.uint64(len(ids)).tobytes(),
            np.uint32(len(sizes)).tobytes(),
            np.asarray(doc_ids, "<i8").tobytes(),
            np.asarray(lengths, "<u4").tobytes(),
            (np.cumsum(sizes) - sizes).astype("<u4").tobytes(),
            blocks,
        ]
    )


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc_ids``, ``lengths`` and ``ids`` of a segment."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    documents = int(np.frombuffer(data, "<u4", 1, 4)[0])
    tokens = int(np.frombuffer(data, "<u8", 1, 8)[0])
    count = int(np.frombuffer(data, "<u4", 1, 16)[0])
    at = 20
    doc_ids = np.frombuffer(data, "<i8", documents, at)
    lengths = np.frombuffer(data, "<u4", documents, at + 8 * documents).astype(np.int64)
    at += 12 * documents
    starts = np.frombuffer(data, "<u4", count, at).astype(np.int64) + at + 4 * count
    raw = np.frombuffer(data, np.uint8)
    heads = raw[starts[:, None] + np.arange(HEAD)].reshape(-1).view(HEAD_TYPE)
    least, widths, exceptions = (heads[name].astype(np.int64) for name in HEAD_TYPE.names)
    ids = np.zeros(count * BLOCK, np.int64)
    table = ids.reshape(count, BLOCK)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        if width:
            packed = raw[(starts[rows] + HEAD)[:, None] + np.arange(BLOCK * width // 8)]
            table[rows] = _unpack(packed.view("<u8"), width)
    places, values = _exception_places(starts + HEAD + BLOCK * widths // 8, exceptions)
    row = np.repeat(np.arange(count), exceptions)
    place = raw[places[:, None] + np.arange(2)].reshape(-1).view("<u2")
    table[row, place] += raw[values[:, None] + np.arange(4)].reshape(-1).view("<u4").astype(np.int64) << widths[row]
    table += least[:, None]
    return doc_ids, lengths, ids[:tokens].astype(np.uint32)
