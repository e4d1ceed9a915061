"""Token ids of many texts by the tokenizers library, each distinct piece encoded once per worker.

Byte-level BPE first cuts a text by a fixed pattern and never merges across the cuts. Some cuts can be
told from two neighbouring bytes: before white space that follows something else, after a lone line
feed, and between an ASCII letter and punctuation. The pieces between those cuts are encoded on their own,
with the same ids as in the text.

A tokenizer's added tokens, such as an end-of-text mark, are looked for in the text before that pattern. A text that
holds one is encoded whole.
"""

from __future__ import annotations

import json
import os
import struct

import numpy as np
import pyarrow as pa

#: Pieces a worker remembers before the older half goes; bounds memory, never results.
REMEMBERED = 400_000
#: Id of a line feed in joined pieces, found when a tokenizer is loaded.
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_SIGN = np.zeros(256, bool)
_SIGN[0x21:0x7F] = True
_SIGN[0x30:0x3A] = _SIGN[0x41:0x5B] = _SIGN[0x61:0x7B] = False
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
#: First bytes of two-byte letters that are no white space (U+00C0 to U+017F).
_LATIN = np.zeros(256, bool)
_LATIN[0xC3:0xC6] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending places at which the texts ``data[offsets[t]:offsets[t + 1]]`` may be cut, offsets included."""
    if len(data) < 3:
        return np.unique(offsets)
    left, here, right = data[:-2], data[1:-1], data[2:]
    # A byte that ends, or begins, something other than white space.
    ends = _VISIBLE[data]
    ends[1:] |= _LATIN[data[:-1]]
    begins = _VISIBLE[data] | _LATIN[data]
    gap = (here == 0x20) | (here == 0x0A)
    alone = gap & ends[:-2] & begins[2:]
    marks = np.zeros(len(data) + 1, bool)
    marks[1:-2] |= alone
    marks[2:-1] |= alone & (here == 0x0A)
    marks[1:-1] |= _LETTER[data[:-1]] & _SIGN[data[1:]]
    marks[offsets] = True
    return np.flatnonzero(marks)


class Encoder:
    """Encodes texts with one tokenizer file; ``path`` names a file every worker can read."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in added if t.content]
        # Where the normalised text is searched, the text itself does not show what is found.
        self.hidden = self.tokenizer.normalizer is not None and any(t.normalized for t in added)
        self.feed = [] if any(b"\n" in t for t in self.added) else self._plain("\n")
        shape = json.loads(self.tokenizer.to_str())
        # The model alone knows words of byte letters; U+0120 stands for the space.
        cut = shape["pre_tokenizer"] or {}
        self.spaced = (
            shape["normalizer"] is None
            and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
            and not any(t.strip().isalpha() for t in self.added)
        )
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, piece: bytes) -> bytes:
        return np.array(self._plain(piece.decode()), "<u4").tobytes()

    def _learn(self, pieces: list[bytes]) -> None:
        if self.spaced:
            # One run of ASCII letters behind a space is one piece to the tokenizer too.
            words = [p for p in pieces if p[0] == 0x20 and p[1:].isalpha()]
            for piece in words:
                found = self.tokenizer.model.tokenize("\u0120" + piece[1:].decode())
                self.known[piece] = struct.pack(f"<{len(found)}I", *[t.id for t in found])
            pieces = [p for p in pieces if p not in self.known]
        joinable = [p for p in pieces if len(p.split()) == 1 and p.strip() == p.lstrip(b" ") and p[:2] != b"  "]
        if len(self.feed) == 1:
            joined = [joinable[i : i + 512] for i in range(0, len(joinable), 512)]
            texts = [b"\n".join(group).decode() for group in joined]
            for group, found in zip(joined, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(found.ids, "<u4")
                stops = np.append(np.flatnonzero(ids == self.feed[0]), len(ids)).tolist()
                if len(stops) == len(group):
                    at = 0
                    for piece, stop in zip(group, stops):
                        self.known[piece] = ids[at:stop].tobytes()
                        at = stop + 1
        rest = [p for p in pieces if p not in self.known]
        for piece, found in zip(rest, self.tokenizer.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False)):
            self.known[piece] = np.array(found.ids, "<u4").tobytes()

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts may hold an added token."""
        found = np.full(len(offsets) - 1, self.hidden)
        if self.hidden or not len(data):
            return found
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right")) - 1
                inside = at + len(token) <= offsets[text + 1]
                found[text] |= inside
                at = raw.find(token, int(offsets[text + 1]) if inside else at + 1)
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text begins among them."""
        whole, places = self._whole(data, offsets), cuts(data, offsets)
        if whole.any():
            kept = ~np.append(whole, False)[np.searchsorted(offsets, places, "right") - 1]
            places = places[kept | np.isin(places, offsets)]
        if len(places) < 2:
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        own: dict[bytes, bytes] = {}
        if whole.any():
            own = {p: self._bytes(p) for p in distinct if self.hidden or any(t in p for t in self.added)}
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        for p in distinct:
            if p not in self.known and p in self.older:
                self.known[p] = self.older[p]
        if missing := [p for p in distinct if p not in self.known and p not in own]:
            self._learn(missing)
        codes = [own[p] if p in own else self.known[p] for p in distinct]
        ids = np.frombuffer(b"".join(codes), "<u4")
        lengths = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        begin = np.cumsum(lengths) - lengths
        which = pieces.indices.to_numpy()
        counts = lengths[which]
        ends = np.cumsum(counts)
        spread = np.repeat(begin[which] - (ends - counts), counts) + np.arange(ends[-1])
        first = np.concatenate([[0], ends])[np.searchsorted(places, offsets)]
        return ids[spread], first


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
