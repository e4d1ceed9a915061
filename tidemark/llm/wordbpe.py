"""Token ids by the tokenizers library for vocabularies whose tokens end with words.

Such a tokenizer drops white space and cuts words at a fixed pattern, so the ids of a text are those of its white-space
words one after another, and a word of letters followed by signs is the letters, then the signs. Words are looked
up in a memory of what the worker has encoded; lower-case Latin words it does not know go straight to the model,
everything else through the whole tokenizer. Texts of other tokenizers are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np

#: Words remembered before the older half is dropped; bounds memory, never results.
REMEMBERED = 1_000_000
#: Fixed value: the pattern by which these vocabularies cut words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Lower-case letters a-z and U+00DF to U+00FF, then ASCII signs other than the apostrophe.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: itself where printable, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: b if b in printable else 0x100 + others.index(b) for b in range(256)}


def _packed(tokens: list) -> bytes:
    return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])


class _Memory(dict):
    """Ids of words, learned when first asked for; the older half goes when the newer one is full."""

    def __init__(self, encoder: WordEncoder) -> None:
        self.encoder, self.older = encoder, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encoder.learn(word)
        if len(self) >= REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordEncoder:
    """Encodes texts with one tokenizer file; ``path`` names a file every worker can read."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.suffix = getattr(self.model, "end_of_word_suffix", None)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.added = [t.content.encode() for t in added]
        plain_marks = all(not (t.normalized or t.lstrip or t.rstrip or t.single_word) and not t.content.split()[1:] for t in added)
        self.by_word = plain_marks and self._drops_space()
        self.known = _Memory(self)

    def _drops_space(self) -> bool:
        shape = json.loads(self.tokenizer.to_str())
        cut = ((shape["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        folds = [n.get("type") for n in (shape["normalizer"] or {}).get("normalizers", [])]
        return (
            bool(self.suffix)
            and folds == ["NFC", "Replace", "Lowercase"]
            and cut.get("pattern") == {"Regex": WORD_PATTERN}
            and (cut.get("behavior"), cut.get("invert")) == ("Removed", True)
        )

    def _whole(self, raw: bytes) -> bytes:
        return np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, word: bytes) -> bytes:
        # Most words are ASCII letters, alone or with one sign; ``words`` come lower-cased unless a mark is near.
        if word.isalpha() and word.islower():
            return _packed(self.model.tokenize(word.decode()))
        if found := _PLAIN.fullmatch(word):
            stem, signs = found.groups()
            if signs:
                return self.known[stem] + self.known[signs]
            return _packed(self.model.tokenize(stem.decode("latin-1").translate(self.letters)))
        return self._whole(word)

    def encode(self, pieces: Iterator[bytes]) -> bytes:
        """Ids of a text, as little-endian 32-bit numbers. ``pieces`` is the text cut at white space."""
        if not self.by_word:
            return self._whole(b"".join(pieces))
        out = []
        for raw in pieces:
            low = raw.lower()
            # The tokenizer lower-cases anyway, but not its added tokens.
            words = (raw if any(t in low for t in self.added) else low).split()
            out.append(b"".join(map(self.known.__getitem__, words)))
        return b"".join(out)


_LOADED: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for ``path``, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]
