"""Token ids of whole texts with a public tokenizer.

Both vocabularies split a text into pre-tokens by a published pattern and
encode each pre-token on its own, so the ids of a text are the ids of its
pre-tokens, one after another; each distinct pre-token is encoded once per
worker and kept in a bounded two-generation cache.  A text of characters below
U+0250 without odd controls is split here by that pattern.  Any other text is
cut at every space that precedes a non-space, where a pre-token always starts,
and its chunks go through the whole tokenizer.  A text that holds a special
token's string goes through it uncut.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

END_BITS = 65536
_WIDE_GAP = re.compile(r" (?:\s|$)")
_CUT = re.compile(r" (?=\S)")

# Below U+0250 these are all the numbers; every other word character but "_" is a letter.
# Classes are written out, as a set without escapes is one look-up a character.
_NUMBERS = "0-9²³¹¼½¾"
_BELOW = "".join(map(chr, range(0x250)))
_LETTER, _OTHER, _SPACE = ("[" + re.escape("".join(re.findall(c, _BELOW))) + "]" for c in (rf"[^\W_{_NUMBERS}]", r"_|[^\w\s]", r"\s"))
_SUFFIX = "'(?:[stmd]|re|ve|ll)"
_ODD = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]")
_JOINED = re.compile(rf"{_SUFFIX}| ?{_LETTER}+| ?[{_NUMBERS}]+| ?{_OTHER}+|{_SPACE}+(?!\S)|{_SPACE}+")
_BARE = re.compile(rf"{_LETTER}+|[{_NUMBERS}]|{_SUFFIX}|{_OTHER}+")

# The vocabularies write a byte as a printable character: itself if it is one,
# else the next free code point from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = [b for b in range(256) if b not in _PRINTABLE]
_BYTE_CHARS = [chr(b if b in _PRINTABLE else 256 + _HIDDEN.index(b)) for b in range(256)]
_AS_BYTES = ["".join(_BYTE_CHARS[b] for b in c.encode("utf-8")) for c in _BELOW]


class _Pieces(dict):
    """Ids of pre-tokens; one not seen yet comes from the older generation or the model."""

    def __init__(self, old: dict[str, bytes], encode):
        self.old, self.encode = old, encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        self[piece] = ids
        return ids


class ChunkEncoder:
    """Ids of texts as little-endian bytes (``dtype``: 16 bits if they fit).

    ``space_joined``: a pre-token takes the space before it (byte level
    vocabulary); otherwise the text is lower-cased and white space carries no
    id.
    """

    def __init__(self, path: str, space_joined: bool, cache_size: int = 400_000):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.space_joined = space_joined
        self.lead = " " if space_joined else ""
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= END_BITS else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.cache_size = cache_size
        self.pieces = _Pieces({}, self._model)
        self.chunks: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}       # young, old

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _model(self, piece: str) -> bytes:
        """Ids of a single pre-token, by the vocabulary's merges alone."""
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(piece.translate(_AS_BYTES))]).tobytes()

    def _look_up(self, parts: list[str], cache: tuple[dict, dict], encode) -> list[bytes]:
        young, old = cache
        found = list(map(young.get, parts))
        if None in found:
            at = [i for i, v in enumerate(found) if v is None]
            missing = {parts[i] for i in at}
            young.update((p, old[p]) for p in missing if p in old)
            new = [p for p in missing if p not in young]
            young.update(zip(new, encode(new)))
            for i in at:
                found[i] = young[parts[i]]
        return found

    def _text(self, text: str) -> bytes | None:
        """Ids of a text that the pattern here can split, else None."""
        low = text if self.space_joined else text.lower()
        if _ODD.search(low):
            return None
        return b"".join(map(self.pieces.__getitem__, (_JOINED if self.space_joined else _BARE).findall(low)))

    def _cut(self, text: str) -> tuple[str, list[str]]:
        head, *tail = _CUT.split(text) if _WIDE_GAP.search(text) else text.split(" ")
        return head, tail

    def _bounded(self, cache: tuple[dict, dict]) -> tuple[dict, dict]:
        return ({}, cache[0]) if len(cache[0]) > self.cache_size else cache

    def encode(self, texts: list[str]) -> list[bytes]:
        self.chunks = self._bounded(self.chunks)
        if len(self.pieces) > self.cache_size:
            self.pieces.old = {}
            self.pieces = _Pieces(self.pieces, self._model)
        out: list[bytes | None] = [None] * len(texts)
        odd: list[tuple[int, str, list[str]]] = []
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                odd.append((i, t, []))
            else:
                out[i] = self._text(t)
                if out[i] is None:
                    odd.append((i, *self._cut(t)))
        heads = self._whole([head for _, head, _ in odd]) if odd else []
        chunk_ids = lambda keys: self._whole([self.lead + k for k in keys])
        for (i, _, tail), head in zip(odd, heads):
            out[i] = head + b"".join(self._look_up(tail, self.chunks, chunk_ids))
        return out


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, space_joined: bool) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file (one per process)."""
    key = (path, space_joined)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, space_joined)
    return _ENCODERS[key]
