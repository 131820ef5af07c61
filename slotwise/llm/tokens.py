"""Token ids of whole texts, with a bounded cache of the pieces between safe cuts.

Byte-pair encoding works within pre-tokens, and no pre-token of the two tokenizers reaches over a cut made
here, so the ids of a text are those of its pieces one after the other.  Words repeat, so most pieces
come from the cache; new words go to the tokenizer's model directly, all other new pieces through the whole
tokenizer.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces held per worker, in two generations: when the younger one is full it becomes the older one, which
#: goes.  Memory is bounded, frequent pieces stay, and results don't change.
CACHE = 900_000
#: A piece longer than this isn't held.
HELD = 64
#: White space, and signs that only some count as white space or that break a cut.
_ODD = re.compile("[\\s\u0085\u180e\u200b-\u200d\u2060\ufeff]")
#: A word of letters, perhaps with a run of signs after it: two pre-tokens.  The letters' lower case is one letter in any context, and they never compose.
_WORD = re.compile("( ?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\\[-^`{-~]*)")


def _byte_signs() -> dict[int, int]:
    """The printable sign that byte-level models use for every byte: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


class Pieces(dict):
    """Ids of pieces; those not known yet are encoded.  A piece that can't stand alone has ``None``."""

    def __init__(self, tokenizer, spaced: bool, limit: int):
        super().__init__()
        self.tokenizer, self.model, self.spaced, self.limit = tokenizer, tokenizer.model, spaced, limit
        self.older: dict[str, bytes | None] = {}
        self.signs = _byte_signs()
        self.space = chr(self.signs[ord(" ")])

    def __missing__(self, piece: str) -> bytes | None:
        ids = self.older[piece] if piece in self.older else self._encoded(piece)
        if len(piece) <= HELD:
            if len(self) >= self.limit // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def _encoded(self, piece: str) -> bytes | None:
        m = _WORD.fullmatch(piece)
        if m:
            space, word, run = m.groups()
            if run:
                return self[space + word] + self[run]
            return _bytes([t.id for t in self.model.tokenize(self._as_signs(piece if self.spaced else word.lower()))])
        if self.spaced and piece != "\n":
            word = piece[1:] if piece[:1] == " " else piece
            if not word or _ODD.search(word):
                return None
        return _bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _as_signs(self, piece: str) -> str:
        if piece.isascii():
            return piece.replace(" ", self.space)
        return piece.encode().decode("latin-1").translate(self.signs)


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``spaced``: a pre-token takes the space before it; otherwise white space is dropped and case ignored.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [str(t) for t in self.tokenizer.get_added_tokens_decoder().values()]
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # pieces are held here; a second cache of rare words only costs
        kind = str(self.tokenizer.pre_tokenizer)
        self.spaced = kind.startswith("ByteLevel") and "add_prefix_space=False" in kind
        self.known = Pieces(self.tokenizer, self.spaced, cache)

    def pieces(self, text: str) -> list[str]:
        """Cuts before spaces and around line breaks."""
        if self.spaced:
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return text.replace("\n", " ").split(" ")

    def encode(self, text: str) -> bytes:
        for mark in self.marks:
            if mark in text:  # stands for an id of its own, wherever it is
                return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.spaced and "\0" in text:
            return self._whole(text)
        try:
            return b"".join(map(self.known.__getitem__, self.pieces(text)))
        except TypeError:  # a piece that can't stand alone: more than one space, or odd signs
            return self._whole(text)

    def _whole(self, text: str) -> bytes:
        """Cuts only before spaces between visible characters, with odd signs about not even there."""
        parts = [text] if "\0" in text or re.search("[\u0085\u180e\u200b-\u200d\u2060\ufeff]", text) else re.split(r"(?<=\S)(?= \S)", text)
        return b"".join(_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False))

    def ids(self, texts: list[str]) -> list[bytes]:
        return [self.encode(text) for text in texts]

    def joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and their number for each text; each different piece is looked up once."""
        whole = {i: self.encode(t) for i, t in enumerate(texts) if any(m in t for m in self.marks) or (self.spaced and "\0" in t)}
        cut = ["" if i in whole else t for i, t in enumerate(texts)]
        if self.spaced:
            cut = [t.replace(" ", "\0 ").replace("\n", "\0\n\0") for t in cut]
        else:
            cut = [t.replace("\n", " ") for t in cut]
        split = pc.split_pattern(pa.array(cut, pa.large_string()), "\0" if self.spaced else " ")
        pieces, bounds = split.values.dictionary_encode(), split.offsets.to_numpy()
        known = list(map(self.known.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False)))
        at, odd = pieces.indices.to_numpy(), np.array([x is None for x in known], bool)
        for i in np.unique(np.searchsorted(bounds, np.flatnonzero(odd[at]), "right") - 1).tolist():
            whole[i] = self._whole(texts[i])
        size = np.array([len(x or b"") // 4 for x in known], np.int64)
        pool, first, sizes = np.frombuffer(b"".join(x or b"" for x in known), "<u4"), np.cumsum(size) - size, size[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids, edges = pool[np.repeat(first[at] - ends[:-1], sizes) + np.arange(ends[-1])], ends[bounds]
        if whole:
            parts = [np.frombuffer(whole[i], "<u4") if i in whole else ids[a:b] for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, np.diff(edges)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(column: pa.Array, chars: int = 8_000_000) -> Iterable[tuple[int, list[str]]]:
    """Runs of texts of a column with about ``chars`` characters each: (first row, texts)."""
    held, size, first = [], 0, 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= chars:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held
