"""Exact token ids of whole texts, by a cache over the pieces between ASCII spaces.

The word-level vocabulary drops white space before it merges, so a text's ids are the ids
of its space-separated pieces in order.  Each worker encodes a distinct piece once.  Whether a
vocabulary is of that kind is tried on load; texts are encoded whole for any other.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from ._common import worker_cache

DEFAULT_VOCABULARY = "word_bpe_49k.json"
_CACHED_PIECES = 500_000
#: Pieces without letters that normalisation could change in company, and without contractions.
_PLAIN = re.compile(r"[A-Za-z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF.,!?;:()\[\]*#$%&|+=/_@-]+")
_PARTS = re.compile(r"[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+")
_PROBES = ["The quick, brown fox; it's 12345 OLD.", "  two  spaces\nand\tlines ", "naïve Ünïcode ÇA 😀 中文字", "a-b_c/d+e=f (x) [y] #z @w 50% $9.99", "MiXeD CaSe don't we'll 'quoted' \"text\"", ""]
#: The name of the workers' cache of encoders.
ENCODERS = "encoders"
_encoders: dict[str, "Encoder"] = worker_cache(ENCODERS)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


class _Codes(dict):
    """Numbers pieces as they appear and remembers which still have to be encoded."""

    def __init__(self):
        self.pending: list = []

    def __missing__(self, piece) -> int:
        code = self[piece] = len(self)
        self.pending.append(piece)
        return code


class _Runs:
    """Runs of ids by number, in three growing arrays."""

    def __init__(self):
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.n + len(sizes) > len(self.starts):
            self.starts, self.sizes = np.append(self.starts, np.zeros_like(self.starts)), np.append(self.sizes, np.zeros_like(self.sizes))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.used : self.used + len(flat)] = flat
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.starts[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = self.n + len(sizes), self.used + len(flat)

    def take(self, numbers: np.ndarray) -> np.ndarray:
        """The runs of these numbers, one after the other."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.uint32)
        at = np.repeat(self.starts[numbers] - (ends - sizes), sizes)
        at += np.arange(int(ends[-1]))
        return self.ids[at]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._reset()
        self.by_piece = True
        self.by_piece = all(a.tolist() == e.ids for a, e in zip(self.encode(_PROBES), self.tokenizer.encode_batch(_PROBES, add_special_tokens=False)))
        self._reset()

    def _reset(self) -> None:
        self.codes, self.parts = _Codes(), _Codes()
        self.of_piece, self.of_part = _Runs(), _Runs()

    def _encode_parts(self) -> None:
        new = self.parts.pending
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                sizes = np.diff(ends, prepend=0)
            else:
                got = [e.ids for e in self.tokenizer.encode_batch(some, add_special_tokens=False)]
                sizes, ids = np.array([len(x) for x in got], np.int64), np.array([i for x in got for i in x], np.uint32)
            self.of_part.add(ids, sizes)
        new.clear()

    def _encode_pending(self) -> None:
        pending = self.codes.pending
        if not pending:
            return
        texts = [p.decode("utf-8", "replace") for p in pending]
        pending.clear()
        plain = [bool(_PLAIN.fullmatch(t)) for t in texts]
        split = [_PARTS.findall(t.lower()) for t, p in zip(texts, plain) if p]
        easy = np.array(plain)
        sizes = np.zeros(len(texts), np.int64)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        parts = np.fromiter(map(self.parts.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        self._encode_parts()
        got = self.tokenizer.encode_batch([t for t, p in zip(texts, plain) if not p], add_special_tokens=False)
        hard = [e.ids for e in got]
        part_sizes = self.of_part.sizes[parts]
        ends = np.cumsum(part_sizes)
        last = np.cumsum(counts)
        sizes[easy] = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], last])])
        sizes[~easy] = [len(x) for x in hard]
        flat = np.zeros(int(sizes.sum()), np.uint32)
        from_parts = np.repeat(easy, sizes)
        flat[from_parts] = self.of_part.take(parts)
        flat[~from_parts] = np.fromiter(chain.from_iterable(hard), np.uint32, int((~from_parts).sum()))
        self.of_piece.add(flat, sizes)

    def _numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.codes) > _CACHED_PIECES:
            self._reset()
        number = self.codes.__getitem__
        out = []
        for t in texts:
            pieces = t.encode("utf-8", "surrogatepass").split() if t else []
            out.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
        self._encode_pending()
        return out

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Ids per text; null is empty."""
        if not self.by_piece:
            return np.array([len(x) for x in self.encode(texts)], np.int64)
        return np.array([int(self.of_piece.sizes[c].sum()) for c in self._numbers(texts)], np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids per text."""
        if not self.by_piece:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        return [self.of_piece.take(c) for c in self._numbers(texts)]


def encoder(path: str) -> Encoder:
    """One per worker and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def text_groups(texts, limit: int = 2 << 20):
    """(first, end, texts) of an Arrow string column, in runs of about ``limit`` characters."""
    values = texts.to_pylist()
    at = size = 0
    for i, t in enumerate(values):
        size += len(t) if t else 0
        if size >= limit:
            yield at, i + 1, values[at : i + 1]
            at, size = i + 1, 0
    if at < len(values):
        yield at, len(values), values[at:]
