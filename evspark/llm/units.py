"""Cut texts where a byte-level tokenizer always cuts, so that encodings can be looked up by piece.

The byte-level pre-tokenizer never joins a non-space character with white space behind it. A text may therefore
be cut before every run of white space, and the ids of the pieces follow one another as the ids of the text.
A worker keeps the pieces that it has met; the library encodes the others, each batch in one call. Files of
another build (normaliser, another pre-tokenizer, sentencepiece) are encoded text by text.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np

# White space of the pre-tokenizer's pattern (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

KEPT_BYTES, ENTRY_BYTES = 224 << 20, 150
"""Memory of the pieces that one worker keeps with their ids or lengths, and what an entry takes besides its bytes; when it is used up,
the worker starts anew."""
MAX_UNIT_CHARS = 64
"""Longer pieces are encoded but not kept."""


def vocabulary_size(path: str) -> int:
    return _library(path)[1]


class _PieceEncoder:
    """Ids of many pieces from one call: a special token between them, which the library never joins with text, marks the bounds."""

    def __init__(self, encode, mark: str, mark_id: int):
        self.encode, self.mark, self.mark_id = encode, mark, mark_id

    def bounds(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the marks, and where each piece's ids begin and the mark behind them stands."""
        ids = np.array(self.encode([self.mark.join(pieces)])[0], np.int64)
        return ids, np.r_[-1, np.flatnonzero(ids == self.mark_id), len(ids)]

    def apart(self, pieces: list[str], make_all, make_one) -> list:
        """``make_all`` of the pieces without a mark inside, ``make_one`` of the others, in order."""
        odd = {p for p in pieces if self.mark in p}
        even = iter(make_all([p for p in pieces if p not in odd])) if len(odd) < len(pieces) else iter(())
        return [make_one(self.encode([p])[0]) if p in odd else next(even) for p in pieces]

    def packed(self, pieces: list[str], dtype: np.dtype) -> list[bytes]:
        def make(some):
            ids, at = self.bounds(some)
            data, at = ids.astype(dtype).tobytes(), (at * dtype.itemsize).tolist()
            return [data[a + dtype.itemsize : b] for a, b in zip(at[:-1], at[1:], strict=True)]

        return self.apart(pieces, make, lambda ids: np.array(ids, dtype).tobytes())

    def lengths(self, pieces: list[str]) -> list[int]:
        return self.apart(pieces, lambda some: (np.diff(self.bounds(some)[1]) - 1).tolist(), len)


@lru_cache(maxsize=2)
def _library(path: str):
    """(function from texts to lists of ids, vocabulary size, encoder of pieces if texts may be cut)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return (lambda texts: model.encode(texts, num_threads=1)), model.vocab_size(), None
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    pre = made.get("pre_tokenizer") or {}
    plain_added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(f"[{SPACE}]", t["content"])) for t in made["added_tokens"])
    cuts = made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and plain_added
    encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    mark = next(((t["content"], t["id"]) for t in made["added_tokens"] if t["special"]), None)
    pieces = _PieceEncoder(encode, *mark) if cuts and mark else None
    return encode, tokenizer.get_vocab_size(with_added_tokens=True), pieces


class _Pieces(dict):
    """What a worker keeps for each piece, up to a number of bytes."""

    def __init__(self):
        super().__init__()
        self.used = 0

    def look_up(self, pieces: list[str], make) -> list:
        """The value of each piece; those that are missing are made in a few calls."""
        if self.used >= KEPT_BYTES:
            self.clear()
            self.used = 0
        values = list(map(self.get, pieces))
        gaps = [i for i, v in enumerate(values) if v is None]
        new = list({pieces[i] for i in gaps})
        made: dict = {}
        for start in range(0, len(new), 1024):
            some = new[start : start + 1024]
            made.update(zip(some, make(some), strict=True))
        for i in gaps:
            values[i] = made[pieces[i]]
        self._keep(made)
        return values

    def _keep(self, made: dict) -> None:
        if max(map(len, made), default=0) > MAX_UNIT_CHARS:
            made = {u: v for u, v in made.items() if len(u) <= MAX_UNIT_CHARS}
        packed = sum(map(len, made.values())) if made and isinstance(next(iter(made.values())), bytes) else 0
        self.used += ENTRY_BYTES * len(made) + sum(map(len, made)) + packed
        self.update(made)


@lru_cache(maxsize=2)
def _kept(path: str, what: str) -> _Pieces:
    return _Pieces()


def ids_of(path: str, texts: list[str], dtype: np.dtype) -> list[bytes]:
    """Little-endian ids of each text."""
    encode, _, pieces = _library(path)
    if not pieces:
        return [np.array(x, dtype).tobytes() for x in encode(texts)]
    kept = _kept(path, str(dtype))
    out: list[bytes] = []
    for some in _portions(texts):
        units = [UNIT.findall(t) for t in some]
        values = iter(kept.look_up(list(chain.from_iterable(units)), lambda new: pieces.packed(new, dtype)))
        out += [b"".join(islice(values, len(u))) for u in units]
    return out


def lengths_of(path: str, texts: list[str], frequent: dict[str, int]) -> list[int]:
    """Number of ids of each text: frequent pieces from ``frequent``, others from the worker's own store."""
    encode, _, pieces = _library(path)
    if not pieces:
        return [len(x) for x in encode(texts)]
    kept = _kept(path, "length")
    out: list[int] = []
    for some in _portions(texts):
        units = [UNIT.findall(t) for t in some]
        first = [list(map(frequent.get, u)) for u in units]
        rest = [[x for x, n in zip(u, f, strict=True) if n is None] for u, f in zip(units, first, strict=True)]
        values = iter(kept.look_up(list(chain.from_iterable(rest)), pieces.lengths))
        out += [sum(filter(None, f)) + sum(islice(values, len(r))) for f, r in zip(first, rest, strict=True)]
    return out


def _portions(texts: list[str], chars: int = 1 << 20):
    """Consecutive parts of about ``chars`` characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part
