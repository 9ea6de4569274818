"""The words of Arrow columns of texts, found and numbered a batch at a time instead of one Python object each.

A word is ``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z. One of up to eight bytes without a zero byte is its bytes as a
number, its ``key``, so equal keys are equal words; others (key 0) are looked up as bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


class Words:
    """``counts``: words of each text (a null text has none); ``first``, ``last``: their bytes in ``data``; ``key``;
    ``other``: the places of words without a key."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.binary())
        if column.null_count:
            column = column.fill_null(b"")
        edges = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int32)
        held = column.buffers()[2] if len(column) else None
        self.data = b"" if held is None else held[int(edges[0]):int(edges[-1])].to_pybytes().lower()
        edges = (edges - edges[0]).astype(np.int64)
        raw = np.frombuffer(self.data, dtype=np.uint8)
        blank = (raw == 32) | (raw - np.uint8(9) <= 4)
        begins, ends = ~blank, ~blank
        begins[1:] &= blank[:-1]
        ends[:-1] &= blank[1:]
        inner = edges[(edges > 0) & (edges < len(raw))]  # a text's first word begins, whatever the text before ends with
        begins[inner] = ~blank[inner]
        ends[inner - 1] = ~blank[inner - 1]
        self.first, self.last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.counts = np.diff(np.searchsorted(self.first, edges))
        size = self.last - self.first
        padded = self.data + bytes(8)
        eight = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))
        self.key = eight[self.first] & _MASKS[np.minimum(size, 8)]
        no_key = size > 8
        if b"\0" in self.data:
            zeros = np.append(0, np.cumsum(raw == 0))
            no_key |= zeros[self.last] > zeros[self.first]
        self.other = np.flatnonzero(no_key)
        self.key[self.other] = 0

    def __len__(self) -> int:
        return len(self.first)

    def at(self, places: np.ndarray) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.first[places].tolist(), self.last[places].tolist())]

    def codes(self) -> np.ndarray:
        """Negative numbers of all words."""
        x = self.key.copy()
        for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x ^= x >> np.uint64(31)
            x *= np.uint64(by)
        x ^= x >> np.uint64(29)
        x[self.other] = np.fromiter(map(xxhash.xxh64_intdigest, self.at(self.other)), dtype=np.uint64, count=len(self.other))
        return -1 - (x >> np.uint64(1)).astype(np.int64)

    def joined(self, numbers: np.ndarray, end: int) -> np.ndarray:
        """A number of each word, with ``end`` after the last word of every text."""
        return np.insert(numbers, np.cumsum(self.counts), end)


def of_keys(keys: np.ndarray) -> pa.Array:
    """The words that have these keys."""
    held = keys.astype("<u8").view(np.uint8)
    used = held != 0
    offsets = np.append(0, np.cumsum(used.reshape(-1, 8).sum(axis=1))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(held[used].tobytes())])


class Ranks:
    """The places of words in a list of different, lower-cased ones."""

    def __init__(self, words: list[bytes]):
        own = Words(pa.array(words, pa.binary()))
        short = np.flatnonzero(own.key)
        order = np.argsort(own.key[short])
        self.keys, self.places, self.n = own.key[short][order], short[order], len(words)
        self.others = dict(zip(own.at(own.other), own.other.tolist()))

    def __len__(self) -> int:
        return self.n

    def of(self, words: Words, absent: int) -> np.ndarray:
        """The words' places; ``absent`` for others."""
        out = np.full(len(words), absent, dtype=np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, words.key), len(self.keys) - 1)
            out = np.where(self.keys[at] == words.key, self.places[at], absent)
        out[words.other] = np.fromiter(map(self.others.get, words.at(words.other), repeat(absent)), dtype=np.int64, count=len(words.other))
        return out
