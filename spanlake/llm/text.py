"""Helpers that the text operators share: bounded slices of Arrow batches, and words as flat numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one numpy round works on (a longer text is one round of its own).
SLICE_BYTES = 2 << 20


def _fold() -> bytes:
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        table[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[c] = c + 32
    return bytes(table)


#: Lower-cases A-Z and turns every other ASCII byte outside 0-9 and a-z into a blank. Words are what is left between blanks.
FOLD = _fold()
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, *more: str) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most ``limit`` bytes of text (of all columns named), or one row."""
    for batch in batches:
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (column, *more))
        ends, at, done = np.cumsum(sizes), 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            done, at = int(ends[to - 1]), to


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


@dataclass
class Words:
    """Words of several texts. Word ``i`` is ``buf[starts[i]:ends[i]]``; text ``d`` has ``first[d]`` to ``first[d + 1]``."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def bytes_of(self, i: int, j: int) -> bytes:
        """Words ``i`` to ``j`` (exclusive) with one blank between them."""
        return b" ".join(self.buf[self.starts[i] : self.ends[j - 1]].tobytes().split())


def split_words(texts: list[bytes]) -> Words:
    buf = np.frombuffer((b"\n".join(texts) + b"\n").translate(FOLD), np.uint8)
    inside = buf != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return Words(buf, starts, ends, np.searchsorted(starts, begins))


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers_of(size: int, inverse: bool) -> np.ndarray:
    factor = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    steps = np.full(size, factor & _MASK, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    return _powers_of(1 << max(16, (n - 1).bit_length()), inverse)[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """``c`` such that ``(c[e] - c[s]) * powers(.., inverse)[s]`` depends on the bytes ``buf[s:e]`` alone."""
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf)), out=c[1:])
    return c


def word_codes(words: Words) -> np.ndarray:
    """A 64-bit code of each word, the same wherever it stands."""
    c = prefix_hash(words.buf)
    return mix((c[words.ends] - c[words.starts]) * powers(len(words.buf), inverse=True)[words.starts])
