"""Texts as one flat byte buffer: word spans, word hashes and n-gram hashes by whole-array numpy.

Every helper takes a list of UTF-8 byte strings (null texts are b"") and works on
the whole of each; callers slice a batch into pieces of bounded size with ``pieces``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Byte values of the contract's word separators.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    had = _powers.get(base)
    if had is None or len(had) < n:
        had = np.full(max(n, 1 << 16), base, np.uint64)
        had[0] = 1
        _powers[base] = had = np.multiply.accumulate(had)
    return had[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def column_bytes(col: pa.Array) -> list[bytes]:
    """A string column as bytes, nulls as b""."""
    return pc.fill_null(col.cast(pa.large_binary()), b"").to_pylist()


def pieces(batches, column: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts, each of some ``most`` bytes (one text may have more)."""
    for batch in batches:
        i, at = batch.schema.get_field_index(column), 0
        sizes = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            cut = batch.slice(at, to - at)
            yield cut, column_bytes(cut.column(i))
            at = to


class Words:
    """The words of some texts: ``start``/``end`` into ``data``, ``doc`` the text of each, ``first`` the first word of each text (one more at the end)."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        if lower:
            joined = joined.translate(LOWER_AZ)
        self.data = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.doc_end = np.cumsum(sizes + 1) - 1
        self.doc_start = self.doc_end - sizes
        space = IS_SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, np.append(self.doc_start, len(joined)))
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a prefix sum of byte values times powers, shifted back to the word's start."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _power(_BASE, n), out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * _power(_BASE_INV, n)[self.start] + (self.end - self.start).astype(np.uint64))


def shingles(words: Words, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word windows within texts, and the index of each window's first word."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += h[k : k + n] * _BYTE[k]
    at = np.flatnonzero(words.doc[:n] == words.doc[width - 1 :])
    return mix(total[at]), at


def byte_ngrams(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n bytes from each position on (the last n-1 positions are left out)."""
    m = max(0, len(data) - n + 1)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = (h << U64(8)) | data[k : k + m] if n <= 8 else h * U64(_BASE) + data[k : k + m]
    h *= U64(0x9E3779B97F4A7C15 ^ (n << 32))
    return h ^ (h >> U64(29))


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]], 0 for an empty segment."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[first[1:]] - total[first[:-1]]
