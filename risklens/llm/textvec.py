"""Whole Arrow batches of texts as flat numpy arrays: words, hashes, segments.

Hashes are polynomials over the bytes modulo 2**64, taken from one prefix sum per
slice, so any substring's hash costs two array reads; long words are digested
instead.  They depend on the bytes alone and never on the process, the batch or the
position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 4 << 20
LONG_WORD = 48  # polynomials modulo 2**64 have structured collisions between long strings

_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


class Hasher:
    """Substring hashes of byte slices; ``seed`` picks one of two bases."""

    def __init__(self, seed: int = 0):
        self.seed, self.base = seed, _BASE[seed]
        self.table = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F + 2 * seed))
        self.power = self.inverse = np.ones(0, dtype=U64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums over ``data``; entry i covers the first i bytes."""
        n = len(data) + 1
        if len(self.power) < n:
            self.power = _powers(self.base, n + n // 4)
            self.inverse = _powers(pow(self.base, -1, 1 << 64), n + n // 4)
        out = np.zeros(n, dtype=U64)
        np.cumsum(self.table[data] * self.power[: n - 1], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each ``data[start:end]``."""
        return mix((prefix[end] - prefix[start]) * self.inverse[start])

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each word ``data[start:end]``; words above ``LONG_WORD`` bytes are
        digested byte by byte."""
        out = self.span(self.prefix(data), start, end)
        for i in np.flatnonzero(end - start > LONG_WORD).tolist():
            digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([self.seed]))
            out[i] = int.from_bytes(digest.digest(), "little")
        return out


class Texts:
    """The texts of one slice: bytes laid end to end, and where each row begins."""

    def __init__(self, array: pa.Array, lower: bool = False):
        array = array.cast(pa.large_binary()) if not pa.types.is_large_binary(array.type) else array
        offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
        if array.null_count:  # a null holds no bytes
            array = array.fill_null(b"")
            offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
        if not len(array):
            offsets = np.zeros(1, dtype=np.int64)
        body = array.buffers()[2] if len(array) and array.buffers()[2] is not None else b""
        data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]]
        self.data = _LOWER[data] if lower else data
        self.rows = (offsets - offsets[0]).astype(np.int64)

    def words(self, gaps: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all words: runs without the bytes that ``gaps`` marks (ASCII
        white space), inside a row."""
        solid = ~gaps[self.data]
        before = np.zeros(len(solid), dtype=bool)
        before[1:] = solid[:-1]
        heads = self.rows[:-1][self.rows[:-1] < len(solid)]
        before[heads] = False
        starts = np.flatnonzero(solid & ~before)
        after = np.zeros(len(solid), dtype=bool)
        after[:-1] = solid[1:]
        tails = self.rows[1:][self.rows[1:] > 0] - 1
        after[tails] = False
        return starts, np.flatnonzero(solid & ~after) + 1

    def split(self, positions: np.ndarray) -> np.ndarray:
        """For sorted byte positions: index of the first one in each row, and the count."""
        return np.searchsorted(positions, self.rows)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a slice holds about ``limit`` bytes of text; a longer
    text is a slice of its own."""
    for batch in batches:
        lengths = batch.column(text).cast(pa.large_binary())
        sizes = pa.compute.binary_length(lengths).fill_null(0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            done = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the given runs, run after run."""
    if not len(lengths) or not lengths.sum():
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)
