"""Array kernels over Arrow text columns, shared by the operators of this package.

Texts stay UTF-8 bytes in one buffer. A batch is cut into slices of whole documents of a few
megabytes, so that the work arrays stay small however large the batch is; one longer document
makes a slice of its own. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

#: ASCII white space: everything else belongs to words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    size = 1 << 12
    while size < n:
        size *= 2
    return _powers(size, base)[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[0] = 0, from which :func:`span_hash` gives the hash of any span."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((prefix[stop] - prefix[start]) * powers(len(prefix), BASE_INVERSE)[start] + (stop - start).astype(np.uint64))


def rolling_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of values[i:i+k] for each i; empty if there are fewer than k values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = prefix_hash(values)
    return mix((prefix[k:] - prefix[:n]) * powers(n, BASE_INVERSE))


@dataclass
class Slice:
    """Whole documents lo..hi of a batch: their bytes and where each begins."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray  # length hi - lo + 1

    def __len__(self) -> int:
        return self.hi - self.lo


def column_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    data, offsets = column_buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Words of a slice: spans in its bytes, their hashes, and the first word of each document."""

    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # length documents + 1
    doc: np.ndarray  # document of each word, within the slice

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(s: Slice, lower: bool = False, hashes: bool = True) -> Words:
    """Runs of anything but ASCII white space; ``lower`` folds A-Z before hashing."""
    data = s.data
    solid = ~SPACE[data]
    begin, end = solid.copy(), solid.copy()
    if len(data):
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        inner = s.starts[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begin[inner] = solid[inner]
        end[inner - 1] = solid[inner - 1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if hashes:
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data)
        h = span_hash(prefix_hash(BYTE_VALUES[data]), start, stop)
    else:
        h = np.zeros(0, np.uint64)
    first = np.searchsorted(start, s.starts)
    return Words(start, stop, h, first, np.repeat(np.arange(len(s)), np.diff(first)))


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k items, and whether the run stays within one document."""
    h = rolling_hash(hashes, k)
    if not len(h):
        return h, np.zeros(0, bool)
    crosses = np.zeros(len(h) + 1, np.int32)
    edges = first[1:-1]
    # A run that begins in the k - 1 items before an edge crosses it.
    np.add.at(crosses, np.clip(edges - k + 1, 0, len(h)), 1)
    np.add.at(crosses, np.clip(edges, 0, len(h)), -1)
    return h, np.cumsum(crosses[:-1]) == 0


def sliding_argmin(keys: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest of keys[i:i+w] for each i (the first among equals by their upper half)."""
    n = len(keys) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    packed = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=np.uint64)
    pad = -len(keys) % w
    blocks = np.concatenate([packed, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values over each document's range."""
    total = np.concatenate([np.zeros(1, np.result_type(values.dtype, np.int64)), np.cumsum(values, dtype=np.result_type(values.dtype, np.int64))])
    return total[first[1:]] - total[first[:-1]]
