"""Vectorised text kernels shared by the training-data operators.

Every kernel works on the buffers of an Arrow string column, so a batch of
documents is handled by a fixed number of numpy passes and no per-word Python.
Texts are cut into slices of about ``SLICE_BYTES`` (one document is never
split), which bounds the memory of a worker whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20_240_611))
_BYTE = (_RNG.integers(1, 1 << 62, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BYTE_FOLDED = _BYTE[_FOLD]
_Q = 0x9E3779B97F4A7C15
_QINV = pow(_Q, -1, 1 << 64)
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_M = np.uint64(0x9FB21C651E98DF25)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, base in ((0, _Q), (1, _QINV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, row after the last, bytes, row offsets from 0) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word (one entry more than rows)."""
    if len(buf) == 0:
        e = np.empty(0, np.int64)
        return e, e, np.zeros(len(off), np.int64)
    solid = ~_WHITE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of the bytes of each span; fold: A-Z hash as a-z."""
    up, down = _powers(len(buf) + 1)
    acc = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_BYTE_FOLDED if fold else _BYTE)[buf] * up[: len(buf)], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def ngram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes."""
    k = max(0, len(w) - n + 1)
    h = w[:k].copy()
    for j in range(1, n):
        h *= _M
        h += w[j : j + k]
    return mix(h + np.uint64(n))


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each row; a row of 1 to n - 1 words has its whole sequence as one shingle."""
    starts, ends, at = words(buf, off)
    w = span_hashes(buf, starts, ends)
    grams = ngram_hashes(w, n)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            keep = np.empty(len(g), bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            out.append(g[keep])
        elif b > a:
            out.append(ngram_hashes(w[a:b], b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out
