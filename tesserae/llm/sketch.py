"""Fast similarity sketching (Dahlgaard, Knudsen, Thorup): t coordinates filled in rounds of hashed bin placement."""

from __future__ import annotations

import numpy as np

from .kernels import mix

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Sketch matrix (rows x t) of non-empty sets of 64-bit hashes.

    Round i < t throws every element of a set into a hashed bin with the value
    (i, hash); round t <= i < 2 t throws all of them into bin i - t. A bin keeps
    its least value, so earlier rounds win, and after 2 t rounds no bin is empty.
    A row leaves as soon as its bins are full, so large sets need few rounds.
    """
    n = len(sets)
    out = np.full(n * t, EMPTY, np.uint64)
    live = np.flatnonzero(np.fromiter(map(len, sets), np.int64, n))
    elems = np.concatenate([sets[i] for i in live]) if len(live) else np.empty(0, np.uint64)
    row = np.repeat(live, [len(sets[i]) for i in live]) if len(live) else np.empty(0, np.int64)
    for i in range(2 * t):
        if len(row) == 0:
            break
        h = mix(elems ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        where = ((h >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64) if i < t else i - t
        value = (np.uint64(i) << np.uint64(52)) | (mix(h) >> np.uint64(12))
        np.minimum.at(out, row * t + where, value)
        full = (out.reshape(n, t) != EMPTY).all(1)
        stay = ~full[row]
        elems, row = elems[stay], row[stay]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of `rows` coordinates; the band's index is part of the key."""
    n, t = sketch.shape
    bands = t // rows
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    cut = sketch[:, : bands * rows].reshape(n, bands, rows)
    for j in range(rows):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + cut[:, :, j])
    return h
