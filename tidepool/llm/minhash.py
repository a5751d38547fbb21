"""Bucket keys for a Jaccard similarity of shingle sets, for simhash.representatives.

Sets meet in one of BANDS buckets, each keyed by PER_BAND minima of the set; a pair of
similarity 0.8 meets in none with probability (1 - 0.8^4)^32 = 5e-8, a more similar one
less often.
"""

from __future__ import annotations

import numpy as np

BANDS, PER_BAND = 32, 4
_RNG = np.random.default_rng(5)
_FACTOR = _RNG.integers(0, 1 << 64, BANDS * PER_BAND, dtype=np.uint64) | np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 64, BANDS * PER_BAND, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bands(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The BANDS bucket keys of each segment of hashes."""
    out = np.empty((len(starts), BANDS), np.uint64)
    for i in range(BANDS):
        key = np.full(len(starts), i, np.uint64)
        for k in range(i * PER_BAND, (i + 1) * PER_BAND):
            key = (key ^ np.minimum.reduceat(hashes * _FACTOR[k] + _SHIFT[k], starts)) * _MIX
            key ^= key >> np.uint64(29)
        out[:, i] = key
    return out
