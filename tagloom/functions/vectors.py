"""Distances on NumPy blocks, used inside tasks."""
from __future__ import annotations

import numpy as np


def cosine(rows: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """1 - dot product, for unit vectors; the default metric. Any f(rows, heads) -> matrix may replace it."""
    return 1.0 - rows @ heads.T


def euclidean(rows: np.ndarray, heads: np.ndarray) -> np.ndarray:
    sq = (rows ** 2).sum(1)[:, None] + (heads ** 2).sum(1)[None, :] - 2 * rows @ heads.T
    return np.sqrt(np.clip(sq, 0, None))


def manhattan(rows: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return sum(np.abs(rows[:, None, k] - heads[None, :, k]) for k in range(rows.shape[1]))


manhattan.triangle = True  # no way round is shorter, but for rounding: near rows have near distances to any head


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairwise bit differences of two arrays of shape (n, 2): 64-bit hashes as two 32-bit halves."""
    low = np.bitwise_count((a[:, None, 0] ^ b[None, :, 0]).astype(np.uint64))
    return low.astype(np.int16) + np.bitwise_count((a[:, None, 1] ^ b[None, :, 1]).astype(np.uint64))


def mean_difference(a: np.ndarray, b: np.ndarray, cells: int = 8_000_000) -> np.ndarray:
    """Pairwise mean absolute difference of two signature matrices, about ``cells`` values at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, cells // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.abs(a[i : i + step, None, :] - b[None, :, :]).sum(2, dtype=np.int64) / a.shape[1]
    return out


def segments(sig: np.ndarray, parts: int) -> np.ndarray:
    """Sums over at most ``parts`` segments as shares of the width: the sum of their differences never exceeds the mean difference."""
    width = sig.shape[1]
    starts = np.arange(min(parts, width)) * width // min(parts, width)
    return np.add.reduceat(sig.astype(np.int64), starts, axis=1) / width


def dct_matrix(n: int = 32) -> np.ndarray:
    k = np.arange(n)
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    m[0] /= np.sqrt(2)
    return m
