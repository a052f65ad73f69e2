"""Resampling of 8-bit pictures as products with weight matrices, used inside tasks.

The result equals that of the common fixed-point method bit for bit: windows of whole pixels, weights rounded to 22 bits, columns first, and each of the
two passes rounded to 8 bits. All sums stay below 2^53, so that products of doubles are exact.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np

# ---- fixed values ----
BITS = 22  # of a weight
GREY = (19595, 38470, 7471)  # shares of red, green and blue in 65536
REACH = {"box": 0.5, "lanczos": 3.0}  # half the width of a kernel
# ---- end of fixed values ----


def _kernel(x: np.ndarray, kind: str) -> np.ndarray:
    if kind == "box":
        return ((x > -0.5) & (x <= 0.5)).astype(float)
    return np.where((x >= -3) & (x < 3), np.sinc(x) * np.sinc(x / 3), 0.0)


@lru_cache(maxsize=32)
def weights(size: int, to: int, kind: str) -> np.ndarray:
    """``to`` x ``size`` whole numbers; each line sums to about 2^BITS. A kernel is as wide as the step when a picture shrinks."""
    step = size / to
    wide = max(step, 1.0)
    centre = (np.arange(to)[:, None] + 0.5) * step
    first, past = (np.clip(np.trunc(centre + side * REACH[kind] * wide + 0.5), 0, size) for side in (-1, 1))
    x = np.arange(size)[None, :]
    w = np.where((x >= first) & (x < past), _kernel((x - centre + 0.5) / wide, kind), 0.0)
    w = w / w.sum(1, keepdims=True) * (1 << BITS)
    return np.trunc(w + np.copysign(0.5, w))


def _pass(lines: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Lines of pixels, the last axis, times the weights, as bytes."""
    sums = lines.astype(np.float64) @ matrix.T
    return np.clip(np.floor((sums + (1 << BITS - 1)) / (1 << BITS)), 0, 255).astype(np.uint8)


def resample(a: np.ndarray, height: int, width: int, kind: str, cells: int = 1 << 22) -> np.ndarray:
    """A picture of bytes, height x width or height x width x channels, in another size. About ``cells`` values are held as doubles at a time."""
    flat = a[:, :, None] if a.ndim == 2 else a
    across, down = weights(a.shape[1], width, kind), weights(a.shape[0], height, kind)
    some = max(1, cells // max(1, flat[0].size))
    narrow = np.concatenate([_pass(flat[y:y + some].transpose(0, 2, 1), across) for y in range(0, len(flat), some)])  # height x channels x new width
    out = _pass(narrow.transpose(1, 2, 0), down).transpose(2, 1, 0)
    return out[:, :, 0] if a.ndim == 2 else out


def grey(rgb: np.ndarray) -> np.ndarray:
    """Brightness as bytes."""
    return (sum(rgb[:, :, k].astype(np.uint32) * share for k, share in enumerate(GREY)) + 0x8000 >> 16).astype(np.uint8)
