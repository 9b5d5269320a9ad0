"""Sums in a fixed order. A tree sum halves index ranges at floor(n / 2), so its
value is defined by the order of the values alone, not by how they are dealt out.
"""

from __future__ import annotations

import numpy as np


def psum(x: np.ndarray) -> np.ndarray:
    """Tree sum over the last axis, in binary64; +0 for no values."""
    x = np.asarray(x, np.float64)
    n = x.shape[-1]
    if n == 0:
        return np.zeros(x.shape[:-1])[()]
    if n == 1:
        return x[..., 0]
    # The tree's leaves lie at two depths; fold the deeper ones, then level by level.
    depth = (n - 1).bit_length()
    bounds = np.array([0, n])
    for _ in range(depth - 1):
        mid = bounds[:-1] + np.diff(bounds) // 2
        bounds = np.sort(np.concatenate([bounds, mid]))
    size = np.diff(bounds)
    first = x[..., bounds[:-1]]
    second = x[..., np.minimum(bounds[:-1] + 1, n - 1)]
    with np.errstate(all="ignore"):
        level = np.where(size == 2, first + second, first)
        while level.shape[-1] > 1:
            level = level[..., 0::2] + level[..., 1::2]
    return level[..., 0]


def psum_recursive(x: list[float]) -> float:
    """The definition, for tests."""
    n = len(x)
    return 0.0 if n == 0 else x[0] if n == 1 else psum_recursive(x[: n // 2]) + psum_recursive(x[n // 2 :])


def block_of(index: np.ndarray, n: int, depth: int) -> np.ndarray:
    """The node at `depth` of the tree over n values that holds each index."""
    lo, hi = np.zeros_like(index), np.full_like(index, n)
    node = np.zeros_like(index)
    for _ in range(depth):
        mid = lo + (hi - lo) // 2
        right = index >= mid
        lo, hi = np.where(right, mid, lo), np.where(right, hi, mid)
        node = 2 * node + right
    return node


def sequential_sum(x) -> float:
    total = 0.0
    for v in np.asarray(x, np.float64).tolist():
        total += v
    return total


def order_key(x: np.ndarray) -> np.ndarray:
    """Integers in the total order of doubles (-0 before +0)."""
    b = np.asarray(x, np.float64).view(np.int64)
    return np.where(b < 0, ~b ^ np.int64(-(2**63)), b)


def argsort(x: np.ndarray) -> np.ndarray:
    return np.argsort(order_key(x), kind="stable")


def argsort_desc(x: np.ndarray) -> np.ndarray:
    """Descending; ties by ascending index."""
    return np.argsort(~order_key(x), kind="stable")


def mean(x: np.ndarray) -> np.ndarray:
    return psum(x) / np.shape(x)[-1]


def normalised(w: np.ndarray) -> np.ndarray:
    w = np.asarray(w, np.float64)
    if not np.isfinite(w).all() or (w < 0).any():
        raise ValueError("weights are finite and not negative")
    total = psum(w)
    if total <= 0:
        raise ValueError("weights are all zero")
    return w / total
