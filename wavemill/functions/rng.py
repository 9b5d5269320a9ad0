"""Counter-based random numbers: every word is a pure function of (seed, stream,
index), so a table of draws can be made by any number of tasks.
"""

from __future__ import annotations

import numpy as np

from . import detmath

MASK64 = (1 << 64) - 1
# SplitMix64 and Philox4x32-10.
GAMMA, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
M0, M1 = np.uint64(0xD2511F53), np.uint64(0xCD9E8D57)
W0, W1 = 0x9E3779B9, 0xBB67AE85

# Ids of the streams.
STREAM_SYNTHETIC = 0x50000
STREAM_CHUNKS = 0x20001
STREAM_HEAD = 0x30000
STREAM_EPOCH = 0x310000000
STREAM_DIRECTIONS, STREAM_LEVELS, STREAM_LAYOUT = 0x40001, 0x40002, 0x40003


def splitmix64(seed: int, first: int, n: int) -> np.ndarray:
    """Outputs first .. first + n - 1 of the generator started at `seed`."""
    k = np.arange(n, dtype=np.uint64) + np.uint64((first + 1) & MASK64)
    z = np.uint64(seed & MASK64) + k * np.uint64(GAMMA)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    return z ^ (z >> np.uint64(31))


def philox(key: tuple[int, int], c0, c1, c2, c3) -> list[np.ndarray]:
    """Ten rounds on counters of four 32-bit words held in uint64 arrays."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    c0, c1, c2, c3 = (np.asarray(c, np.uint64) for c in (c0, c1, c2, c3))
    k0, k1 = key
    for _ in range(10):
        p0, p1 = M0 * c0, M1 * c2
        c0, c1, c2, c3 = (p1 >> half) ^ c1 ^ np.uint64(k0), p1 & low, (p0 >> half) ^ c3 ^ np.uint64(k1), p0 & low
        k0, k1 = (k0 + W0) & 0xFFFFFFFF, (k1 + W1) & 0xFFFFFFFF
    return [c0, c1, c2, c3]


class Stream:
    """One stream of 32-bit words, read from `position` on."""

    def __init__(self, seed: int, stream: int, position: int = 0):
        k = int(splitmix64(seed, 0, 1)[0])
        self.key = (k & 0xFFFFFFFF, k >> 32)
        self.stream = stream & MASK64
        self.position = position

    def seek(self, position: int) -> None:
        self.position = position

    def words(self, index: np.ndarray) -> np.ndarray:
        """Words at any indices."""
        index = np.asarray(index, np.uint64)
        block = index >> np.uint64(2)
        if index.size > 64 and index.ndim == 1 and int(index[-1]) - int(index[0]) == index.size - 1 and (np.diff(index) == 1).all():
            b = np.arange(int(block[0]), int(block[-1]) + 1, dtype=np.uint64)
            lanes = np.stack(self._block(b), 1).ravel()
            at = int(index[0]) & 3
            return lanes[at : at + index.size]
        return np.choose((index & np.uint64(3)).astype(np.int64), self._block(block))

    def _block(self, b: np.ndarray) -> list[np.ndarray]:
        s = np.uint64(self.stream)
        return philox(self.key, b & np.uint64(0xFFFFFFFF), b >> np.uint64(32), np.full(b.shape, s & np.uint64(0xFFFFFFFF)), np.full(b.shape, s >> np.uint64(32)))

    def word_at(self, index: int) -> int:
        return int(self.words(np.array([index], np.uint64))[0])

    def next_u32(self, n: int) -> np.ndarray:
        out = self.words(np.arange(n, dtype=np.uint64) + np.uint64(self.position))
        self.position += n
        return out

    def next_u64(self, n: int) -> np.ndarray:
        w = self.next_u32(2 * n)
        return w[0::2] | (w[1::2] << np.uint64(32))

    def next_f32_unit(self, n: int) -> np.ndarray:
        return (self.next_u32(n) >> np.uint64(8)).astype(np.float32) * np.float32(2.0**-24)

    def next_f64_unit(self, n: int) -> np.ndarray:
        return (self.next_u64(n) >> np.uint64(11)).astype(np.float64) * 2.0**-53

    def next_normal(self, n: int) -> np.ndarray:
        return normal(self.next_f64_unit(2 * n))

    def below(self, bound: int) -> int:
        """Uniform in 0 .. bound - 1 without bias: draws beyond the last whole
        multiple of the bound are rejected."""
        if bound <= 0:
            raise ValueError("bound must be positive")
        zone = (1 << 64) - (1 << 64) % bound
        while True:
            v = int(self.next_u64(1)[0])
            if v < zone:
                return v % bound

    def permutation(self, n: int) -> np.ndarray:
        """Fisher-Yates from the last place down; the draws are made at once and
        repeated one by one only if one of them was rejected."""
        out = np.arange(n, dtype=np.int64)
        if n < 2:
            return out
        start = self.position
        v = self.next_u64(n - 1)
        bound = np.arange(n, 1, -1, dtype=np.uint64)
        zone = np.uint64(MASK64) - (np.uint64(MASK64) % bound + np.uint64(1)) % bound
        if (v <= zone).all():
            picks = (v % bound).astype(np.int64).tolist()
        else:
            self.position = start
            picks = [self.below(k) for k in range(n, 1, -1)]
        p = out.tolist()
        for i, j in zip(range(n - 1, 0, -1), picks):
            p[i], p[j] = p[j], p[i]
        return np.array(p, np.int64)


def normal(units: np.ndarray) -> np.ndarray:
    """Box-Muller, cosine branch, of pairs of unit draws."""
    u1, u2 = 1.0 - units[0::2], units[1::2]
    return np.sqrt(-2.0 * detmath.ln(u1)) * detmath.cos(detmath.TAU * u2)
