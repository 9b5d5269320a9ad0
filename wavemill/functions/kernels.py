"""Binary32 kernels with flush-to-zero, and the FFT, in numpy.

Arrays hold the transformed axis first and everything else behind it, so each
operation runs over long contiguous stretches. Every rounding is stated: one per
operation, results below 2^-126 replaced by zero of the same sign; a product is
judged before it is rounded.
"""

from __future__ import annotations

import functools
import threading
from typing import Protocol

import numpy as np

from . import detmath

NUMERICS_VERSION = 3
TINY = np.float32(2.0**-126)
_TINY_BITS = np.uint32(0x00800000)
#: Bits of 2^-69: a butterfly of operands that are zero or no smaller cannot
#: give a result below 2^-126, if nonzero twiddles are at least 2^-10.
_SAFE_BITS = (127 - 69) << 23
_SAFE_TWICE = (127 - 36) << 23

F32 = np.float32


def ftz(x: np.ndarray) -> np.ndarray:
    """Zero of the same sign where the exponent field is zero."""
    x = np.ascontiguousarray(x, F32)
    if not x.size or least_bits(x) >= int(_TINY_BITS):
        return x
    bits = x.view(np.uint32)
    low = (bits & np.uint32(0x7F800000)) == 0
    return np.where(low, bits & np.uint32(0x80000000), bits).view(F32)


def least_bits(x: np.ndarray, scratch: np.ndarray | None = None) -> int:
    """Bits of the smallest nonzero magnitude."""
    x = np.ascontiguousarray(x)
    b = np.empty(x.shape, np.uint32) if scratch is None else scratch[: x.size].view(np.uint32).reshape(x.shape)
    # Minus twice the bits, modulo 2^32: signs drop out, and zeros are the least.
    np.multiply(x.view(np.uint32), np.uint32(0xFFFFFFFE), out=b)
    return ((1 << 32) - int(b.max())) >> 1 if b.size else 0x7F800000


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of flushed operands; below 2^-126 before rounding, it is zero."""
    with np.errstate(all="ignore"):
        r = a * b
        if r.size and least_bits(r) <= int(_TINY_BITS):
            edge = (np.abs(r) <= TINY) & (r != 0)
            exact = np.abs(a.astype(np.float64) * b)
            r = np.where(edge & (exact < float(TINY)), np.copysign(F32(0), r), r)
        return r


# -------------------------------------------------------------------- twiddles


@functools.lru_cache(maxsize=None)
def twiddles(n: int, single: bool = True, inverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """exp(-2 pi i p / n) for p < n / 2: the first octant computed, the rest by
    exact symmetry."""
    if n < 2 or n & (n - 1):
        raise ValueError("length must be a power of two")
    kind = F32 if single else np.float64
    octant = np.arange(n // 8 + 1) * (detmath.TAU / n)
    # Row 0 holds cosines, row 1 sines; mirrored at the octant's end they change places.
    both = np.stack([detmath.cos(octant), detmath.sin(octant)]).astype(kind)
    if n >= 8:
        both[:, -1] = np.sqrt(0.5).astype(kind)
    quadrant = np.concatenate([both, both[::-1, : n // 4 - n // 8][:, ::-1]], 1)
    # A quarter turn further on, (cos, sin) is (-sin, cos).
    cos, sin = np.concatenate([quadrant, np.stack([-quadrant[1], quadrant[0]])[:, 1:]], 1)[:, : n // 2]
    return np.ascontiguousarray(cos), np.ascontiguousarray(sin if inverse else -sin)


# ------------------------------------------------------------------------- FFT


_SPACE = threading.local()


def _buffers(n: int, kind: np.dtype) -> list[np.ndarray]:
    """Scratch planes that calls of one thread share: allocating them anew would
    cost more than a pass over them."""
    key = (n, kind.str)
    if getattr(_SPACE, "key", None) != key:
        _SPACE.key, _SPACE.planes = key, [np.empty(n, kind) for _ in range(6)]
    return _SPACE.planes


def fft(re: np.ndarray, im: np.ndarray, inverse: bool = False, always_flush: bool = False, over: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Transform along the first axis, in binary32 with flushes or in binary64. An
    inverse is divided by `over`, by default the length.

    A level runs without flushes where no result of it can be below 2^-126: if all
    nonzero operands are at least 2^-69; if they are at least 2^-36, so does the
    level after it, whose operands are then multiples of 2^-92."""
    n = re.shape[0]
    single = re.dtype == F32
    if n == 1 and not over:
        return re, im
    rest = re[0].size
    planes = _buffers(n * rest, re.dtype)
    known = None  # the least magnitude at the first level, from the flush of the operands
    if single:
        known = min(least_bits(re, planes[4]), least_bits(im, planes[4]))
        if known < int(_TINY_BITS):
            re, im, known = ftz(re), ftz(im), None
    if n == 1:
        return _scaled(re, im, over)
    wr, wi = twiddles(n, single, inverse)
    if single:
        wr, wi = ftz(wr), ftz(wi)
    xr, xi = re.reshape(n, rest), im.reshape(n, rest)
    dr, di = (p[: n * rest // 2] for p in planes[4:6])
    size, stride, turn, sure = n, 1, 0, not single
    with np.errstate(all="ignore"):
        while size > 1:
            half = size // 2
            shape = (half, stride * rest)
            ar, br = xr.reshape(2, *shape)
            ai, bi = xi.reshape(2, *shape)
            if half > 1:
                yr, yi = (p.reshape(half, 2, stride * rest) for p in planes[2 * turn : 2 * turn + 2])
            else:
                yr, yi = np.empty((1, 2, n * rest // 2), re.dtype), np.empty((1, 2, n * rest // 2), re.dtype)
            tr, ti = wr[:: n // size][:half, None], wi[:: n // size][:half, None]
            if sure:
                safe, sure = True, not single
            else:
                least = 0 if always_flush else min(least_bits(xr, planes[4]), least_bits(xi, planes[4])) if known is None else known
                safe, sure = least >= _SAFE_BITS, least >= _SAFE_TWICE
            if safe:
                er, ei, odd_r, odd_i = dr.reshape(shape), di.reshape(shape), yr[:, 1], yi[:, 1]
                np.subtract(ar, br, out=er)
                np.subtract(ai, bi, out=ei)
                np.add(ar, br, out=yr[:, 0])
                np.add(ai, bi, out=yi[:, 0])
                np.multiply(er, tr, out=odd_r)
                np.multiply(er, ti, out=odd_i)
                np.multiply(ei, ti, out=er)
                np.multiply(ei, tr, out=ei)
                np.subtract(odd_r, er, out=odd_r)
                np.add(odd_i, ei, out=odd_i)
            else:
                yr[:, 0], yi[:, 0] = ftz(ar + br), ftz(ai + bi)
                er, ei = ftz(ar - br), ftz(ai - bi)
                pr, pi = (np.ascontiguousarray(np.broadcast_to(t, shape)) for t in (tr, ti))
                yr[:, 1] = ftz(mul(er, pr) - mul(ei, pi))
                yi[:, 1] = ftz(mul(er, pi) + mul(ei, pr))
            xr, xi = yr.reshape(n, rest), yi.reshape(n, rest)
            size, stride, turn, known = half, 2 * stride, 1 - turn, None
    if inverse:
        xr, xi = _scaled(xr, xi, over or n)
    return xr.reshape(re.shape), xi.reshape(re.shape)


def _scaled(re: np.ndarray, im: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    scale = re.dtype.type(1.0 / n)
    with np.errstate(all="ignore"):
        re, im = re * scale, im * scale
    return (ftz(re), ftz(im)) if re.dtype == F32 else (re, im)


def _every(re: np.ndarray, im: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse transform along the first axis at every `step`-th output. These
    depend on sums only in the first levels, so the rest is left out."""
    n = re.shape[0]
    re, im = ftz(re), ftz(im)
    with np.errstate(all="ignore"):
        while step > 1:
            half = len(re) // 2
            re, im = re[:half] + re[half:], im[:half] + im[half:]
            if min(least_bits(re), least_bits(im)) < int(_TINY_BITS):
                re, im = ftz(re), ftz(im)
            step //= 2
    return fft(re, im, inverse=True, over=n)


def ifft2_subsample(re: np.ndarray, im: np.ndarray, step: tuple[int, int], first: tuple[int, int], out: tuple[int, int]) -> np.ndarray:
    """`subsample` of the inverse transform, bit for bit, at a fraction of its work."""
    if re.shape[1] > 1:
        a, b = _every(*(np.ascontiguousarray(x.swapaxes(0, 1)) for x in (re, im)), step[1])
        re, im = (np.ascontiguousarray(x.swapaxes(0, 1)) for x in (a, b))
    if re.shape[0] > 1:
        re, im = _every(re, im, step[0])
    return re[first[0] : first[0] + out[0], first[1] : first[1] + out[1]]


def fft2(re: np.ndarray, im: np.ndarray, inverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns, ...): every row, then every column; an axis of one element
    is not transformed."""
    if re.shape[1] > 1:
        a, b = (np.ascontiguousarray(x.swapaxes(0, 1)) for x in (re, im))
        a, b = fft(a, b, inverse)
        re, im = (np.ascontiguousarray(x.swapaxes(0, 1)) for x in (a, b))
    return fft(re, im, inverse) if re.shape[0] > 1 else (re, im)


def fft_recursive(re: np.ndarray, im: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The transform by its definition, element by element, for tests."""
    n = len(re)
    tw = twiddles(n)
    x = [[F32(a), F32(b)] for a, b in zip(re, im)]
    y = [[F32(0), F32(0)] for _ in range(n)]
    one = lambda v: F32(ftz(np.array([v], F32))[0])
    times = lambda a, b: F32(mul(np.array([a], F32), np.array([b], F32))[0])

    def step(size: int, s: int, odd: bool, x: list, y: list) -> None:
        if size == 1:
            if odd:
                for q in range(s):
                    y[q] = list(x[q])
            return
        m = size // 2
        for p in range(m):
            wr, wi = one(tw[0][p * (n // size)]), one(tw[1][p * (n // size)])
            for q in range(s):
                ar, ai = map(one, x[q + s * p])
                br, bi = map(one, x[q + s * (p + m)])
                y[q + s * 2 * p] = [one(ar + br), one(ai + bi)]
                dr, di = one(ar - br), one(ai - bi)
                y[q + s * (2 * p + 1)] = [one(times(dr, wr) - times(di, wi)), one(times(dr, wi) + times(di, wr))]
        step(m, 2 * s, not odd, y, x)

    with np.errstate(all="ignore"):
        step(n, 1, False, x, y)
    return np.array([v[0] for v in x], F32), np.array([v[1] for v in x], F32)


# -------------------------------------------------------------- other kernels


def mul_real_filter(re: np.ndarray, im: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mul(ftz(re), ftz(h)), mul(ftz(im), ftz(h))


def modulus(re: np.ndarray, im: np.ndarray) -> np.ndarray:
    """Magnitude; the imaginary part of the result is +0."""
    re, im = ftz(re), ftz(im)
    return ftz(np.sqrt(ftz(mul(re, re) + mul(im, im))))


def subsample(re: np.ndarray, step: tuple[int, int], first: tuple[int, int], out: tuple[int, int]) -> np.ndarray:
    """Real parts at every `step`-th row and column from `first` on."""
    return re[step[0] * first[0] :: step[0], step[1] * first[1] :: step[1]][: out[0], : out[1]]


# -------------------------------------------------------------------- backends


class Backend(Protocol):
    """Five kernels on canvases (rows, columns, batch); a backend must return the
    bits that the numpy backend returns. It may offer `ifft_subsample` as one."""

    name: str
    numerics_version: int

    def capabilities(self) -> dict: ...
    def fft(self, re, im): ...
    def ifft(self, re, im): ...
    def mul_real_filter(self, re, im, h): ...
    def modulus(self, re, im): ...
    def subsample(self, re, step, first, out): ...


class BackendError(ValueError):
    """A backend, or the canvas that one is asked to work on, is not fit."""


class NumpyBackend:
    name = "cpu"
    numerics_version = NUMERICS_VERSION

    def capabilities(self) -> dict:
        return {"max_axis": 4096, "batched": True}

    def fft(self, re, im):
        return fft2(re, im)

    def ifft(self, re, im):
        return fft2(re, im, inverse=True)

    def mul_real_filter(self, re, im, h):
        return mul_real_filter(re, im, h)

    def modulus(self, re, im):
        return modulus(re, im)

    def subsample(self, re, step, first, out):
        return subsample(re, step, first, out)

    def ifft_subsample(self, re, im, step, first, out):
        return ifft2_subsample(re, im, step, first, out)


_BACKENDS: dict[str, Backend] = {"cpu": NumpyBackend()}


def register_backend(name: str, backend: Backend) -> None:
    if not 1 <= len(name.encode()) <= 64 or name == "cpu":
        raise BackendError("a backend's name has 1 to 64 bytes and is not cpu")
    if name in _BACKENDS:
        raise BackendError(f"backend {name} is registered")
    if backend.numerics_version != NUMERICS_VERSION:
        raise BackendError(f"backend {name} computes version {backend.numerics_version}, not {NUMERICS_VERSION}")
    for f in ("fft", "ifft", "mul_real_filter", "modulus", "subsample", "capabilities"):
        if not callable(getattr(backend, f, None)):
            raise BackendError(f"backend {name} has no {f}")
    _BACKENDS[name] = backend


def unregister_backend(name: str) -> None:
    if name == "cpu" or name not in _BACKENDS:
        raise BackendError(f"backend {name} cannot be removed")
    del _BACKENDS[name]


def backend(name: str = "cpu") -> Backend:
    if name not in _BACKENDS:
        raise BackendError(f"no backend {name}")
    return _BACKENDS[name]


def registered_backends() -> list[str]:
    return sorted(_BACKENDS)


def check_canvas(rows: int, cols: int) -> None:
    for n in (rows, cols):
        if n != 1 and (n & (n - 1) or not 2 <= n <= 4096):
            raise BackendError("canvas axes are 1 or a power of two from 2 to 4096")


def check_planes(rows: int, cols: int, *planes: np.ndarray) -> None:
    """Planes of a canvas: binary32, of one shape that begins with the canvas."""
    check_canvas(rows, cols)
    for x in planes:
        if x.dtype != F32 or x.shape[:2] != (rows, cols) or x.shape != planes[0].shape:
            raise BackendError("planes are binary32 and have the canvas's shape")


def check_subsample(rows: int, cols: int, step: tuple[int, int], first: tuple[int, int], out: tuple[int, int]) -> None:
    """The last sample that is taken lies on the canvas."""
    for n, s, f, m in zip((rows, cols), step, first, out):
        if s < 1 or f < 0 or m < 1 or (f + m - 1) * s >= n:
            raise BackendError("samples lie on the canvas")
