"""Determinism sweeps: a million values of each function and generator, hashed."""

from __future__ import annotations

import hashlib

import numpy as np

from . import detmath
from .rng import Stream, splitmix64

SEED = 0x56445331
LENGTH = 1_000_000

# SHA3-256 of each sweep's little-endian bytes.
HASHES = {
    "detmath.cos.f32": "ffc5317f7e6ed6097feb62a5cb9f8511a2344ffbaef0a28d2e6025833d4a0a26",
    "detmath.cos.f64": "cd4f3ab763235ea758331f738ec662f38c0fff54aec5e33884a329f5c1d1322b",
    "detmath.exp.f32": "d08bb3d78438af75dd97439dd6bdaaa2a40eddd23df3facce675971ba49998b5",
    "detmath.exp.f64": "43783118379a15517bd194d722585aa3deca64942589426b77739df1df3fb874",
    "detmath.ln.f32": "0de0e5afce6508909965bfb5b4ca67fe1045ea9f8847e8555aee3399e073789b",
    "detmath.ln.f64": "fc70cd04f1040e2e45787ca1a05a90d8e65d7f520ce0c2ff5fc8a887dacfa717",
    "detmath.sin.f32": "355967ea18fc6bf8939833a26a9ef2a670557b6deb176ab485bcf71c3e046c92",
    "detmath.sin.f64": "fbd278689a89e6887ab9557d7effc68b36c3eb9d00f95c2f27032e853056b024",
    "rng.philox.f32_unit": "f53bb1d6f4c3243da5efbcdc6b0e66fd38118efc4aec655454cd82142b365579",
    "rng.philox.f64_unit": "80deb56e7f6131c47c320934cf34492c4f914e530785884044634c56dd283b48",
    "rng.philox.normal_f64": "52b9ede9987824ae71a1c115ae7ebce29dba0b988df4f48fda50a05187d2a288",
    "rng.philox.u32": "de01a59046ba1183e2b17134a905581d0e29fce4b4f88208e14018398972a115",
    "rng.splitmix64.u64": "e0ff22c7a7717e419d2693cf926cd3d1d45aef9e622e6f1795c4559b45190c60",
}


def _trig64(n: int, stream: int) -> np.ndarray:
    w = Stream(SEED, stream).next_u64(2 * n)
    a, b = w[0::2], w[1::2]
    u = (a >> np.uint64(11)).astype(np.float64) * 2.0**-53
    e = (b % np.uint64(65)).astype(np.int32) - 32
    x = (2.0 * u - 1.0) * np.ldexp(1.0, e)
    sign = a & np.uint64(1 << 63)
    any_value = (sign | ((a & np.uint64((1 << 63) - 1)) % np.uint64(0x7FF0000000000000))).view(np.float64)
    return np.where(np.arange(n) % 16 == 15, any_value, x)


def _trig32(n: int, stream: int) -> np.ndarray:
    w = Stream(SEED, stream).next_u32(2 * n)
    a, b = w[0::2], w[1::2]
    u = (a >> np.uint64(8)).astype(np.float32) * np.float32(2.0**-24)
    e = (b % np.uint64(33)).astype(np.int32) - 16
    x = (np.float32(2) * u - np.float32(1)) * np.ldexp(np.float32(1), e)
    sign = a & np.uint64(0x80000000)
    any_value = (sign | ((a & np.uint64(0x7FFFFFFF)) % np.uint64(0x7F800000))).astype(np.uint32).view(np.float32)
    return np.where(np.arange(n) % 16 == 15, any_value, x.astype(np.float32))


def values(name: str, n: int = LENGTH) -> np.ndarray:
    """The sweep's outputs, in order."""
    s = lambda k: Stream(SEED, k)
    with np.errstate(all="ignore"):
        match name:
            case "detmath.exp.f64":
                return detmath.exp(1456.0 * s(1).next_f64_unit(n) - 746.0)
            case "detmath.ln.f64":
                return detmath.ln((s(2).next_u64(n) % np.uint64(0x7FF0000000000000)).view(np.float64))
            case "detmath.sin.f64":
                return detmath.sin(_trig64(n, 3))
            case "detmath.cos.f64":
                return detmath.cos(_trig64(n, 4))
            case "detmath.exp.f32":
                return detmath.exp_f32(np.float32(194) * s(5).next_f32_unit(n) - np.float32(105))
            case "detmath.ln.f32":
                return detmath.ln_f32((s(6).next_u32(n) % np.uint64(0x7F800000)).astype(np.uint32).view(np.float32))
            case "detmath.sin.f32":
                return detmath.sin_f32(_trig32(n, 7))
            case "detmath.cos.f32":
                return detmath.cos_f32(_trig32(n, 8))
            case "rng.philox.u32":
                return s(100).next_u32(n).astype(np.uint32)
            case "rng.philox.f32_unit":
                return s(101).next_f32_unit(n)
            case "rng.philox.f64_unit":
                return s(102).next_f64_unit(n)
            case "rng.philox.normal_f64":
                return s(103).next_normal(n)
            case "rng.splitmix64.u64":
                return splitmix64(SEED, 0, n)
    raise KeyError(name)


def sweep_hash(name: str) -> str:
    return hashlib.sha3_256(values(name).tobytes()).hexdigest()
