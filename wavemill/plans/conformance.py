"""Conformance cases: grids of inputs with names, streams that follow from the names,
and the outputs' hashes. Cases are rows, one task each; a suite's vectors are a
table that another backend, machine or version is compared with.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import anomaly, detmath, kernels, provenance, rng, stats, sweeps, training
from ..functions.kernels import F32
from . import scattering
from .scattering import ScatterConfig, Scattering

SUITE_VERSION = 3
SEED = sweeps.SEED
#: Outputs up to this size are kept whole, so that a difference can be located.
WHOLE = 16_384

# The suite's grids.
PATTERNS = ["zeros", "constant", "impulse", "near_subnormal", "large", "alternating", "subnormal", "flt_min_band"]
FFT1D = {"sizes": [2**m for m in range(1, 13)], "inputs": ["uniform", "impulse", "alternating", "near_subnormal", "large", "subnormal", "flt_min_band", "round_to_flt_min"]}
FFT2D = [(2, 4), (8, 8), (16, 64), (64, 16), (128, 128), (256, 32)]
MODULUS = ["uniform", "zeros", "near_subnormal", "large", "alternating", "subnormal", "flt_min_band", "sqrt_flt_min_band", "round_to_flt_min"]
FILTER = {"canvases": [(1, 256), (32, 32), (64, 4)], "inputs": ["uniform", "near_subnormal", "large", "subnormal", "round_to_flt_min", "long_tail", "signed_zero"]}
#: shapes, J, Q, L, pads, groups, order, inputs
SCATTER = [
    ([(256,), (1024,)], [2, 4, 6], [1, 4, 8], [1], [("circular",)], ["trivial"], 2, ["uniform"]),
    ([(256,), (192,)], [4], [1, 4], [1], [("zero_pad",)], ["trivial"], 2, ["uniform"]),
    ([(256,)], [4], [2], [1], [("circular",), ("zero_pad",)], ["trivial"], 2, PATTERNS),
    ([(256,)], [3], [1], [1], [("circular",)], ["trivial"], 1, ["uniform"]),
    ([(32, 32), (64, 64), (128, 128)], [1, 2, 3, 4], [1], [4, 8], [("circular", "circular"), ("zero_pad", "circular")], ["trivial", "so2_relative"], 2, ["uniform"]),
    ([(32, 32)], [2], [1], [4], [("circular", "circular"), ("zero_pad", "circular")], ["trivial", "so2_relative"], 2, PATTERNS),
    ([(32, 64)], [3], [1], [6], [("zero_pad", "zero_pad")], ["trivial", "so2_relative"], 1, ["uniform"]),
]
TIER2 = [
    "tier2/dcorr_exact/n200/unweighted",
    "tier2/dcorr_exact/n200/weighted",
    "tier2/dcorr_exact/n1000/weighted",
    "tier2/dcorr_chunked/n12000/weighted",
    "tier2/dcorr_grad/n64/unweighted",
    "tier2/dcorr_grad/n300/weighted",
    "tier2/pearson_proxy/n300/weighted",
    "tier2/jsd/n2000/bins20",
    "tier2/jsd/n2000/bins7",
    "tier2/train/logistic/exact/lambda0/n600",
    "tier2/train/logistic/exact/lambda2/n600",
    "tier2/train/mlp8/exact/lambda2/n600",
    "tier2/train/logistic/pearson_proxy/lambda2/n600",
    "tier2/calibration/n500/d6",
    "tier2/sw1/clouds16/points24/d6/dirs16",
    "tier2/hnsw/n300/m8/k4/tau1",
    "tier2/report/logistic/lambdas0_1_4/star1/n1200",
    "tier2/report/mlp16/lambdas0_0.5_2/star0.5/n1200",
]
QUICK = ("fft1d/n2/", "fft1d/n64/", "fft2d/8x8/", "modulus/", "mul_real_filter/1x256/", "scatter/1d/256/J4-Q1-L1/", "scatter/2d/32x32/J2-Q1-L4/", "tier2/jsd/", "tier2/dcorr_exact/n200/")


@dataclass(frozen=True)
class Output:
    dtype: str
    data: bytes


def cases() -> list[str]:
    """Names of all cases, in order."""
    out = [f"fft1d/n{n}/{d}/{i}" for n in FFT1D["sizes"] for d in ("forward", "inverse") for i in FFT1D["inputs"]]
    out += [f"fft2d/{r}x{c}/{d}/uniform" for r, c in FFT2D for d in ("forward", "inverse")]
    out += [f"modulus/n1024/{i}" for i in MODULUS]
    out += [f"mul_real_filter/{r}x{c}/{i}" for r, c in FILTER["canvases"] for i in FILTER["inputs"]]
    for shapes, js, qs, ls, pads, groups, order, inputs in SCATTER:
        out += ["/".join(["scatter", f"{len(s)}d", "x".join(map(str, s)), f"J{j}-Q{q}-L{l}", "-".join(p), g, f"o{order}", i]) for s, j, q, l, p, g, i in itertools.product(shapes, js, qs, ls, pads, groups, inputs)]
    out += [f"sweep/{n}" for n in sweeps.HASHES] + TIER2
    if len(set(out)) != len(out):
        raise ValueError("a case occurs twice")
    return out


def stream_of(case: str) -> int:
    return int.from_bytes(hashlib.sha3_256(case.encode()).digest()[:8], "little")


_SCALE = {"uniform": 1.0, "near_subnormal": 2.0**-120, "large": 2.0**40, "long_tail": 1.0, "signed_zero": 2.0**-100}


def _samples(kind: str, s: rng.Stream, rows: int, cols: int, parts: int) -> np.ndarray:
    """(rows * cols, parts) values; patterns have a real part only."""
    n = rows * cols
    if kind in _SCALE:
        u = s.next_f32_unit(n * parts)
        return ((F32(2) * u - F32(1)) * F32(_SCALE[kind])).reshape(n, parts)
    if kind in ("subnormal", "flt_min_band", "sqrt_flt_min_band", "round_to_flt_min"):
        r = s.next_u32(n * parts).astype(np.uint32)
        sign = r & np.uint32(0x80000000)
        bits = {
            "subnormal": lambda: r & np.uint32(0x807FFFFF),
            "flt_min_band": lambda: sign | (np.uint32(0x00800000) + (r & np.uint32(63))),
            "sqrt_flt_min_band": lambda: sign | (np.uint32(0x20000000) + (r & np.uint32(7)) - np.uint32(3)),
            "round_to_flt_min": lambda: sign | (np.uint32(0x00800000) + (r & np.uint32(3))),
        }[kind]()
        return bits.view(F32).reshape(n, parts)
    real = np.zeros((rows, cols), F32)
    if kind == "constant":
        real[:] = 0.75
    elif kind == "impulse":
        real[rows // 2, cols // 2] = 1
    elif kind == "alternating":
        real[:] = np.where((np.arange(rows)[:, None] + np.arange(cols)) % 2 == 0, 1, -1)
    elif kind != "zeros":
        raise ValueError(f"no input {kind}")
    out = np.zeros((n, parts), F32)
    out[:, 0] = real.ravel()
    return out


def real_input(case: str, shape: tuple[int, ...]) -> np.ndarray:
    """A scattering case's signal: groups of one configuration share it."""
    parts = case.split("/")
    parts[5] = "trivial"
    rows, cols = (1, shape[0]) if len(shape) == 1 else shape
    return _samples(parts[-1], rng.Stream(SEED, stream_of("/".join(parts))), rows, cols, 1)[:, 0]


def scatter_case(case: str) -> tuple[ScatterConfig, np.ndarray]:
    _, dim, shape, jql, pads, group, order, _ = case.split("/")
    j, q, l = (int(x[1:]) for x in jql.split("-"))
    shape = tuple(map(int, shape.split("x")))
    cfg = ScatterConfig(int(dim[0]), shape, j, q, l, int(order[1:]), tuple(pads.split("-")), group)
    return cfg, real_input(case, shape)


def _interleaved(re: np.ndarray, im: np.ndarray) -> Output:
    return Output("float32", np.stack([re.ravel(), im.ravel()], 1).astype("<f4").tobytes())


def _f64(x) -> Output:
    return Output("float64", np.atleast_1d(np.asarray(x, np.float64)).astype("<f8").tobytes())


def run_case(case: str, backend: str = "cpu") -> dict[str, Output]:
    kind, *rest = case.split("/")
    be = kernels.backend(backend)
    s = rng.Stream(SEED, stream_of(case))
    if kind in ("fft1d", "fft2d"):
        rows, cols = (1, int(rest[0][1:])) if kind == "fft1d" else map(int, rest[0].split("x"))
        x = kernels.ftz(_samples(rest[2], s, rows, cols, 2))
        re, im = (np.ascontiguousarray(x[:, k]).reshape(rows, cols, 1) for k in (0, 1))
        return {"out": _interleaved(*(be.fft if rest[1] == "forward" else be.ifft)(re, im))}
    if kind == "modulus":
        n = int(rest[0][1:])
        x = kernels.ftz(_samples(rest[1], s, 1, n, 2))
        m = be.modulus(np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(x[:, 1]))
        return {"out": _interleaved(m, np.zeros_like(m))}
    if kind == "mul_real_filter":
        rows, cols = map(int, rest[0].split("x"))
        n = rows * cols
        x = kernels.ftz(_samples(rest[1], s, rows, cols, 2))
        own = {"round_to_flt_min": lambda: np.full(n, F32(1 - 2.0**-24)), "signed_zero": lambda: np.full(n, F32(2.0**-30)), "long_tail": lambda: np.ldexp(F32(1), -(np.arange(n) % 150)).astype(F32)}
        h = kernels.ftz(own[rest[1]]() if rest[1] in own else s.next_f32_unit(n))
        return {"out": _interleaved(*be.mul_real_filter(np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(x[:, 1]), h))}
    if kind == "scatter":
        cfg, x = scatter_case(case)
        plan = Scattering.compile(cfg)
        c = plan.run(x, backend)
        return {"S": Output("float32", c.astype("<f4").tobytes()), "r2": Output("float32", plan.ratio(c).astype("<f4").tobytes()), "log_mean": _f64(scattering.log_mean(c)), "filters": Output("float32", plan.bank.canonical_bytes())}
    if kind == "sweep":
        return {"out": Output("hash", sweeps.sweep_hash(rest[0]).encode())}
    return _statistical(case, rest, s)


def _statistical(case: str, rest: list[str], s: rng.Stream) -> dict[str, Output]:
    number = lambda prefix, t: float(t.removeprefix(prefix))
    kind, own = rest[0], stream_of(case)
    if kind in ("dcorr_exact", "dcorr_chunked", "dcorr_grad", "pearson_proxy"):
        n, weighted = int(number("n", rest[1])), rest[2] == "weighted"
        per = 10 if weighted else 8
        w = s.next_u32(n * per).reshape(n, per)
        unit = lambda k: ((w[:, k] | (w[:, k + 1] << np.uint64(32))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        z = [rng.normal(np.stack([unit(k), unit(k + 2)], 1).ravel()) for k in (0, 4)]
        x = z[0]
        y, weight = x * x + 0.5 * z[1], 0.1 + unit(8) if weighted else np.ones(n)
        if kind == "dcorr_exact":
            return {"value": _f64(stats.dcorr2_exact(x, y, weight))}
        if kind == "dcorr_chunked":
            return {"value": _f64(stats.dcorr2_chunked(x, y, weight, own))}
        score = detmath.sigmoid(x)
        if kind == "dcorr_grad":
            v, g = stats.dcorr2_grad(score, y, weight)
            return {"value": _f64(v), "grad": _f64(g)}
        return {"grad": _f64(stats.pearson_proxy_grad(score, y, weight))}
    if kind == "jsd":
        d = training.synthetic(int(number("n", rest[1])), 4, SEED, own)
        bkg = d.y == 0
        after = bkg & (d.x[:, 0] > 0.5)
        bins = stats.Binning.from_range(d.m[bkg], int(number("bins", rest[2])))
        pre, post = bins.histogram(d.m[bkg], d.w[bkg]), bins.histogram(d.m[after], d.w[after])
        return {"pre": _f64(pre), "post": _f64(post), "jsd": _f64(stats.jsd(pre, post))}
    if kind == "train":
        d = training.synthetic(int(number("n", rest[4])), 4, SEED, own)
        m = training.train(d, training.TrainConfig(rest[1], 4, 128, 0.02, number("lambda", rest[3]), rest[2], own))
        return {"model": Output("float64", m.canonical_bytes()), "scores": _f64(m.predict(d.x))}
    if kind == "calibration":
        n, d = int(number("n", rest[1])), int(number("d", rest[2]))
        z = s.next_normal(n * (d + 1)).reshape(n, d + 1)
        j = np.arange(d)
        x = (1.0 + j) * z[:, :d] + j
        coef = (j + 1.0) * np.where(j % 2 == 0, 1.0, -1.0) / d
        t = training.dot(x, coef, 1.0) + 0.1 * z[:, d]
        c = training.ridge(x, t)
        return {"constants": Output("utf8", (c.constants() + "\n").encode()), "residuals": Output("float64", c.residual_bytes())}
    if kind == "sw1":
        n, points, d, dirs = (int(number(p, t)) for p, t in zip(("clouds", "points", "d", "dirs"), rest[1:]))
        z = s.next_normal(n * points * d).reshape(n, points, d)
        u = anomaly.directions(d, dirs, own)
        proj = [anomaly.project(z[i] + 0.1 * i, u) for i in range(n)]
        return {"matrix": _f64([[anomaly.sw1(a, b) for b in proj] for a in proj])}
    if kind == "hnsw":
        n, m, k, tau = (number(p, t) for p, t in zip(("n", "m", "k", "tau"), rest[1:]))
        z = s.next_normal(int(n) * 32).reshape(int(n), 8, 4)
        z[::50] += 4.0
        index = anomaly.AnomalyIndex(list(z), anomaly.AnomalyConfig(tau, int(k), 8, int(m), 32, 16, 30, own))
        det = index.detect_self()
        return {"graph_bytes": Output("uint32", index.graph_bytes()), "kth_distance": _f64([np.nan if x.kth_distance is None else x.kth_distance for x in det]), "flags": Output("uint8", bytes(int(x.flagged) for x in det)), "graph_json": Output("utf8", index.graph_json().encode())}
    if kind == "report":
        lambdas, star, n = [float(x) for x in rest[2].removeprefix("lambdas").split("_")], number("star", rest[3]), int(number("n", rest[4]))
        tr, ev = training.synthetic(n, 4, SEED, own), training.synthetic(n, 4, SEED, own + 1)
        cfg = training.TrainConfig(rest[1], 5, 128, 0.02, 0.0, "exact", own)
        models = [training.train(tr, replace(cfg, lam=x)) for x in lambdas]
        rows = [stats.evaluate(x, m.predict(ev.x), ev.y, ev.w, ev.m) for x, m in zip(lambdas, models)]
        inputs = {"eval_events": n, "eval_oid": ev.oid(), "features": 4, "model_oids": [m.oid for m in models], "train_events": n, "train_oid": tr.oid()}
        r = training.benchmark_report(lambdas, star, rows, cfg, inputs, 20, 0.5)
        return {"report_json": Output("utf8", r.json().encode()), "report_md": Output("utf8", r.markdown().encode())}
    raise ValueError(f"no case {case}")


# -------------------------------------------------------------- suites as tables

SCHEMA = "case string, output string, dtype string, length long, sha3 string, data binary"


def run(spark: SparkSession, prefixes: tuple[str, ...] = ("",), backend: str = "cpu") -> DataFrame:
    """Outputs of all cases whose name begins with a prefix: a row for each, whole
    up to `WHOLE` bytes. Cases are independent, a task each where room is."""
    names = [c for c in cases() if c.startswith(tuple(prefixes))]
    rows = spark.createDataFrame([(c,) for c in names], "case string").repartition(min(len(names), 4 * spark.sparkContext.defaultParallelism), "case")
    keep = kernels.backend(backend)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if backend not in kernels.registered_backends():
            kernels.register_backend(backend, keep)
        for t in batches:
            for c in t.column(0).to_pylist():
                got = run_case(c, backend)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c] * len(got)), pa.array(list(got)), pa.array([o.dtype for o in got.values()]), pa.array([len(o.data) for o in got.values()], pa.int64()), pa.array([provenance.sha3(o.data) for o in got.values()]), pa.array([o.data if len(o.data) <= WHOLE else None for o in got.values()], pa.binary())],
                    names=["case", "output", "dtype", "length", "sha3", "data"],
                )

    return rows.mapInArrow(work, SCHEMA)


def first_difference(dtype: str, a: bytes, b: bytes) -> tuple[int, int | None] | None:
    """(index of the first differing element, distance in units in the last place)."""
    if a == b:
        return None
    kind = {"float32": "<i4", "float64": "<i8", "uint32": "<u4"}.get(dtype, "u1")
    x, y = (np.frombuffer(v[: len(v) // np.dtype(kind).itemsize * np.dtype(kind).itemsize], kind).astype(object) for v in (a, b))
    n = min(len(x), len(y))
    at = next((k for k in range(n) if x[k] != y[k]), n)
    if dtype not in ("float32", "float64") or at == n:
        return at, None
    low = -(2 ** (31 if dtype == "float32" else 63))
    ordered = lambda v: v if v >= 0 else low - v
    return at, abs(ordered(x[at]) - ordered(y[at]))


def compare(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(case, output, passed, at, ulps) by a join; a missing output fails."""
    e = expected.select("case", "output", F.col("sha3").alias("want"), F.col("data").alias("want_data"))
    j = e.join(actual, ["case", "output"], "left").select("case", "output", "dtype", "sha3", "want", "data", "want_data")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            rows = t.to_pylist()
            where = [first_difference(r["dtype"], r["data"], r["want_data"]) if r["sha3"] != r["want"] and r["data"] is not None and r["want_data"] is not None else None for r in rows]
            ulps = [None if w is None or w[1] is None else min(int(w[1]), 2**62) for w in where]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array([r["sha3"] == r["want"] for r in rows]), pa.array([w and w[0] for w in where], pa.int64()), pa.array(ulps, pa.int64())], names=["case", "output", "passed", "at", "ulps"])

    return j.mapInArrow(work, "case string, output string, passed boolean, at long, ulps long")


def generate(spark: SparkSession, path: str, prefixes: tuple[str, ...] = ("",)) -> None:
    """Write the outputs of all cases as a table of vectors."""
    run(spark, prefixes).write.mode("overwrite").parquet(path)


def load_expected(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def run_against(spark: SparkSession, path: str, backend: str = "cpu", prefixes: tuple[str, ...] = ("",)) -> DataFrame:
    """`compare` of a backend's outputs with a table of vectors."""
    expected = load_expected(spark, path)
    own = [F.col("case").startswith(p) for p in prefixes]
    return compare(run(spark, prefixes, backend), expected.where(functools.reduce(lambda a, b: a | b, own)))


# ------------------------------------------------------------ recorded digests


def group_of(case: str) -> str:
    """Cases of one size or configuration are recorded together."""
    parts = case.split("/")
    return "/".join(parts[: {"scatter": 4, "tier2": 99}.get(parts[0], 2)])


def groups() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for c in cases():
        out.setdefault(group_of(c), []).append(c)
    return out


def group_digest(names: list[str], backend: str = "cpu") -> str:
    """SHA3-256 over name, type and bytes of every output of every case, in order; of
    a sweep, its recorded hash."""
    if names[0].startswith("sweep/"):
        return run_case(names[0], backend)["out"].data.decode()
    h = hashlib.sha3_256()
    for c in names:
        for name, o in run_case(c, backend).items():
            h.update(f"{c}|{name}|{o.dtype}|{len(o.data)}|".encode() + hashlib.sha3_256(o.data).digest())
    return h.hexdigest()


def recorded(group: str) -> str | None:
    return sweeps.HASHES[group.split("/")[1]] if group.startswith("sweep/") else DIGESTS.get(group)


def check(spark: SparkSession, backend: str = "cpu", prefixes: tuple[str, ...] = ("",)) -> DataFrame:
    """(name, cases, passed): every group of cases against its recorded digest, in a
    task each."""
    own = {g: c for g, c in groups().items() if g.startswith(tuple(prefixes))}
    keep = kernels.backend(backend)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if backend not in kernels.registered_backends():
            kernels.register_backend(backend, keep)
        for t in batches:
            for name, n in zip(*(c.to_pylist() for c in t.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([group_digest(own[name], backend) == recorded(name)])], names=["name", "cases", "passed"])

    rows = spark.createDataFrame([(g, len(c)) for g, c in own.items()], "name string, cases long").repartition(len(own), "name")
    return rows.mapInArrow(work, "name string, cases long, passed boolean")


def selftest(backend: str = "cpu", subset: str = "quick") -> dict:
    """A backend's outputs against the recorded digests, without Spark."""
    if subset not in ("quick", "full"):
        raise ValueError("subset is quick or full")
    own = {g: c for g, c in groups().items() if subset == "full" or (g + "/").startswith(QUICK)}
    failed = [g for g, c in own.items() if group_digest(c, backend) != recorded(g)]
    n, bad = sum(map(len, own.values())), sum(len(own[g]) for g in failed)
    return {"cases": n, "passed": n - bad, "failed": bad, "failures": failed}


def report(results: DataFrame) -> str:
    """Canonical JSON of `check`."""
    rows = sorted(tuple(r) for r in results.collect())
    return provenance.canonical({"cases": sum(r[1] for r in rows), "failures": [r[0] for r in rows if not r[2]], "numerics_version": kernels.NUMERICS_VERSION, "passed": sum(r[1] for r in rows if r[2]), "suite_version": SUITE_VERSION}) + "\n"


# Digests of this engine's own outputs, recorded when sweeps, external
# fixtures, published figures and definitions agreed.
DIGESTS: dict[str, str] = {
    "fft1d/n2": "b6ee9839cc4d73fd5e1e7c89475e159cf848ec47f9f883c2111380faecc6395a",
    "fft1d/n4": "57f89a3d9fb1055f045ee15de7925cca8d2eddd5fea6486c9fb90a8375725539",
    "fft1d/n8": "bb9ba9ef32e33d2ecdebd2332a8d14b39376c7eaed06bec5c6570c0482a21e19",
    "fft1d/n16": "4f613357013f3868a1fa5c5b1b96f09319188f5afee7a0c9debbf214e3b77215",
    "fft1d/n32": "08171ff3b6fd2b0e1a0327f40318164efa8607b6f00bb226f5a491a5e3ac4886",
    "fft1d/n64": "b0be09a6de12c5e84f6f5831e6ea15cf6d47fcbbe01221fb7827c93f828be3a0",
    "fft1d/n128": "3b3a8ed2f8d5a5d8e76760198f89655521e64f1fd0c4baf93cf8352351c3a861",
    "fft1d/n256": "2f58aa02d6d47989ce69b5df1182955f287b4f7def925a48ad1218cc7388a8cc",
    "fft1d/n512": "ef397ccaaef6ff718b85d3cf18f8e4b47752e06878cbb8bc9865dedf76681616",
    "fft1d/n1024": "5f720db2dd1c093aba7bad99849a3dc9fd28ce0aa709fe29907e94e7c99ae3ad",
    "fft1d/n2048": "c0be2f775715afb1fea164f2a20694c309b9af0cf7e085dd32729b5a3ca854d6",
    "fft1d/n4096": "3007f7d57a7820b3ea92104ec18a52d6824a9ce7a55e338bfbb6fd3d50321d1a",
    "fft2d/2x4": "5101ff47ed1274f4aeb2cc87d849574beec44004b5961c3a75f951aa8cced2a3",
    "fft2d/8x8": "bc917bc51756355bc423e35529a7f640c8ac07060992f4a34bf3f414243c3df4",
    "fft2d/16x64": "62b692ab0a3e6a34d881d963ff5c3ce8da2d50eb9b0cc7bb99f0922360930772",
    "fft2d/64x16": "32ecd06f6fb4931db4e5a4059c887d037bbea42158c4d81bcf5fc41ef83459dd",
    "fft2d/128x128": "802502799aab767b1678153a3d514fd405e5a11c1b1eb86ed5d2d3071057c472",
    "fft2d/256x32": "0325bc66775c19ddb4e9240e8973939a8396ee16dcc520cd89cec5185b6e28f8",
    "modulus/n1024": "d0541ae3839a74b389df83c3defefcab7821fb02efbc0337937f2fd412fbb7f2",
    "mul_real_filter/1x256": "fa20c99e224356927877821031ede8f6794e9beb3c2bb62a4b4ebd87fd2c26e9",
    "mul_real_filter/32x32": "f51e3b4f165b21d71fa5d6a6856f18b74550dc2d7607b76d8fa065a581cc5c0c",
    "mul_real_filter/64x4": "59cceb2fd1f81df75b4095f4009a162043aed40bcb66c1e0efa9618c62d1d7bc",
    "scatter/1d/256/J2-Q1-L1": "935dcda0fdc811883e4f4f61137ae9dea65bf3ef018fc2cddf1d0fa99d397bad",
    "scatter/1d/256/J2-Q4-L1": "2be0afe1174c040362a5de373eb1620e705f34d66f7e5927b20ab5e93ac9ab74",
    "scatter/1d/256/J2-Q8-L1": "0bd4649c6e4d80e89dc767dad9fb8ae9d561d66aa18a8fa76bcd80792bb1083f",
    "scatter/1d/256/J4-Q1-L1": "34b60d09f578c131d923665fa90b80f0cc8b900c488682b38121514da38175ef",
    "scatter/1d/256/J4-Q4-L1": "4523844619756a3bcc3954511fc1126317dd5543f63c82d9da0b6b6a8473f2fe",
    "scatter/1d/256/J4-Q8-L1": "c597cc1c7ce9cf5111a78a8889b69a973679a2e84b196e9c6db0298d734fcef7",
    "scatter/1d/256/J6-Q1-L1": "913c1cfc4f23d3e7a89a1988914fb708473ebe1d368726bd325b30b0dd13b4ec",
    "scatter/1d/256/J6-Q4-L1": "e76b06ac95098723d6f3fdab5cc53b4edbb80e65686292d43c26613dda5a3239",
    "scatter/1d/256/J6-Q8-L1": "269fe71be530de8f88d228435e51850b9c49b4825d3787ae62351fa8c44c2752",
    "scatter/1d/1024/J2-Q1-L1": "afad8082de79e2832e8af74a8bd41b38e0191c347d43cf6f8f016c1991ea2afc",
    "scatter/1d/1024/J2-Q4-L1": "515452aa0d4ae120aea1977d4622df7ef15cd83f4addc39460fe6ca7fc1f4685",
    "scatter/1d/1024/J2-Q8-L1": "29f1cbee2a3e520c3c2610e563441f215148632cdf502cc211129df8f4c69721",
    "scatter/1d/1024/J4-Q1-L1": "ed0e9c52df2e4c318245272d83a5bf99fd5b29018b7ca923bbc2af5503fdae07",
    "scatter/1d/1024/J4-Q4-L1": "37ff6d0a1bd43ed0888c41ac8d3244bf83b8c2a96216a18e47f2feebde0047da",
    "scatter/1d/1024/J4-Q8-L1": "6801e496d2255c8ad4fffd1206ff55b82fa7457351c31b3a99f82839430fb280",
    "scatter/1d/1024/J6-Q1-L1": "9757435e4900ee51ef1ea3f27ec290e3adcd86418824f979a03890a71fedc336",
    "scatter/1d/1024/J6-Q4-L1": "29178d976136bb852c6ae53d016ca3392c4ea799b684e1c82bf5c426829d7189",
    "scatter/1d/1024/J6-Q8-L1": "9f7c4a9f3e0b53388f26ff01b055dc0b84e863cdf874350670a65990113608ce",
    "scatter/1d/192/J4-Q1-L1": "8d700bf8d3461cd1f2cab39d21230a5b36df6737dfabfb2a09d867582f1767bc",
    "scatter/1d/192/J4-Q4-L1": "520c9d6eb2e9460474fad37a288f2dcffd1896c3c3d8593d619fc335586ee31b",
    "scatter/1d/256/J4-Q2-L1": "a68ad35968bfa9ea9b9e06a66cfdccb3480f5cc8818fd4ec6a3c5a5f90876f41",
    "scatter/1d/256/J3-Q1-L1": "d3e6b5b7a4481b0831864a365115444362db81dc326d244385878f9fe381fcba",
    "scatter/2d/32x32/J1-Q1-L4": "613b20f41b241e1f01a58691146e0814bc1c70038f7bd8811ca87d6c5bf91b1e",
    "scatter/2d/32x32/J1-Q1-L8": "b26342ca629b40125e50a27b16b90ca0f585bda7b3e6f3e7ebb1b4a1986b40b1",
    "scatter/2d/32x32/J2-Q1-L4": "ee1eb88c2e099b91425252e57f6078f42c5ac8afe939cf9d8a5fd1dd82a03b13",
    "scatter/2d/32x32/J2-Q1-L8": "5f2bf04ee0e89f828bee7f26dd53f439bea44841c17aba7a4ad6da7ba65c3ed1",
    "scatter/2d/32x32/J3-Q1-L4": "5fc9fab1aa9b79990ddd13a19b45fdc32497663a9759ba529edf98f9286618b3",
    "scatter/2d/32x32/J3-Q1-L8": "e162021f721f385050831021be580077bbd89f562c207b9149349fe6cc59bf64",
    "scatter/2d/32x32/J4-Q1-L4": "5f2440991ecac2b1f8e075925d0438b558577a683a2ce5478cea1e907cf8406d",
    "scatter/2d/32x32/J4-Q1-L8": "4b59db7a60e09f6dc7c4b806c57031399a6074989c3bcc1673931a67fd3c042b",
    "scatter/2d/64x64/J1-Q1-L4": "9fcafffd2ac7a2de53d8ccb614f8a8412e657a7c556b8429783d6e101387de6c",
    "scatter/2d/64x64/J1-Q1-L8": "e471d26c12c1fd16cd94588e028ee138d417fd8de730139cb90f91f08069ae85",
    "scatter/2d/64x64/J2-Q1-L4": "a9116cd7e5e8eaadb38d21b3460b5db89105288e2f0906059cf5c7952e6c6145",
    "scatter/2d/64x64/J2-Q1-L8": "1f3549486cc85c57d936abd6185cee3afcab11948454e8934e812c73162f53a1",
    "scatter/2d/64x64/J3-Q1-L4": "d4cf2d3bdd60dec67fb08dfef23f9d13be0c66a9541e20123f5f6ffd0bcfdea1",
    "scatter/2d/64x64/J3-Q1-L8": "467965a267e19e43e0e8cf5f5c78a823d2b917204be8cc9d835c101bb2922512",
    "scatter/2d/64x64/J4-Q1-L4": "9ad1f17e09c3d8ec55e46ffdcb6e33111ac4dd5185e6d05a65c65bc8a2f7f894",
    "scatter/2d/64x64/J4-Q1-L8": "e77f83ad8f0dd32ecf55f3e0ba3a0622b77f735445a86ae69bb3f1c913590ccb",
    "scatter/2d/128x128/J1-Q1-L4": "c597d1046cd4332a487053b2f4cc088403b8781e2d3936206faaf5200eb24b74",
    "scatter/2d/128x128/J1-Q1-L8": "66b80ea11639d489f597af13dc08f346d93c0745f5e23d11d5c8c74f15f57cca",
    "scatter/2d/128x128/J2-Q1-L4": "1f5ddd225676e0118848b2713b8d1b25c4923ebe67ea5e37b7bb4fb6ba8ec43e",
    "scatter/2d/128x128/J2-Q1-L8": "74255a44d4ca0f7edf315cace3e93ffe83732a79737fa5e0c31cddbea69ad9c9",
    "scatter/2d/128x128/J3-Q1-L4": "3a3e08dfa28792fc88be6ad182a7e204aa021421da398d3fbae49ecfc80e426a",
    "scatter/2d/128x128/J3-Q1-L8": "4b1219d3c471d1b96377cd43f616efac0b6287da60399ae9195d3a9546550698",
    "scatter/2d/128x128/J4-Q1-L4": "b69e6025d25cdb64748039b380660db0c1b1eedc5322bcf0983f8eaeae6ed550",
    "scatter/2d/128x128/J4-Q1-L8": "2411fad7c5bd9f1f4feaefb2b1e13b794de66c2589f22db179723bf9d6c3b05a",
    "scatter/2d/32x64/J3-Q1-L6": "2aa38d6b287361c8430dcce4c462d5dd66c3c4fee4e5a30c2b1b594f8387c654",
    "tier2/dcorr_exact/n200/unweighted": "13c6133b52272d1aac0190a0685e324f4eb698c72490364fba211d5961fe8e33",
    "tier2/dcorr_exact/n200/weighted": "986af848b9b50d42043d3711f3e8eee3c0a1c5e15cb2721851b7f4cb2dd70033",
    "tier2/dcorr_exact/n1000/weighted": "49018fc82f5dbf591a3a1c9ade896fb78cba9fa946e81df3f109eb347e1515d8",
    "tier2/dcorr_chunked/n12000/weighted": "c123fcc6c535ba643208afc76cf142b142f55170c53fe2d54de808937eadacf8",
    "tier2/dcorr_grad/n64/unweighted": "8504ef91edc96de4cc51a92a49b0d953b560de73d6189f6517d201726a809a10",
    "tier2/dcorr_grad/n300/weighted": "8744d60ac91b276016f969ebdfb3e068ec5e9731774f41ee5bf4d7c70159a031",
    "tier2/pearson_proxy/n300/weighted": "6797b65d5cdd42a92627cd1f53f4d9c6156171344fae1d972cd03b4253eeba61",
    "tier2/jsd/n2000/bins20": "38386ff4311971a5ef16e531d11a38135839cc0e861ec06ac7d45293f480b3e8",
    "tier2/jsd/n2000/bins7": "eba358de873debd0652212d3886c1850c23eb31ed4e53293a19078fb9920d6e8",
    "tier2/train/logistic/exact/lambda0/n600": "bc2b818c95e4fcaba947907d70abfa31c60582542b6017ef4d3e4054a286ac3d",
    "tier2/train/logistic/exact/lambda2/n600": "5522f0107ebe1f5aebed328230eee1cf0d75aed75adaa33a5198d322ea2de71a",
    "tier2/train/mlp8/exact/lambda2/n600": "eaff5a67e6ecd35b9a00812c584143dbf128ea171204a3e2be84ebad9be18e79",
    "tier2/train/logistic/pearson_proxy/lambda2/n600": "daa1e61f7ad6fce660c1545452ed12dc3686ee548824e0262059e9b743eeb98b",
    "tier2/calibration/n500/d6": "27eccecd343e760204103eef9b52a9fc2ef71979985e87e85b0d380ec410774d",
    "tier2/sw1/clouds16/points24/d6/dirs16": "ff8417e94621e104d4e2c1f53e3ab6abdcdcdc9dd734c53fb3cd0df935853f72",
    "tier2/hnsw/n300/m8/k4/tau1": "f945c69004310aec02ae6f1e4efa9d0a338999e5279ec1ce309f9a8fad141d90",
    "tier2/report/logistic/lambdas0_1_4/star1/n1200": "30f76f8568311086f50aa2c9e5c6eecaa86428eaa9c66e3995ef8d1281a87c95",
    "tier2/report/mlp16/lambdas0_0.5_2/star0.5/n1200": "e842a01640f503656c84ffdd35f37fe3856b1a1bdfed7378344681c59f7b4c46",
}
