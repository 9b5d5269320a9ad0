"""Scattering and its reductions on DataFrames.

A plan is compiled on the driver and travels with the tasks; events are mapped in
Arrow batches without a shuffle, so results do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.provenance import oid, tensor_bytes
from ..plans import scattering as S
from ..plans.scattering import ScatterConfig, Scattering

#: Bytes of coefficients in one batch that a task returns.
OUT_BYTES = 16 << 20


def list_array(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a column of lists."""
    kind = pa.float32() if x.dtype == np.float32 else pa.float64()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), kind))


def matrix(column: pa.Array, width: int, kind=np.float32) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("a signal is null")
    flat = column.flatten()
    if len(flat) != width * len(column) or (len(column) and (np.diff(column.offsets.to_numpy()) != width).any()):
        raise ValueError(f"a signal does not have {width} samples")
    if flat.null_count:
        raise ValueError("a sample is null")
    return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _whole(column: pa.Array) -> np.ndarray:
    """Which lists are there, with no element null."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten()
    if not flat.null_count:
        return there
    owner = np.repeat(np.flatnonzero(there), np.diff(column.offsets.to_numpy())[there])
    return there & (np.bincount(owner, flat.is_null().to_numpy(zero_copy_only=False), len(column)) == 0)


def _map(df: DataFrame, id_col: str, col: str, width: int, out: list[tuple[str, str]], f: Callable[[np.ndarray], list], rows: int, kind=np.float32, keep: tuple[str, ...] = ()) -> DataFrame:
    """Map a column of vectors, a bounded number of rows at a time; columns to keep go
    along. A vector that is null, or holds a null, gives nulls; one of another length
    is an error of the configuration and raises."""
    first = df.select(F.col(id_col).alias(id_col), *[F.col(c) for c in keep if c != id_col], F.col(col).alias("wm_vector"))
    names = [*first.columns[:-1], *(n for n, _ in out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for a in range(0, len(t), rows):
                part = t.slice(a, rows)
                vectors = part.column(len(part.schema) - 1)
                ok = _whole(vectors)
                cols = f(matrix(vectors.filter(pa.array(ok)), width, kind) if ok.any() else np.zeros((1, width), kind))
                cols = [list_array(c) if isinstance(c, np.ndarray) and c.ndim == 2 else pa.array(c) for c in cols]
                if not ok.all():
                    place = pa.array(np.where(ok, np.cumsum(ok) - 1, 0), mask=~ok)
                    cols = [c.take(place) for c in cols]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], names=names)

    fields = [f"`{x.name}` {x.dataType.simpleString()}" for x in first.schema[:-1]]
    return first.mapInArrow(run, ", ".join([*fields, *(f"`{n}` {k}" for n, k in out)]))


def scatter(df: DataFrame, cfg: ScatterConfig | dict, *, id_col: str = "event_id", signal_col: str = "signal", backend: str = "cpu", with_oid: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, coeffs): coefficients in order of path, then position,
    binary32; null where the signal or one of its samples is."""
    cfg = cfg if isinstance(cfg, ScatterConfig) else ScatterConfig.parse(cfg)
    plan = Scattering.compile(cfg)
    rows = max(1, min(1024, OUT_BYTES // (4 * len(plan.raw_paths) * cfg.out_len)))

    def f(x: np.ndarray) -> list:
        s = plan.run(x, backend)
        s = s.reshape(len(s), -1)
        return [s, [oid(tensor_bytes(r, "float32")) for r in s]] if with_oid else [s]

    return _map(df, id_col, signal_col, cfg.signal_len, [("coeffs", "array<float>"), *([("oid", "string")] if with_oid else [])], f, rows, keep=keep)


def reduced(coeffs: DataFrame, cfg: ScatterConfig | dict, names: list[str], *, id_col: str = "event_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, one column for each of `names`, of `REDUCTIONS`): any number
    of reductions in one pass over the coefficients."""
    cfg = cfg if isinstance(cfg, ScatterConfig) else ScatterConfig.parse(cfg)
    plan = Scattering.compile(cfg)
    width = len(plan.paths) * cfg.out_len
    out = [REDUCTIONS[n] for n in names]

    def f(x: np.ndarray) -> list:
        s = x.reshape(len(x), len(plan.paths), cfg.out_len)
        return [r[2](plan, s) for r in out]

    return _map(coeffs, id_col, "coeffs", width, [(r[0], r[1]) for r in out], f, max(1, OUT_BYTES // (8 * width)), keep=keep)


#: Reductions by name: column, type, and function of (plan, coefficients).
REDUCTIONS: dict[str, tuple[str, str, Callable]] = {
    "ratio": ("r2", "array<float>", lambda p, s: p.ratio(s).reshape(len(s), -1)),
    "log_mean": ("fp", "array<double>", lambda p, s: S.log_mean(s)),
    "mean": ("mean", "array<double>", lambda p, s: S.path_mean(s)),
    "std": ("std", "array<double>", lambda p, s: S.path_std(s)),
    "features": ("x", "array<double>", lambda p, s: S.path_mean(p.ratio(s))),
    "clouds": ("cloud", "array<double>", lambda p, s: S.clouds(s).reshape(len(s), -1)),
}


def r2(coeffs: DataFrame, cfg, *, id_col: str = "event_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, r2): second- over first-order coefficients, 0 where the latter are."""
    return reduced(coeffs, cfg, ["ratio"], id_col=id_col, keep=keep)


def fingerprint(coeffs: DataFrame, cfg, *, id_col: str = "event_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp): mean of ln(2^-20 + |c|) per path, ordered sums."""
    return reduced(coeffs, cfg, ["log_mean"], id_col=id_col, keep=keep)


def path_mean(coeffs: DataFrame, cfg, *, id_col: str = "event_id", keep: tuple[str, ...] = ()) -> DataFrame:
    return reduced(coeffs, cfg, ["mean"], id_col=id_col, keep=keep)


def path_std(coeffs: DataFrame, cfg, *, id_col: str = "event_id", keep: tuple[str, ...] = ()) -> DataFrame:
    return reduced(coeffs, cfg, ["std"], id_col=id_col, keep=keep)


def features_from_r2(coeffs: DataFrame, cfg, *, id_col: str = "event_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, x): mean ratio per pair, as features of a classifier."""
    return reduced(coeffs, cfg, ["features"], id_col=id_col, keep=keep)


def fingerprint_clouds(coeffs: DataFrame, cfg, *, id_col: str = "event_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, cloud): points of one coordinate per path, a point per position, flat."""
    return reduced(coeffs, cfg, ["clouds"], id_col=id_col, keep=keep)


def reduce_coefficients(coeffs: DataFrame, cfg, method: str = "ratio", *, id_col: str = "event_id") -> DataFrame:
    methods = ("log_mean", "mean", "ratio", "std")
    if method not in methods:
        raise ValueError(f"method is one of {list(methods)}")
    return reduced(coeffs, cfg, [method], id_col=id_col)


def coeffs_long(coeffs: DataFrame, cfg: ScatterConfig, *, id_col: str = "event_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, path_id, pos, value)."""
    n = cfg.out_len
    return coeffs.select(id_col, *keep, F.posexplode("coeffs").alias("at", "value")).select(id_col, *keep, F.expr(f"int(at div {n})").alias("path_id"), (F.col("at") % n).alias("pos"), "value")


def scatter_paths(spark: SparkSession, cfg: ScatterConfig | dict) -> DataFrame:
    """(path_id, ord, n, j, theta) in canonical order."""
    cfg = cfg if isinstance(cfg, ScatterConfig) else ScatterConfig.parse(cfg)
    rows = [(k, p.order, list(p.n), list(p.j), list(p.theta)) for k, p in enumerate(Scattering.compile(cfg).paths)]
    return spark.createDataFrame(rows, "path_id int, ord int, n array<int>, j array<int>, theta array<int>")


def filters(spark: SparkSession, cfg: ScatterConfig) -> DataFrame:
    """(bank, idx, j, theta, xi, sigma, fourier)."""
    b = S.filter_bank(cfg)
    rows = [("phi", 0, cfg.J, 0, 0.0, 0.0, b.phi.ravel().tolist())]
    for name, hs, info in (("psi1", b.first, b.first_info), ("psi2", b.second or (), b.second_info)):
        rows += [(name, k, j, t, float(x), float(s), h.ravel().tolist()) for k, (h, (j, t, x, s)) in enumerate(zip(hs, info))]
    return spark.createDataFrame(rows, "bank string, idx int, j int, theta int, xi double, sigma double, fourier array<float>")


def with_oids(df: DataFrame, col: str, kind: str = "float32", *, out: str = "oid") -> DataFrame:
    """The identifier of each row's vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            at = t.schema.get_field_index(col)
            ids = [None if v is None else oid(tensor_bytes(np.array(v), kind)) for v in t.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(ids, pa.string())], names=[*t.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{out}` string")


# ----------------------------------------------- the same steps, as plain joins


def dft(df: DataFrame, n: int, bins: int, *, id_col: str, signal_col: str) -> DataFrame:
    """(id, k, re, im) by definition: a small table of angles meets the samples."""
    x = df.select(id_col, F.posexplode(signal_col).alias("pos", "x"))
    k = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("k"))
    angle = F.lit(-2.0 * np.pi / n) * ((F.col("pos") * F.col("k")) % n)
    both = x.join(F.broadcast(k))
    return both.groupBy(id_col, "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))


def so2_pool(cube: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over the orientation, in binary64, rounded once to binary32."""
    return cube.groupBy(*keys).agg(F.avg(F.col(value).cast("double")).cast("float").alias("pooled"))
