"""Queries that run the engine's own functions on table data, each against SQL that is
written from a definition: portable math, flushes, transforms, random streams, ordered
sums, statistics per group, training steps, canonical JSON.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import anomaly, detmath, kernels, provenance, rng, stats, sums, training
from ..operators import signals
from . import definitions as D
from .queries import _FEATURES, ridge_sql
from .registry import EV, X, events, query, read, rounded

F32 = np.float32


def mapped(df: DataFrame, schema: str, f: Callable[..., dict]) -> DataFrame:
    """Rows of plain columns through numpy; f takes the columns as arrays."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out = f(**{n: c.to_numpy(zero_copy_only=False) for n, c in zip(names, t.columns)})
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()], names=list(out))

    return df.mapInArrow(run, schema)


def per_group(df: DataFrame, key: str, order: list[str], schema: str, f: Callable[..., dict]) -> DataFrame:
    """Groups in the order of a key through numpy; the key comes first."""
    kind = dict(df.dtypes)[key]

    def run(k: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in order])
        out = f(**{n: t.column(n).to_numpy() for n in t.schema.names if n != key})
        n = len(next(iter(out.values())))
        return pa.table({key: pa.array([k[0].as_py()] * n, k[0].type), **{c: pa.array(v) for c, v in out.items()}})

    return df.groupBy(key).applyInArrow(run, f"`{key}` {kind}, {schema}")


# --------------------------------------------------------------- portable math


def sql_round(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as SQL does: scaled, halves away from zero, scaled back; one zero. Spark
    rounds the shortest decimal form, which may be a half where the value is not."""
    with np.errstate(all="ignore"):
        scale = 10.0**digits
        y = x * scale
        whole = np.trunc(y)
        r = (whole + np.where(np.abs(y - whole) >= 0.5, np.copysign(1.0, y), 0.0)) / scale
        return np.where(np.isfinite(r), r, x) + 0.0


def settled(name: str, x: np.ndarray, digits: int) -> np.ndarray:
    """A function of detmath, rounded. Its values may be one off in the last place;
    where such a neighbour rounds to something else, the nearest double decides."""
    y = getattr(detmath, name)(x)
    out = sql_round(y, digits)
    with np.errstate(all="ignore"):
        near = [sql_round(np.nextafter(y, to), digits) != out for to in (-np.inf, np.inf)]
    at = np.flatnonzero((near[0] | near[1]) & np.isfinite(y))
    out[at] = sql_round(np.array([detmath.nearest(name, float(x[i])) for i in at]), digits)
    return out


@query("SELECT event_id, round(exp(value / 100), 9) + 0.0 AS e, round(ln(value), 9) + 0.0 AS l, round(sin(value), 9) + 0.0 AS s, round(cos(value), 9) + 0.0 AS c, round(sin(value * 1e7), 5) + 0.0 AS far FROM events")
def portable_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exp, ln, sin, cos in binary64; arguments up to 5e9 for the far reduction."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("value").alias("v"), F.col("value").isNull().alias("none"))

    def f(event_id, v, none) -> dict:
        v = v.astype(np.float64)
        columns = {"e": ("exp", v / 100, 9), "l": ("ln", v, 9), "s": ("sin", v, 9), "c": ("cos", v, 9), "far": ("sin", v * 1e7, 5)}
        return {"event_id": event_id, **{c: pa.array(settled(*a), mask=none) for c, a in columns.items()}}

    return mapped(e, "event_id long, e double, l double, s double, c double, far double", f)


@query(f"WITH {X} SELECT vec_id, pos, " + ", ".join(f"CAST(CAST({f} AS FLOAT) AS DOUBLE) AS {n}" for n, f in (("e", "exp(x)"), ("l", "ln(abs(x) + 1)"), ("s", "sin(x)"), ("c", "cos(x)"))) + " FROM (SELECT vec_id, pos, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x FROM x WHERE pos < 4)")
def portable_functions_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The binary32 forms, bit for bit: evaluated in binary64 and rounded once."""
    x = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 4)).alias("pos", "x")).select("vec_id", "pos", F.col("x").cast("float").alias("x"))

    def f(vec_id, pos, x) -> dict:
        up = (np.abs(x.astype(np.float64)) + 1).astype(np.float64)
        return {"vec_id": vec_id, "pos": pos, "e": detmath.exp_f32(x).astype(np.float64), "l": np.asarray(detmath.ln(up)).astype(F32).astype(np.float64), "s": detmath.sin_f32(x).astype(np.float64), "c": detmath.cos_f32(x).astype(np.float64)}

    return mapped(x, "vec_id long, pos int, e double, l double, s double, c double", f)


@query("SELECT event_id, round(1 / (1 + exp(-z)), 9) + 0.0 AS sigmoid, round(tanh(z), 9) + 0.0 AS tanh, round(ln(1 + exp(z)), 9) + 0.0 AS softplus FROM (SELECT event_id, (value - 245) / 50 AS z FROM events)")
def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", ((F.col("value") - 245) / 50).alias("z"))
    got = mapped(e, "event_id long, sigmoid double, tanh double, softplus double", lambda event_id, z: {"event_id": event_id, "sigmoid": detmath.sigmoid(z), "tanh": detmath.tanh(z), "softplus": detmath.softplus(z)})
    return got.select("event_id", *[rounded(F.col(c), 9).alias(c) for c in ("sigmoid", "tanh", "softplus")])


@query("SELECT q, round(pow(2.0, 1.0 / q), 12) + 0.0 AS step, round(pow(2.0, -3.0 / q), 12) + 0.0 AS back, pow(2.0, q - 16) AS whole FROM range(1, 33) r(q)")
def powers_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mapped(spark.range(1, 33).withColumnRenamed("id", "q"), "q long, step double, back double, whole double", lambda q: {"q": q, "step": [detmath.pow2(1 / k) for k in q.tolist()], "back": [detmath.pow2(-3 / k) for k in q.tolist()], "whole": [detmath.pow2(k - 16) for k in q.tolist()]})
    return got.select("q", rounded(F.col("step"), 12).alias("step"), rounded(F.col("back"), 12).alias("back"), "whole")


_TINY = "pow(2.0, -126)"


@query(f"""WITH {X}, p AS (SELECT a.vec_id, a.pos, a.x * pow(2.0, -64) AS a, b.x * pow(2.0, -62) AS b, CAST(CAST(a.x * pow(2.0, -127) AS FLOAT) AS DOUBLE) AS c FROM x a JOIN x b ON b.vec_id = a.vec_id AND b.pos = (a.pos + 1) % 64)
SELECT vec_id, pos, CASE WHEN abs(a * b) < {_TINY} THEN 0 ELSE CAST(CAST(a * b AS FLOAT) AS DOUBLE) END * pow(2.0, 126) + 0.0 AS product, CASE WHEN abs(c) < {_TINY} THEN 0 ELSE c END * pow(2.0, 126) + 0.0 AS flushed FROM p""")
def flushed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products and values around 2^-126: judged before rounding, flushed to zero."""

    def f(x: np.ndarray) -> list:
        a, b = np.ldexp(x, -64).astype(F32), np.ldexp(np.roll(x, -1, 1), -62).astype(F32)
        c = (x.astype(np.float64) * 2.0**-127).astype(F32)
        up = lambda v: np.ldexp(v.astype(np.float64), 126) + 0.0
        return [up(kernels.mul(kernels.ftz(a), kernels.ftz(b))), up(kernels.ftz(c))]

    m = signals._map(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, [("p", "array<double>"), ("c", "array<double>")], f, 512)
    return m.select("vec_id", F.posexplode(F.arrays_zip("p", "c")).alias("pos", "v")).select("vec_id", "pos", F.col("v.p").alias("product"), F.col("v.c").alias("flushed"))


# ------------------------------------------------------------------ transforms


@query(f"""WITH {X}, f AS (SELECT vec_id, pos, CAST(x AS FLOAT) AS x FROM x), h AS (SELECT i, CAST(exp(-i * i / 128.0) AS FLOAT) AS h FROM range(32) r(i))
SELECT a.vec_id, CAST(h.i AS INTEGER) AS i, CAST(a.x * h.h AS DOUBLE) AS re, CAST(b.x * h.h AS DOUBLE) AS im FROM f a JOIN f b ON b.vec_id = a.vec_id AND b.pos = a.pos + 1 JOIN h ON h.i = a.pos // 2 WHERE a.pos % 2 = 0""")
def filter_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex samples times a real filter, bit for bit."""
    h = np.exp(-(np.arange(32.0) ** 2) / 128).astype(F32)

    def f(x: np.ndarray) -> list:
        re, im = kernels.mul_real_filter(np.ascontiguousarray(x[:, 0::2]), np.ascontiguousarray(x[:, 1::2]), np.broadcast_to(h, (len(x), 32)))
        return [re.astype(np.float64), im.astype(np.float64)]

    m = signals._map(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, [("re", "array<double>"), ("im", "array<double>")], f, 512)
    return m.select("vec_id", F.posexplode(F.arrays_zip("re", "im")).alias("i", "v")).select("vec_id", "i", F.col("v.re").alias("re"), F.col("v.im").alias("im"))


@query(f"WITH {X} SELECT vec_id, CAST((pos // 8 // 2 - 1) * 2 + pos % 8 // 4 AS INTEGER) AS i, x AS v FROM x WHERE pos // 8 % 2 = 0 AND pos % 4 = 0 AND pos // 8 >= 2")
def subsample_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 8 x 8: every second row from the second sample on, every fourth column."""
    f = lambda x: [np.moveaxis(kernels.subsample(np.moveaxis(x.reshape(-1, 8, 8), 0, -1), (2, 4), (1, 0), (3, 2)), -1, 0).reshape(len(x), -1).astype(np.float64)]
    m = signals._map(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, [("v", "array<double>")], f, 512)
    return m.select("vec_id", F.posexplode("v").alias("i", "v"))


@query(f"""WITH {X}, k AS (SELECT CAST(i AS INTEGER) AS k FROM range(64) r(i)),
d AS (SELECT vec_id, k, sum(x * cos(2 * pi() * ((pos // 8 * (k // 8) + pos % 8 * (k % 8)) % 8) / 8)) AS re, sum(x * sin(2 * pi() * ((pos // 8 * (k // 8) + pos % 8 * (k % 8)) % 8) / 8)) AS im FROM x, k GROUP BY vec_id, k)
SELECT k, count(*) AS n, round(avg(re * re + im * im), 3) + 0.0 AS power, TRUE AS inverts FROM d GROUP BY k""")
def fft2_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-dimensional transform of images against its definition, and its inverse."""

    def f(x: np.ndarray) -> list:
        a = np.ascontiguousarray(np.moveaxis(x.reshape(-1, 8, 8), 0, -1))
        re, im = kernels.fft2(a, np.zeros_like(a))
        back, rest = kernels.fft2(re, im, inverse=True)
        p = (re.astype(np.float64) ** 2 + im.astype(np.float64) ** 2).reshape(64, -1).T
        ok = (np.abs(back - a) < 1e-5).reshape(64, -1).T & (np.abs(rest) < 1e-5).reshape(64, -1).T
        return [p, pa.array(ok.tolist(), pa.list_(pa.bool_()))]

    m = signals._map(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, [("p", "array<double>"), ("ok", "array<boolean>")], f, 512)
    return m.select(F.posexplode(F.arrays_zip("p", "ok")).alias("k", "v")).groupBy("k").agg(F.count("*").alias("n"), rounded(F.avg("v.p"), 3).alias("power"), F.every("v.ok").alias("inverts"))


@query("SELECT label, count(*) AS n, TRUE AS recursive, TRUE AS flushed FROM embeddings GROUP BY label")
def fft_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform is, bit for bit, its recursive definition and the form that flushes
    after every operation; samples are scaled to where flushes matter."""

    def f(x: np.ndarray) -> list:
        a = np.ascontiguousarray(np.ldexp(x[:, :16], -124).T).astype(F32)
        b = np.ascontiguousarray(np.ldexp(x[:, 16:32], -124).T).astype(F32)
        fast, slow = kernels.fft(a.copy(), b.copy()), kernels.fft(a.copy(), b.copy(), always_flush=True)
        bits = lambda v: v.view(np.uint32)
        flushed = [(bits(p) == bits(q)).all(0) for p, q in zip(fast, slow)]
        rec = [kernels.fft_recursive(a[:, k], b[:, k]) for k in range(a.shape[1])]
        same = [all((bits(np.ascontiguousarray(fast[j][:, k])) == bits(r[j])).all() for j in (0, 1)) for k, r in enumerate(rec)]
        return [pa.array(same, pa.bool_()), pa.array(flushed[0] & flushed[1])]

    m = signals._map(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, [("same", "boolean"), ("flushed", "boolean")], f, 256, keep=("label",))
    return m.groupBy("label").agg(F.count("*").alias("n"), F.every("same").alias("recursive"), F.every("flushed").alias("flushed"))


# -------------------------------------------------------------- random streams


def _draws(spark: SparkSession, n: int, schema: str, f: Callable[[np.ndarray], dict]) -> DataFrame:
    return mapped(spark.range(n).withColumnRenamed("id", "i"), schema, f)


@query(f"WITH {D.splitmix('s', 42, 1000)} SELECT k AS i, CAST(z AS VARCHAR) AS z FROM s")
def splitmix_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _draws(spark, 1000, "i long, z string", lambda i: {"i": i, "z": pa.array([str(int(rng.splitmix64(42, int(k), 1)[0])) for k in i])})


@query(f"WITH {D.words('w', 5, 0x310000003, 4000)} SELECT i, CAST(v AS VARCHAR) AS word, u, CAST(v % 1000::UHUGEINT AS BIGINT) AS below FROM (SELECT w64.i, v, u FROM w64 JOIN wu ON wu.i = w64.i)")
def long_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit words, units and bounded integers; a draw for each place of a stream whose
    number needs more than 32 bits."""

    def f(i: np.ndarray) -> dict:
        s = lambda k: rng.Stream(5, 0x310000003, 2 * int(k))
        return {"i": i, "word": pa.array([str(int(s(k).next_u64(1)[0])) for k in i]), "u": [float(s(k).next_f64_unit(1)[0]) for k in i], "below": pa.array([s(k).below(1000) for k in i], pa.int64())}

    return _draws(spark, 2000, "i long, word string, u double, below long", f)


_N = 40


@query(f"""WITH RECURSIVE {D.words('w', 3, 9, 2 * _N)}, p AS (SELECT CAST({_N - 1} AS BIGINT) AS i, [x FOR x IN range({_N})] AS a
UNION ALL SELECT p.i - 1, list_transform(a, lambda x, k: CASE WHEN k = p.i + 1 THEN a[j + 1] WHEN k = j + 1 THEN a[p.i + 1] ELSE x END) FROM (SELECT p.i, a, CAST(v % (p.i + 1)::UHUGEINT AS BIGINT) AS j FROM p JOIN w64 ON w64.i = {_N - 1} - p.i) p WHERE p.i > 0)
SELECT CAST(pos AS BIGINT) AS pos, a[pos + 1] AS item FROM p, range({_N}) r(pos) WHERE p.i = 0""")
def drawn_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fisher and Yates's shuffle, from the last place down."""
    return spark.createDataFrame(list(enumerate(rng.Stream(3, 9).permutation(_N).tolist())), "pos long, item long")


_PER = 22


def _sample_sql(n: int = 400) -> str:
    at = lambda k: f"(SELECT u FROM wu WHERE wu.i = 11 * e.i + {k} / 2)"
    u = lambda k: f"u[{k // 2 + 1}]"
    g = lambda k: f"sqrt(-2 * ln(1 - {u(k)})) * cos(2 * pi() * {u(k + 2)})"
    x = [f"CASE WHEN sig THEN {g(6 + 4 * j)} ELSE {g(4 + 4 * j)} END" for j in range(4)]
    return f"""WITH {D.words('w', 8, 0x50000 + 2, n * _PER)}, e AS (SELECT i // 11 AS event_id, list(u ORDER BY i) AS u FROM wu WHERE i < {n * 11} GROUP BY i // 11),
s AS (SELECT *, {u(0)} < 0.3 AS sig FROM e), m AS (SELECT *, CASE WHEN sig THEN 120 + 8 * ({g(2)}) ELSE 50 + 150 * {u(2)} END AS m FROM s)
SELECT event_id, CAST(sig AS INTEGER) AS y, round(m, 8) + 0.0 AS m, round(CASE WHEN sig THEN 1 ELSE 0.5 + {u(20)} END, 9) + 0.0 AS w, round(CASE WHEN sig THEN 1 ELSE 0 END + {x[0]}, 8) + 0.0 AS x0, round(0.04 * (m - 100) + {x[1]}, 8) + 0.0 AS x1, round({x[2]}, 8) + 0.0 AS x2, round({x[3]}, 8) + 0.0 AS x3 FROM m"""


@query(_sample_sql)
def synthetic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled sample, made in tasks, against its formulas on SQL's own draws."""
    from ..operators import tables

    s = tables.synthetic_dataset(spark, 400, 4, 8, 2)
    return s.select("event_id", F.col("y").cast("int").alias("y"), rounded(F.col("m"), 8).alias("m"), rounded(F.col("w"), 9).alias("w"), *[rounded(F.col("x")[k], 8).alias(f"x{k}") for k in range(4)])


@query(f"WITH {D.directions('d', 6, 12)} SELECT k, c, round(w, 9) + 0.0 AS w FROM d")
def random_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = anomaly.directions(6, 12, 0)
    return spark.createDataFrame([(k, c, float(u[k, c])) for k in range(12) for c in range(6)], "k int, c int, w double").select("k", "c", rounded(F.col("w"), 9).alias("w"))


@query(f"WITH {D.words('w', 0, 0x40002, 2000)} SELECT CAST(least(floor(-ln(1 - u) / ln(8.0)), 16) AS INTEGER) AS level, count(*) AS nodes FROM wu WHERE i < 1000 GROUP BY level")
def graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of a graph of 1000 nodes, as they are drawn while it is built."""
    g = anomaly.Hnsw.build(1000, lambda i, j: float(abs(i - j)), anomaly.HnswConfig(ef_construction=2, m=8))
    return spark.createDataFrame([(x,) for x in g.levels], "level int").groupBy("level").agg(F.count("*").alias("nodes"))


# ----------------------------------------------------------------- ordered sums


@query(f"WITH {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x, event_id) - 1 AS up, row_number() OVER (PARTITION BY user_id ORDER BY x DESC, event_id) - 1 AS down FROM e) SELECT user_id, event_id, up, down, round(w / sum(w) OVER (PARTITION BY user_id), 12) + 0.0 AS share, round(sum(x) OVER (PARTITION BY user_id ORDER BY event_id), 6) + 0.0 AS running, round(avg(x) OVER (PARTITION BY user_id), 8) + 0.0 AS mean FROM o")
def ordered_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total orders, sequential and tree sums, means and shares within each user."""

    def f(event_id, x, w) -> dict:
        up, down = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        up[sums.argsort(x)], down[sums.argsort_desc(x)] = np.arange(len(x)), np.arange(len(x))
        run = [sums.sequential_sum(x[: k + 1]) for k in range(len(x))]
        return {"event_id": event_id, "up": up, "down": down, "share": sums.normalised(w), "running": np.array(run, np.float64), "mean": np.full(len(x), sums.mean(x))}

    got = per_group(events(spark, sf_dir).select("user_id", "event_id", "x", "w"), "user_id", ["event_id"], "event_id long, up long, down long, share double, running double, mean double", f)
    return got.select("user_id", "event_id", "up", "down", rounded(F.col("share"), 12).alias("share"), rounded(F.col("running"), 6).alias("running"), rounded(F.col("mean"), 8).alias("mean"))


# -------------------------------------------------------- statistics per group

_P = "PARTITION BY user_id"


@query(f"""WITH {EV}, v AS (SELECT *, w / (sum(w) OVER ({_P}) + 1e-12) AS v FROM e), d AS (SELECT *, x - sum(v * x) OVER ({_P}) AS dx, y - sum(v * y) OVER ({_P}) AS dy FROM v),
m AS (SELECT *, sum(dx * dy * v) OVER ({_P}) AS cov, sum(dx * dx * v) OVER ({_P}) + 1e-12 AS vx, sum(dy * dy * v) OVER ({_P}) + 1e-12 AS vy FROM d)
SELECT user_id, event_id, round(1e4 * 2 * (cov / sqrt(vx * vy)) * v * (dy / sqrt(vx * vy) - cov / sqrt(vx * vy) * dx / vx), 6) + 0.0 AS grad FROM m""")
def proxy_gradient_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = per_group(events(spark, sf_dir), "user_id", ["event_id"], "event_id long, grad double", lambda event_id, x, y, w: {"event_id": event_id, "grad": stats.pearson_proxy_grad(x, y, w)})
    return got.select("user_id", "event_id", rounded(1e4 * F.col("grad"), 6).alias("grad"))


_BINS = f"""WITH {EV}, r AS (SELECT user_id, min(x) AS lo, max(x) AS hi FROM e GROUP BY user_id), b AS (SELECT e.user_id, CASE WHEN hi <= lo THEN 0 ELSE least(greatest(floor((x - lo) / (hi - lo) * 7), 0), 6) END AS bin, w, CASE WHEN y > 40 THEN w ELSE 0 END AS q FROM e JOIN r ON r.user_id = e.user_id),
h AS (SELECT user_id, bin, sum(w) AS p, sum(q) AS q FROM b GROUP BY user_id, bin)"""


@query(_BINS + ", g AS (SELECT user_id, CAST(i AS INTEGER) AS bin FROM r, range(7) s(i)) SELECT g.user_id, g.bin, round(coalesce(p, 0), 6) + 0.0 AS p, round(coalesce(q, 0), 6) + 0.0 AS q FROM g LEFT JOIN h ON h.user_id = g.user_id AND h.bin = g.bin")
def histograms_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(event_id, x, y, w) -> dict:
        b = stats.Binning.from_range(x, 7)
        return {"bin": np.arange(7, dtype=np.int32), "p": b.histogram(x, w), "q": b.histogram(x[y > 40], w[y > 40])}

    got = per_group(events(spark, sf_dir), "user_id", ["event_id"], "bin int, p double, q double", f)
    return got.select("user_id", "bin", rounded(F.col("p"), 6).alias("p"), rounded(F.col("q"), 6).alias("q"))


@query(_BINS + ", n AS (SELECT user_id, p / sum(p) OVER (PARTITION BY user_id) AS p, q / sum(q) OVER (PARTITION BY user_id) AS q FROM h), m AS (SELECT *, 0.5 * (p + q) AS m FROM n) SELECT user_id, round(0.5 * sum(CASE WHEN p = 0 THEN 0 ELSE p * ln(p / m) END) + 0.5 * sum(CASE WHEN q = 0 THEN 0 ELSE q * ln(q / m) END), 8) + 0.0 AS jsd, round(sum(CASE WHEN q = 0 THEN 0 ELSE q * ln(q / p) END), 8) + 0.0 AS kl FROM m WHERE q IS NOT NULL AND NOT isnan(q) GROUP BY user_id")
def divergence_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users none of whose events pass have no row."""

    def f(event_id, x, y, w) -> dict:
        if not (y > 40).any():
            return {"jsd": np.zeros(0), "kl": np.zeros(0)}
        b = stats.Binning.from_range(x, 7)
        p, q = b.histogram(x, w), b.histogram(x[y > 40], w[y > 40])
        return {"jsd": [stats.jsd(p, q)], "kl": [stats.kl(q / sums.psum(q), p / sums.psum(p))]}

    got = per_group(events(spark, sf_dir), "user_id", ["event_id"], "jsd double, kl double", f)
    return got.select("user_id", rounded(F.col("jsd"), 8).alias("jsd"), rounded(F.col("kl"), 8).alias("kl"))


_CUT_GROUP = f"""WITH {EV}, l AS (SELECT user_id, event_id, x AS score, CAST(y > 50 AS INTEGER) AS label, w, y AS m FROM e),
t AS (SELECT user_id, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS ts, sum(CASE WHEN label = 0 THEN w ELSE 0 END) AS tb FROM l GROUP BY user_id),
run AS (SELECT user_id, score, sum(w) OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS s FROM l WHERE label = 1),
c AS (SELECT run.user_id, max(score) AS threshold FROM run JOIN t ON t.user_id = run.user_id WHERE s >= 0.5 * ts AND ts > 0 AND tb > 0 GROUP BY run.user_id),
f AS (SELECT c.user_id, threshold, sum(CASE WHEN label = 1 AND score >= threshold THEN w ELSE 0 END) AS s, sum(CASE WHEN label = 0 AND score >= threshold THEN w ELSE 0 END) AS b, any_value(ts) AS ts, any_value(tb) AS tb FROM c JOIN l ON l.user_id = c.user_id JOIN t ON t.user_id = c.user_id GROUP BY c.user_id, threshold)"""


@query(
    _CUT_GROUP
    + """, bk AS (SELECT l.user_id, event_id, score AS x, m AS y, w, score >= threshold AS pass FROM l JOIN c ON c.user_id = l.user_id WHERE label = 0),
r AS (SELECT user_id, min(y) AS lo, max(y) AS hi FROM bk GROUP BY user_id),
h AS (SELECT bk.user_id, CASE WHEN hi <= lo THEN 0 ELSE least(greatest(floor((y - lo) / (hi - lo) * 5), 0), 4) END AS bin, sum(w) AS p, sum(CASE WHEN pass THEN w ELSE 0 END) AS q FROM bk JOIN r ON r.user_id = bk.user_id GROUP BY ALL),
n AS (SELECT user_id, p / sum(p) OVER (PARTITION BY user_id) AS p, q / nullif(sum(q) OVER (PARTITION BY user_id), 0) AS q FROM h),
j AS (SELECT user_id, 0.5 * sum(CASE WHEN p = 0 THEN 0 ELSE p * ln(p / (0.5 * (p + q))) END) + 0.5 * sum(CASE WHEN q = 0 THEN 0 ELSE q * ln(q / (0.5 * (p + q))) END) AS jsd FROM n WHERE q IS NOT NULL GROUP BY user_id),
v AS (SELECT *, w / sum(w) OVER (PARTITION BY user_id) AS v FROM bk),
p AS (SELECT a.user_id, a.event_id AS i, b.event_id AS j, a.v AS vi, b.v AS vj, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM v a JOIN v b ON a.user_id = b.user_id),
rx AS (SELECT user_id, i, sum(vj * dx) AS rx, sum(vj * dy) AS ry, any_value(vi) AS vi FROM p GROUP BY ALL),
mu AS (SELECT user_id, sum(vi * rx) AS mx, sum(vi * ry) AS my FROM rx GROUP BY user_id),
ab AS (SELECT p.user_id, p.vi, p.vj, dx - a.rx - b.rx + mx AS a, dy - a.ry - b.ry + my AS b FROM p JOIN rx a ON a.user_id = p.user_id AND a.i = p.i JOIN rx b ON b.user_id = p.user_id AND b.i = p.j JOIN mu ON mu.user_id = p.user_id),
d AS (SELECT user_id, sum(vi * vj * a * b) AS d, sum(vi * vj * a * a) AS vx, sum(vi * vj * b * b) AS vy FROM ab GROUP BY user_id)
SELECT f.user_id, threshold, round(s, 6) + 0.0 AS s, round(b, 6) + 0.0 AS b, round(s / ts, 8) + 0.0 AS sig_eff, round(b / tb, 8) + 0.0 AS bkg_eff, CASE WHEN b > 0 THEN round(sqrt(2 * greatest((s + b) * ln(1 + s / b) - s, 0)), 6) + 0.0 END AS z_asimov, round(jsd, 6) + 0.0 AS jsd, CASE WHEN vx * vy <= 0 OR sqrt(greatest(vx * vy, 0)) < 1e-12 THEN 0 ELSE round(d / sqrt(vx * vy), 6) + 0.0 END AS dcorr2
FROM f JOIN d ON d.user_id = f.user_id LEFT JOIN j ON j.user_id = f.user_id"""
)
def evaluated_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut, significance, divergence and distance correlation of each user's events, as
    a classifier is evaluated."""

    def f(event_id, x, y, w) -> dict:
        label = (y > 50).astype(np.int64)
        names = ("threshold", "s", "b", "sig_eff", "bkg_eff", "z_asimov", "jsd", "dcorr2_bkg")
        if label.all() or not label.any():
            return {n: np.zeros(0) for n in names}
        row = stats.evaluate(0.0, x, label, w, y, 5, 0.5).value()
        return {n: pa.array([row[n]], pa.float64()) for n in names}

    got = per_group(events(spark, sf_dir), "user_id", ["event_id"], "threshold double, s double, b double, sig_eff double, bkg_eff double, z_asimov double, jsd double, dcorr2_bkg double", f)
    digits = {"s": 6, "b": 6, "sig_eff": 8, "bkg_eff": 8, "z_asimov": 6, "jsd": 6}
    return got.select("user_id", "threshold", *[rounded(F.col(c), n).alias(c) for c, n in digits.items()], rounded(F.col("dcorr2_bkg"), 6).alias("dcorr2"))


# ------------------------------------------------------------ training, calibration


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.concat("l_returnflag", "l_linestatus").alias("kind"), "l_orderkey", "l_linenumber", "l_partkey", *_FEATURES, F.col("l_extendedprice").alias("t"))


_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


@query(lambda: ridge_sql("l_returnflag, l_linestatus") + " SELECT l_returnflag || l_linestatus AS kind, round(w0, 3) + 0.0 AS w0, round(w1, 3) + 0.0 AS w1, round(w2, 3) + 0.0 AS w2, round(bias, 3) + 0.0 AS bias, round(r2, 6) + 0.0 AS r2 FROM fit")
def ridge_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardizer, Gram matrix, Cholesky factor and calibration of each kind of line."""

    def f(l_quantity, l_discount, l_tax, t, **_) -> dict:
        c = training.ridge(np.stack([l_quantity, l_discount, l_tax], 1), t)
        return {**{f"w{k}": [float(c.coef[k])] for k in range(3)}, "bias": [c.bias], "r2": [c.r2]}

    got = per_group(_lineitem(spark, sf_dir), "kind", _KEY, "w0 double, w1 double, w2 double, bias double, r2 double", f)
    return got.select("kind", *[rounded(F.col(c), 3).alias(c) for c in ("w0", "w1", "w2", "bias")], rounded(F.col("r2"), 6).alias("r2"))


_W = [0.3, -0.2, 0.05]


@query("WITH z AS (SELECT l_returnflag || l_linestatus AS kind, l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"(({c} - avg({c}) OVER w) / (stddev_pop({c}) OVER w + 1e-8)) AS z{k}" for k, c in enumerate(("l_quantity", "l_discount", "l_tax"))) + f" FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus)) SELECT kind, l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-(0.1 + {' + '.join(f'({w}) * z{k}' for k, w in enumerate(_W))}))), 8) + 0.0 AS score FROM z")
def head_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A standardizer per kind of line, and a logistic head's scores."""

    def f(l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax, t) -> dict:
        x = np.stack([l_quantity, l_discount, l_tax], 1)
        head = training.Head(training.HeadKind.parse("logistic"), 3, np.array([0.1, *_W]))
        model = training.TaggerModel(head, training.Standardizer.fit(x), np.zeros(0))
        return {"l_orderkey": l_orderkey, "l_linenumber": l_linenumber, "l_partkey": l_partkey, "score": model.predict(x)}

    got = per_group(_lineitem(spark, sf_dir), "kind", _KEY, "l_orderkey long, l_linenumber int, l_partkey long, score double", f)
    return got.select("kind", *_KEY, rounded(F.col("score"), 8).alias("score"))


_STEPS = 60


@query(f"""WITH RECURSIVE a AS (SELECT 0 AS step, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v, 0.5::DOUBLE AS p
UNION ALL SELECT step + 1, b1, b2, m, v, p - 0.02 * (m / (1 - b1)) / (sqrt(v / (1 - b2)) + 1e-8) FROM (SELECT step, b1 * 0.9 AS b1, b2 * 0.999 AS b2, 0.9 * m + (1 - 0.9) * g AS m, 0.999 * v + (1 - 0.999) * g * g AS v, p FROM (SELECT *, cos(p * 3) + step / 50.0 AS g FROM a) WHERE step < {_STEPS}))
SELECT step, round(p, 9) + 0.0 AS p FROM a""")
def adam_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter under Adam, its gradient cos(3 p) + step / 50."""
    adam, p, out = training.Adam(0.02, 1), np.array([0.5]), [(0, 0.5)]
    for k in range(_STEPS):
        p = adam.step(p, np.cos(p * 3) + k / 50.0)
        out.append((k + 1, float(p[0])))
    return spark.createDataFrame(out, "step int, p double").select("step", rounded(F.col("p"), 9).alias("p"))


@query(f"WITH {X}, z AS (SELECT vec_id, " + ", ".join(f"sum(CASE WHEN pos < 8 THEN x * {(k + 1) / 10} * (CASE WHEN (pos + {k}) % 2 = 0 THEN 1 ELSE -1 END) END) + {k / 4} AS h{k}" for k in range(3)) + " FROM x GROUP BY vec_id) SELECT vec_id, round(-0.5 + 0.7 * tanh(h0) - 0.3 * tanh(h1) + 0.2 * tanh(h2), 8) + 0.0 AS logit, round((1 - pow(tanh(h1), 2)) * -0.3, 8) + 0.0 AS g_bias, round(tanh(h2), 8) + 0.0 AS g_out FROM z")
def hidden_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A head with three hidden units: logits, and two of the gradient's columns."""
    sign = np.array([[1.0 if (p + k) % 2 == 0 else -1.0 for p in range(8)] for k in range(3)])
    w1 = sign * np.array([[0.1], [0.2], [0.3]])
    head = training.Head(training.HeadKind.parse("mlp3"), 8, np.concatenate([w1.ravel(), [0.0, 0.25, 0.5], [0.7, -0.3, 0.2], [-0.5]]))

    def f(x: np.ndarray) -> list:
        x = x[:, :8].astype(np.float64)
        g = head.logit_grad(x)
        return [head.logit(x), g[:, 24 + 1].copy(), g[:, 24 + 3 + 2].copy()]

    m = signals._map(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, [("logit", "double"), ("g_bias", "double"), ("g_out", "double")], f, 512)
    return m.select("vec_id", *[rounded(F.col(c), 8).alias(c) for c in ("logit", "g_bias", "g_out")])


# -------------------------------------------------------------------- identity


@query("""SELECT event_id, '{"event_id":' || event_id || ',"props":"' || replace(props, '"', '\\"') || '","type":"' || event_type || '","value":' || regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') || '}' AS json FROM events""")
def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON: sorted keys, escapes, numbers as ECMAScript writes them."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")

    def f(event_id, event_type, value, props) -> dict:
        return {"event_id": event_id, "json": pa.array([provenance.canonical({"value": v, "type": t, "event_id": int(i), "props": p}) for i, t, v, p in zip(event_id, event_type, value.tolist(), props)])}

    return mapped(e, "event_id long, json string", f)


@query("SELECT count(*) AS n, count(DISTINCT embedding) AS vectors, count(DISTINCT embedding) AS identifiers, TRUE AS well_formed FROM embeddings")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal vectors have equal identifiers, others not; all are 28 hex digits."""
    got = signals.with_oids(read(spark, sf_dir, "embeddings").select("embedding"), "embedding")
    return got.agg(F.count("*").alias("n"), F.countDistinct("embedding").alias("vectors"), F.countDistinct("oid").alias("identifiers"), F.every(F.col("oid").rlike("^[0-9a-f]{28}$")).alias("well_formed"))



