"""Registered queries of the signal engine, and DuckDB SQL for those that SQL can
express. Each runs over its whole tables.

`embeddings` (64 floats) serve as signals, `events` as weighted observations of
(value, k) by user, `labels` with `documents` as labelled scores, `lineitem` as a
feature table.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import anomaly, kernels, provenance, rng, stats
from ..operators import signals, tables
from ..sources import store
from ..sources.scratch import scratch_dir
from . import conformance as suite
from . import definitions, scattering
from .registry import EV as _EV
from .registry import Q, SQL, X as _X
from .registry import events, query, read, rounded, values
from .scattering import ScatterConfig, Scattering

ONE_D = ScatterConfig.one_d(64, 3, 1, "circular", carrier_cutoff=0)
TWO_D = ScatterConfig.two_d(8, 8, 2, 4, "circular")
SO2 = ScatterConfig.two_d(8, 8, 2, 4, "circular", group="so2_relative")


# ------------------------------------------------------------- scattering paths


PATHS_CFG = ScatterConfig.one_d(256, 4, 4, "circular")

#: The banks of quality 4 and 1 at J = 4: a geometric sequence, then linear steps.
_PATHS = """
WITH q AS (SELECT 4 AS q, 1 AS ord UNION ALL SELECT 1, 2),
top AS (SELECT q, ord, greatest(1 / (1 + pow(2.0, 3.0 / q)), 0.35) AS xi, pow(2.0, 1.0 / q) AS ratio, 0.1 / 16 AS least FROM q),
geo AS (SELECT q, ord, i, xi / pow(ratio, i) AS xi, xi * ((1 - 1 / ratio) / (1 + 1 / ratio)) / sqrt(2 * ln(1 / sqrt(0.5))) / pow(ratio, i) AS sigma, least, ratio FROM top, range(60) r(i)),
kept AS (SELECT * FROM geo WHERE i = 0 OR sigma * ratio > least * ratio),
bank AS (SELECT ord, i, xi, sigma FROM kept
  UNION ALL SELECT k.ord, k.i + j, k.xi - j * k.xi / k.q, k.least FROM kept k, range(1, 4) r(j) WHERE j < k.q AND k.i = (SELECT max(i) FROM kept m WHERE m.ord = k.ord)),
oct AS (SELECT ord, CAST(i AS INTEGER) AS n, CAST(floor(-log2(least(xi + 5 * sigma, 0.5))) AS INTEGER) - 1 AS j FROM bank)
SELECT CAST(row_number() OVER (ORDER BY a.n, b.n) - 1 AS BIGINT) AS pair, a.n AS n1, b.n AS n2, a.j AS j1, b.j AS j2
FROM oct a JOIN oct b ON b.j > a.j WHERE a.ord = 1 AND b.ord = 2
"""


@query(_PATHS)
def paths_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = signals.scatter_paths(spark, PATHS_CFG).where("ord = 2")
    first = paths.agg(F.min("path_id").alias("m"))
    return paths.join(F.broadcast(first)).select((F.col("path_id") - F.col("m")).cast("long").alias("pair"), F.col("n")[0].alias("n1"), F.col("n")[1].alias("n2"), F.col("j")[0].alias("j1"), F.col("j")[1].alias("j2"))


@query("SELECT CAST(j AS INTEGER) AS j, CAST(l AS INTEGER) AS l, CAST(1 + j * l + l * l * (j * (j - 1) // 2) AS BIGINT) AS trivial, CAST(1 + j + l * (j * (j - 1) // 2) AS BIGINT) AS pooled FROM range(1, 5) a(j), (VALUES (2), (4), (8)) b(l)")
def path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted from the filters by joins, not by the formula."""
    grid = spark.range(1, 5).select(F.col("id").cast("int").alias("j")).join(spark.createDataFrame([(2,), (4,), (8,)], "l int"))
    octaves = grid.select("j", "l", F.explode(F.expr("sequence(0, j - 1)")).alias("o"))
    f = octaves.select("j", "l", "o", F.explode(F.expr("sequence(0, l - 1)")).alias("t"))
    one = f.groupBy("j", "l").agg(F.count("*").alias("n1"))
    g = f.select("j", "l", F.col("o").alias("o2"), F.col("t").alias("t2"))
    two = f.join(g, ["j", "l"]).where("o2 > o").groupBy("j", "l").agg(F.count("*").alias("n2"), F.countDistinct("o", "o2", F.expr("pmod(t2 - t, l)")).alias("d2"))
    return one.join(two, ["j", "l"], "left").select("j", "l", (1 + F.col("n1") + F.coalesce("n2", F.lit(0))).alias("trivial"), (1 + F.col("j") + F.coalesce("d2", F.lit(0))).cast("long").alias("pooled"))


# --------------------------------------------------------------------- kernels

_DFT = f"WITH {_X}, d AS (SELECT vec_id, k, sum(x * cos(-2 * pi() / 64 * ((pos * k) % 64))) AS re, sum(x * sin(-2 * pi() / 64 * ((pos * k) % 64))) AS im FROM x, (SELECT CAST(unnest(range(9)) AS INTEGER) AS k) GROUP BY vec_id, k)"
_POWER = _DFT + " SELECT k, count(*) AS n, round(avg(re * re + im * im), 4) + 0.0 AS power FROM d GROUP BY k"


@query(_POWER)
def dft_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = signals.dft(read(spark, sf_dir, "embeddings"), 64, 9, id_col="vec_id", signal_col="embedding")
    return d.groupBy("k").agg(F.count("*").alias("n"), rounded(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 4).alias("power"))


@query(_POWER)
def fft_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The FFT kernel against the transform's definition."""

    def f(x: np.ndarray) -> list:
        re, im = kernels.fft(np.ascontiguousarray(x.T), np.zeros_like(x.T, order="C"))
        return [(re.astype(np.float64) ** 2 + im.astype(np.float64) ** 2).T[:, :9]]

    p = signals._map(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, [("p", "array<double>")], f, 512)
    return p.select(F.posexplode("p").alias("k", "p")).groupBy("k").agg(F.count("*").alias("n"), rounded(F.avg("p"), 4).alias("power"))


@query(f"WITH {_X}, f AS (SELECT vec_id, pos, CAST(x AS FLOAT) AS x FROM x) SELECT a.vec_id, CAST(a.pos // 2 AS INTEGER) AS i, CAST(CAST(sqrt(a.x * a.x + b.x * b.x) AS FLOAT) AS DOUBLE) AS modulus FROM f a JOIN f b ON a.vec_id = b.vec_id AND b.pos = a.pos + 1 WHERE a.pos % 2 = 0")
def modulus_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in pairs as complex values; binary32 on both sides, bit for bit."""
    f = lambda x: [kernels.modulus(np.ascontiguousarray(x[:, 0::2]), np.ascontiguousarray(x[:, 1::2]))]
    m = signals._map(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, [("m", "array<float>")], f, 512)
    return m.select("vec_id", F.posexplode("m").alias("i", "m")).select("vec_id", "i", F.col("m").cast("double").alias("modulus"))


@functools.lru_cache(maxsize=1)
def _gauss_weights() -> list[tuple[int, float]]:
    return [(k, math.exp(-((k - 32) ** 2) / 200.0)) for k in range(64)]


@query(lambda: f"WITH {_X} SELECT label, h.pos, round(avg(x.x * h.w), 6) + 0.0 AS filtered FROM x JOIN {values(_gauss_weights())} h(pos, w) ON x.pos = h.pos GROUP BY label, h.pos")
def filter_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = spark.createDataFrame(_gauss_weights(), "pos int, w double")
    x = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return x.join(F.broadcast(h), "pos").groupBy("label", "pos").agg(rounded(F.avg(F.col("x") * F.col("w")), 6).alias("filtered"))


@query(f"WITH {_X} SELECT vec_id, CAST(pos // 8 AS INTEGER) AS a, CAST(x AS FLOAT) AS v FROM x WHERE pos % 8 = 0")
def subsample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return x.where("pos % 8 = 0").select("vec_id", F.expr("int(pos div 8)").alias("a"), "v")


# ------------------------------------------------------------------ scattering


def _scatter_sql() -> str:
    return definitions.scatter_1d(64, 3)


def _scattered(spark: SparkSession, sf_dir: str, cfg: ScatterConfig = ONE_D) -> DataFrame:
    """(vec_id, label, coeffs): labels go along, so nothing is joined to itself."""
    return signals.scatter(read(spark, sf_dir, "embeddings"), cfg, id_col="vec_id", signal_col="embedding", keep=("label",))


def _long(spark: SparkSession, sf_dir: str, cfg: ScatterConfig = ONE_D) -> DataFrame:
    return signals.coeffs_long(_scattered(spark, sf_dir, cfg), cfg, id_col="vec_id", keep=("label",))


def _orders_sql(order: int) -> str:
    ids = [k for k, p in enumerate(Scattering.compile(ONE_D).paths) if p.order == order]
    return _scatter_sql() + f"SELECT label, CAST(path_id AS INTEGER) AS path_id, pos, round(avg(v), 4) + 0.0 AS v FROM s WHERE path_id BETWEEN {ids[0]} AND {ids[-1]} GROUP BY label, path_id, pos"


def _order(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    ids = [k for k, p in enumerate(Scattering.compile(ONE_D).paths) if p.order == order]
    return _long(spark, sf_dir).where(F.col("path_id").between(ids[0], ids[-1])).groupBy("label", "path_id", "pos").agg(rounded(F.avg(F.col("value").cast("double")), 4).alias("v"))


@query(lambda: _orders_sql(0))
def scatter_order0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order(spark, sf_dir, 0)


@query(lambda: _orders_sql(1))
def scatter_order1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order(spark, sf_dir, 1)


@query(lambda: _orders_sql(2))
def scatter_order2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order(spark, sf_dir, 2)


@query(lambda: _scatter_sql() + "SELECT label, CAST(path_id AS INTEGER) AS path_id, round(avg(f), 4) + 0.0 AS fp FROM (SELECT vec_id, label, path_id, avg(ln(pow(2.0, -20) + abs(v))) AS f FROM s GROUP BY ALL) GROUP BY label, path_id")
def scatter_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log-mean fingerprint of each label."""
    fp = signals.fingerprint(_scattered(spark, sf_dir), ONE_D, id_col="vec_id", keep=("label",))
    return fp.select("label", F.posexplode("fp").alias("path_id", "f")).groupBy("label", "path_id").agg(rounded(F.avg("f"), 4).alias("fp"))


def _ratio_sql() -> str:
    return _scatter_sql() + "SELECT a.label, a.path_id, round(avg(CASE WHEN b.v = 0 THEN 0 ELSE a.v / b.v END), 4) + 0.0 AS r2 FROM s a JOIN p2 ON a.path_id = p2.path_id JOIN s b ON b.vec_id = a.vec_id AND b.path_id = p2.f1 + 1 AND b.pos = a.pos GROUP BY a.label, a.path_id"


@query(_ratio_sql)
def scatter_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [k for k, _ in Scattering.compile(ONE_D).ratio_pairs]
    n = ONE_D.out_len
    r = signals.r2(_scattered(spark, sf_dir), ONE_D, id_col="vec_id", keep=("label",))
    long = r.select("label", F.posexplode("r2").alias("at", "v")).withColumn("path_id", F.element_at(F.array(*map(F.lit, pairs)), F.expr(f"int(at div {n}) + 1")))
    return long.groupBy("label", "path_id").agg(rounded(F.avg(F.col("v").cast("double")), 4).alias("r2"))


@query(lambda: _scatter_sql() + ", m AS (SELECT vec_id, label, path_id, avg(v) AS a, stddev_pop(v) AS d FROM s GROUP BY ALL) SELECT label, CAST(path_id AS INTEGER) AS path_id, round(avg(a), 4) + 0.0 AS mean, round(avg(d), 4) + 0.0 AS std FROM m GROUP BY label, path_id")
def scatter_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = signals.reduced(_scattered(spark, sf_dir), ONE_D, ["mean", "std"], id_col="vec_id", keep=("label",))
    return both.select("label", F.posexplode(F.arrays_zip("mean", "std")).alias("path_id", "v")).groupBy("label", "path_id").agg(rounded(F.avg("v.mean"), 4).alias("mean"), rounded(F.avg("v.std"), 4).alias("std"))


@query(lambda: _scatter_sql() + "SELECT label, pos, CAST(path_id AS INTEGER) AS path_id, round(avg(ln(pow(2.0, -20) + abs(v))), 4) + 0.0 AS f FROM s GROUP BY label, pos, path_id")
def scatter_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = len(Scattering.compile(ONE_D).paths)
    c = signals.fingerprint_clouds(_scattered(spark, sf_dir), ONE_D, id_col="vec_id", keep=("label",))
    return c.select("label", F.posexplode("cloud").alias("at", "f")).groupBy("label", F.expr(f"int(at div {p})").alias("pos"), F.expr(f"int(at % {p})").alias("path_id")).agg(rounded(F.avg("f"), 4).alias("f"))


_MEANS = "SELECT label, path_id, pos, round(avg(v), 3) + 0.0 AS v FROM {} GROUP BY label, path_id, pos"


def _means(long: DataFrame) -> DataFrame:
    return long.groupBy("label", "path_id", "pos").agg(rounded(F.avg(F.col("value").cast("double")), 3).alias("v"))


@query(lambda: definitions.scatter_2d(8, 2, 4) + _MEANS.format("s"))
def scatter_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 images: mean coefficients of each label."""
    return _means(_long(spark, sf_dir, TWO_D))


@query(lambda: definitions.scatter_2d(8, 2, 4) + definitions.pooled_2d(2, 4) + _MEANS.format("t"))
def scatter_2d_so2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(_long(spark, sf_dir, SO2))


@query(lambda: _scatter_sql() + ", r AS (SELECT a.vec_id, a.label, a.path_id, avg(CASE WHEN b.v = 0 THEN 0 ELSE a.v / b.v END) AS f FROM s a JOIN p2 ON a.path_id = p2.path_id JOIN s b ON b.vec_id = a.vec_id AND b.path_id = p2.f1 + 1 AND b.pos = a.pos GROUP BY ALL) SELECT label, CAST(path_id - (SELECT min(path_id) FROM p2) AS INTEGER) AS feature, round(avg(f), 4) + 0.0 AS f FROM r GROUP BY label, path_id")
def scatter_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = signals.features_from_r2(_scattered(spark, sf_dir), ONE_D, id_col="vec_id", keep=("label",))
    return x.select("label", F.posexplode("x").alias("feature", "f")).groupBy("label", "feature").agg(rounded(F.avg("f"), 4).alias("f"))


@query(f"WITH {_X} SELECT vec_id, CAST(pos // 32 AS INTEGER) AS j, CAST(pos % 8 AS INTEGER) AS pos, CAST(avg(x) AS FLOAT) AS pooled FROM x GROUP BY ALL")
def so2_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as (octave 2, orientation 4, position 8)."""
    x = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "x"))
    return signals.so2_pool(x.select("vec_id", F.expr("int(at div 32)").alias("j"), F.expr("int(at % 8)").alias("pos"), "x"), ["vec_id", "j", "pos"], "x")


_LOG = f"WITH {_X}, m AS (SELECT vec_id, CAST(pos // 8 AS INTEGER) AS path_id, avg(ln(pow(2.0, -20) + abs(x))) AS fp, avg(x) AS mean, stddev_pop(x) AS std FROM x GROUP BY ALL) "


@query(_LOG + "SELECT vec_id, path_id, round(fp, 6) + 0.0 AS fp FROM m")
def log_mean_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as coefficients of 8 paths."""
    f = lambda x: [scattering.log_mean(x.reshape(len(x), 8, 8))]
    m = signals._map(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, [("fp", "array<double>")], f, 512)
    return m.select("vec_id", F.posexplode("fp").alias("path_id", "fp")).select("vec_id", "path_id", rounded(F.col("fp"), 6).alias("fp"))


@query(_LOG + "SELECT vec_id, path_id, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std FROM m")
def path_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda x: [scattering.path_mean(x.reshape(len(x), 8, 8)), scattering.path_std(x.reshape(len(x), 8, 8))]
    m = signals._map(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, [("mean", "array<double>"), ("std", "array<double>")], f, 512)
    return m.select("vec_id", F.posexplode(F.arrays_zip("mean", "std")).alias("path_id", "v")).select("vec_id", "path_id", rounded(F.col("v.mean"), 6).alias("mean"), rounded(F.col("v.std"), 6).alias("std"))


@query(f"WITH {_X} SELECT label, CAST(pos // 8 AS INTEGER) AS point, count(*) AS n, round(sqrt(sum(x * x)), 4) + 0.0 AS norm FROM x GROUP BY label, CAST(pos // 8 AS INTEGER)")
def cloud_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as clouds of 8 points in 8 dimensions."""
    x = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    d = F.col("x").cast("double")
    return x.groupBy("label", F.expr("int(at div 8)").alias("point")).agg(F.count("*").alias("n"), rounded(F.sqrt(F.sum(d * d)), 4).alias("norm"))


def _filter_sql() -> str:
    return f"WITH {definitions.bank_1d(64, 3)}, a AS (SELECT h.k, sum(CASE WHEN h.f < 0 THEN h.h * h.h ELSE 0.5 * (h.h * h.h + m.h * m.h) END) AS a FROM hat h JOIN hat m ON m.f = h.f AND m.k = (64 - h.k) % 64 GROUP BY h.k) SELECT round(min(a), 6) + 0.0 AS least, round(max(a), 6) + 0.0 AS greatest FROM a"


@query(_filter_sql)
def littlewood_paley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the first-order bank by a join of each bin with its mirror."""
    h = signals.filters(spark, ONE_D).where("bank in ('phi', 'psi1')").select("bank", "idx", F.posexplode("fourier").alias("k", "v")).withColumn("v", F.col("v").cast("double"))
    m = h.select("bank", "idx", ((64 - F.col("k")) % 64).alias("k"), F.col("v").alias("mirror"))
    part = F.when(F.col("bank") == "phi", F.col("v") * F.col("v")).otherwise(0.5 * (F.col("v") * F.col("v") + F.col("mirror") * F.col("mirror")))
    return h.join(m, ["bank", "idx", "k"]).groupBy("k").agg(F.sum(part).alias("a")).agg(rounded(F.min("a"), 6).alias("least"), rounded(F.max("a"), 6).alias("greatest"))


@query("WITH m AS (SELECT l_returnflag AS flag, l_linestatus AS status, date_trunc('month', l_shipdate) AS mon, sum(l_extendedprice * l_discount) AS s2, sum(l_extendedprice) AS s1 FROM lineitem GROUP BY ALL) SELECT flag, status, strftime(mon, '%Y-%m') AS month, round(CAST(CASE WHEN s1 = 0 THEN 0 ELSE s2 / s1 END AS DOUBLE), 6) + 0.0 AS ratio FROM m")
def r2_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_extendedprice", "l_discount")
    q = li.groupBy("flag", "status", "month").agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("s2"), F.sum("l_extendedprice").alias("s1"))
    return q.select("flag", "status", "month", rounded(F.when(F.col("s1") == 0, 0.0).otherwise(F.col("s2") / F.when(F.col("s1") != 0, F.col("s1"))), 6).alias("ratio"))


# ------------------------------------------------------------------ statistics


@query("WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) + 1e-8 AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) + 1e-8 AS sp FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - mq) / sq, 4) + 0.0 AS zq, round((l_extendedprice - mp) / sp, 4) + 0.0 AS zp FROM lineitem, s")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    s = li.agg(F.avg("l_quantity").alias("mq"), (F.stddev_pop("l_quantity") + 1e-8).alias("sq"), F.avg("l_extendedprice").alias("mp"), (F.stddev_pop("l_extendedprice") + 1e-8).alias("sp"))
    z = li.join(F.broadcast(s))
    return z.select("l_orderkey", "l_linenumber", "l_partkey", rounded((F.col("l_quantity") - F.col("mq")) / F.col("sq"), 4).alias("zq"), rounded((F.col("l_extendedprice") - F.col("mp")) / F.col("sp"), 4).alias("zp"))


_HIST = f"WITH {_EV}, r AS (SELECT min(x) AS lo, max(x) AS hi FROM e), b AS (SELECT CAST(least(greatest(floor((x - lo) / (hi - lo) * 20), 0), 19) AS INTEGER) AS bin, x, w FROM e, r)"


@query(_HIST + ", g AS (SELECT CAST(unnest(range(20)) AS INTEGER) AS bin) SELECT g.bin, round(coalesce(sum(w), 0), 4) + 0.0 AS weight FROM g LEFT JOIN b ON b.bin = g.bin GROUP BY g.bin")
def hist_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.histogram(events(spark, sf_dir), "x", "w", 20).select("bin", rounded(F.col("weight"), 4).alias("weight"))


@query(_HIST + ", p AS (SELECT bin, sum(w) AS p, sum(CASE WHEN x > 250 THEN w ELSE 0 END) AS q FROM b GROUP BY bin), n AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM p) SELECT round(0.5 * sum(CASE WHEN p = 0 THEN 0 ELSE p * ln(p / (0.5 * (p + q))) END) + 0.5 * sum(CASE WHEN q = 0 THEN 0 ELSE q * ln(q / (0.5 * (p + q))) END), 6) + 0.0 AS jsd FROM n")
def jsd_pre_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass for the range, one for both histograms."""
    both = tables.histograms(events(spark, sf_dir), "x", {"pre": F.col("w"), "post": F.when(F.col("x") > 250, F.col("w")).otherwise(0.0)}, 20)
    return tables.jsd_of(both, "pre", "post").select(rounded(F.col("jsd"), 6).alias("jsd"))


_SC = "sc AS (SELECT l.doc_id, l.quality AS y, CAST(d.n_chars AS DOUBLE) AS score, 1.0 + l.toxic AS w FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
TARGETS = [0.3, 0.5, 0.8]
_CUT = f"""WITH {_SC}, p AS (SELECT score, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS ws, sum(CASE WHEN y <> 1 THEN w ELSE 0 END) AS wb, count(*) FILTER (y = 1) AS ns FROM sc GROUP BY score),
run AS (SELECT score, ns, sum(ws) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS s, sum(wb) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS b, sum(ws) OVER () AS ts, sum(wb) OVER () AS tb FROM p),
c AS (SELECT t AS target, max(score) AS threshold FROM run, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE)) g(t) WHERE ns > 0 AND s >= t * ts GROUP BY t),
f AS (SELECT target, threshold, s, b, s / ts AS sig_eff, b / tb AS bkg_eff FROM c JOIN run ON run.score = c.threshold)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return read(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), "score", (1.0 + F.col("toxic")).alias("w"))


@query(_CUT + " SELECT target, threshold, s + 0.0 AS s, b + 0.0 AS b, round(sig_eff, 6) + 0.0 AS sig_eff, round(bkg_eff, 6) + 0.0 AS bkg_eff FROM f")
def cut_sig_eff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.cut_at(_scores(spark, sf_dir), "score", "y", "w", "doc_id", TARGETS)
    return c.select("target", "threshold", "s", "b", rounded(F.col("sig_eff"), 6).alias("sig_eff"), rounded(F.col("bkg_eff"), 6).alias("bkg_eff"))


_Z = "sqrt(2 * greatest((s + b) * ln(1 + s / b) - s, 0))"


@query(_CUT + f" SELECT target, CASE WHEN b > 0 THEN round({_Z}, 5) + 0.0 END AS z_asimov FROM f")
def asimov_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.cut_at(_scores(spark, sf_dir), "score", "y", "w", "doc_id", TARGETS)
    return c.select("target", rounded(tables.asimov(F.col("s"), F.col("b")), 5).alias("z_asimov"))


@query(_CUT + f", z AS (SELECT target, CASE WHEN b > 0 THEN {_Z} END AS z, bkg_eff AS j FROM f) SELECT round(a.z - o.z, 5) + 0.0 AS delta_sigma, round(a.j - o.j, 5) + 0.0 AS delta_jsd, coalesce(a.z - o.z > 0 AND a.j - o.j <= 0, FALSE) AS result FROM z a, z o WHERE a.target = 0.8 AND o.target = 0.3")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets as lambdas (0.3 as 0), background efficiency in place of the JSD."""
    c = tables.cut_at(_scores(spark, sf_dir), "score", "y", "w", "doc_id", TARGETS)
    f = c.select(F.when(F.col("target") == 0.3, 0.0).otherwise(F.col("target")).alias("lambda"), tables.asimov(F.col("s"), F.col("b")).alias("z_asimov"), F.col("bkg_eff").alias("jsd"))
    return tables.verdict_of(f, 0.8).select(rounded(F.col("delta_sigma"), 5).alias("delta_sigma"), rounded(F.col("delta_jsd"), 5).alias("delta_jsd"), "result")


def _dcorr_sql(w: str, tail: str) -> str:
    return f"""WITH {_EV}, v AS (SELECT user_id, event_id, x, y, {w} / sum({w}) OVER (PARTITION BY user_id) AS v FROM e),
p AS (SELECT a.user_id, a.event_id AS i, b.event_id AS j, a.v AS vi, b.v AS vj, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, sign(a.x - b.x) AS sx FROM v a JOIN v b ON a.user_id = b.user_id),
rx AS (SELECT user_id, i, sum(vj * dx) AS rx, sum(vj * dy) AS ry, any_value(vi) AS vi FROM p GROUP BY ALL),
mu AS (SELECT user_id, sum(vi * rx) AS mx, sum(vi * ry) AS my FROM rx GROUP BY user_id),
ab AS (SELECT p.user_id, p.i, p.j, p.vi, p.vj, p.sx, dx - a.rx - b.rx + mx AS a, dy - a.ry - b.ry + my AS b FROM p JOIN rx a ON a.user_id = p.user_id AND a.i = p.i JOIN rx b ON b.user_id = p.user_id AND b.i = p.j JOIN mu ON mu.user_id = p.user_id),
m AS (SELECT user_id, count(DISTINCT i) AS n, sum(vi * vj * a * b) AS d, sum(vi * vj * a * a) AS vx, sum(vi * vj * b * b) AS vy FROM ab GROUP BY user_id) {tail}"""


_VALUE = "SELECT user_id, n, CASE WHEN n < 2 OR vx * vy <= 0 OR sqrt(greatest(vx * vy, 0)) < 1e-12 THEN 0 ELSE round(d / sqrt(vx * vy), 6) + 0.0 END AS dcorr2 FROM m"


@query(_dcorr_sql("1.0", _VALUE))
def dcorr2_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.dcorr2(events(spark, sf_dir), "x", "y", keys=["user_id"], order="event_id")
    return d.select("user_id", "n", rounded(F.col("dcorr2"), 6).alias("dcorr2"))


@query(_dcorr_sql("w", _VALUE))
def dcorr2_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.dcorr2(events(spark, sf_dir), "x", "y", "w", keys=["user_id"], order="event_id")
    return d.select("user_id", "n", rounded(F.col("dcorr2"), 6).alias("dcorr2"))


@query(_dcorr_sql("w", "SELECT ab.user_id, i AS event_id, CASE WHEN any_value(vx * vy) <= 0 OR sqrt(greatest(any_value(vx * vy), 0)) < 1e-12 THEN 0 ELSE round(2 * any_value(vi) / sqrt(any_value(vx * vy)) * sum(vj * sx * (b - d / vx * a)), 6) + 0.0 END AS grad FROM ab JOIN m ON m.user_id = ab.user_id GROUP BY ab.user_id, i"))
def dcorr_grad(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.dcorr2_grad(events(spark, sf_dir), "x", "y", "w", keys=["user_id"], order="event_id")
    return g.select("user_id", "event_id", rounded(F.col("grad"), 6).alias("grad"))


CHUNK = 256


def _chunked_sql() -> str:
    """Events in order of their draws, cut into chunks; the last, partial one is left
    out, as the estimator has it."""
    d = _dcorr_sql("w", "SELECT user_id, n, CASE WHEN vx * vy <= 0 OR sqrt(greatest(vx * vy, 0)) < 1e-12 THEN 0 ELSE d / sqrt(vx * vy) END AS d FROM m").replace("FROM e)", "FROM g)", 1)
    head = f"""WITH {_EV}, {definitions.words("q", 0, 0x20001, 200_000)}, o AS (SELECT e.*, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM e),
pl AS (SELECT o.*, row_number() OVER (ORDER BY q64.v // 2::UHUGEINT, idx) - 1 AS place, count(*) OVER () AS n FROM o JOIN q64 ON q64.i = o.idx),
g AS (SELECT place // {CHUNK} AS user_id, event_id, x, y, w FROM pl WHERE place < n // {CHUNK} * {CHUNK}), """
    return head + d.removeprefix(f"WITH {_EV}, ").replace("SELECT user_id, n, CASE", "SELECT count(*) AS chunks, round(avg(d), 6) + 0.0 AS dcorr2 FROM (SELECT user_id, n, CASE") + ")"


@query(_chunked_sql)
def dcorr2_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimator over all events, their order by draws made in tasks."""
    e = events(spark, sf_dir)
    return tables.dcorr2_chunks(e, "x", "y", "w", order="event_id", chunk=CHUNK).agg(F.count("*").alias("chunks"), rounded(F.avg("value"), 6).alias("dcorr2"))


@query(f"WITH {_EV}, v AS (SELECT event_id, x, y, w / (sum(w) OVER () + 1e-12) AS v FROM e), c AS (SELECT event_id, v, x - sum(v * x) OVER () AS dx, y - sum(v * y) OVER () AS dy FROM v), s AS (SELECT sum(dx * dy * v) AS cov, sum(dx * dx * v) + 1e-12 AS vx, sum(dy * dy * v) + 1e-12 AS vy FROM c) SELECT event_id, round(1e6 * 2 * (cov / sqrt(vx * vy)) * v * (dy / sqrt(vx * vy) - cov / sqrt(vx * vy) * dx / vx), 4) + 0.0 AS grad FROM c, s")
def pearson_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient in millionths; one row of aggregates meets the rows."""
    return tables.proxy_gradient(events(spark, sf_dir), "x", "y", "w").select("event_id", rounded(1e6 * F.col("grad"), 4).alias("grad"))


@query(f"WITH {_EV} SELECT round(sum(x), 2) + 0.0 AS sx, round(sum(x * w), 2) + 0.0 AS sxw, count(*) AS n FROM e")
def psum_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered tree sums over all events."""
    e = events(spark, sf_dir).withColumn("xw", F.col("x") * F.col("w")).withColumn("one", F.lit(1.0))
    s = tables.psum_columns(e, ["event_id"], ["x", "xw", "one"])
    return spark.createDataFrame([(round(s["x"], 2), round(s["xw"], 2), int(s["one"]))], "sx double, sxw double, n long")


# --------------------------------------------------------- training, calibration

_FEATURES = ["l_quantity", "l_discount", "l_tax"]
_ZS = "WITH s AS (SELECT " + ", ".join(f"avg({c}) AS m{k}, stddev_pop({c}) + 1e-8 AS s{k}" for k, c in enumerate(_FEATURES)) + " FROM lineitem), z AS (SELECT " + ", ".join(f"({c} - m{k}) / s{k} AS z{k}" for k, c in enumerate(_FEATURES)) + ", l_extendedprice AS t FROM lineitem, s)"


@query(_ZS + " " + " UNION ALL ".join([f"SELECT {i} AS i, {j} AS j, round(sum(z{i} * z{j}) / count(*), 6) + 0.0 AS g FROM z" for i in range(3) for j in range(3)] + [f"SELECT {i} AS i, -1 AS j, round(sum(z{i} * t) / count(*), 3) + 0.0 AS g FROM z" for i in range(3)]))
def ridge_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    g = tables.gram(li, _FEATURES, "l_extendedprice").join(F.broadcast(li.agg(F.count("*").alias("n"))))
    q = F.col("g") / F.col("n")
    return g.select("i", "j", F.when(F.col("j") >= 0, rounded(q, 6)).otherwise(rounded(q, 3)).alias("g"))


@query("WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) + 1e-8 AS d, avg(l_extendedprice) AS t, count(*) AS n FROM lineitem), c AS (SELECT sum((l_quantity - m) / d * l_extendedprice) / (sum(pow((l_quantity - m) / d, 2)) + 1e-4) AS coef, any_value(t) - 0 AS t, sum((l_quantity - m) / d) / any_value(n) AS zm FROM lineitem, s) SELECT round(coef, 2) + 0.0 AS coef, round(t - coef * zm, 2) + 0.0 AS bias FROM c")
def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature, by ordered sums; SQL has its closed form."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.array(F.col("l_quantity")).alias("x"))
    c = tables.calibrate(li, "x", "l_extendedprice", order=["l_orderkey", "l_linenumber", "l_partkey"])
    return spark.createDataFrame([(round(float(c.coef[0]), 2), round(c.bias, 2))], "coef double, bias double")


@functools.lru_cache(maxsize=1)
def _weights() -> list[tuple[int, float]]:
    return [(k, math.cos(k) / 4) for k in range(64)]


@query(lambda: f"WITH {_X}, z AS (SELECT vec_id, 0.1 + sum(x * w) AS z FROM x JOIN {values(_weights())} t(k, w) ON k = pos GROUP BY vec_id) SELECT vec_id, round(CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END, 6) + 0.0 AS score FROM z")
def sigmoid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic head as array expressions, without Python."""
    w = F.array(*[F.lit(v) for _, v in _weights()])
    dot = F.aggregate(F.zip_with("embedding", w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    z = 0.1 + dot
    return read(spark, sf_dir, "embeddings").select("vec_id", z.alias("z")).select("vec_id", rounded(F.when(F.col("z") >= 0, 1 / (1 + F.exp(-F.col("z")))).otherwise(F.exp("z") / (1 + F.exp("z"))), 6).alias("score"))


#: Published differences of two benchmark cases, to six digits.
PUBLISHED = [("logistic/lambdas0_1_4/star1", "-6.666948", "-0.038645"), ("mlp16/lambdas0_0.5_2/star0.5", "0.020611", "0.008354")]


@query("SELECT * FROM " + values(PUBLISHED) + " t(name, delta_sigma, delta_jsd), (SELECT FALSE AS result)")
def bench_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both published cases: samples made in tasks, a model per lambda in a task each,
    evaluated and compared. Size is part of a case, so it does not grow."""
    out = []
    for name, _, _ in PUBLISHED:
        head, lambdas, star = name.split("/")
        grid, best = [float(x) for x in lambdas.removeprefix("lambdas").split("_")], float(star.removeprefix("star"))
        own = suite.stream_of(f"tier2/report/{name}/n1200")
        tr, ev = (tables.synthetic_dataset(spark, 1200, 4, suite.SEED, own + k) for k in (0, 1))
        v = stats.verdict(tables.bench_report(tr, ev, grid, best, head=head, epochs=5, batch_size=128, lr=0.02, seed=own).rows, best)
        out.append((name, stats.fixed6(v.delta_sigma), stats.fixed6(v.delta_jsd), v.result))
    return spark.createDataFrame(out, "name string, delta_sigma string, delta_jsd string, result boolean")


@query()
def train_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a decorrelated classifier on the synthetic sample."""
    tr, ev = tables.synthetic_dataset(spark, 1200, 4, 1, 0), tables.synthetic_dataset(spark, 1200, 4, 1, 1)
    model = tables.train_tag(tr, epochs=5, batch_size=128, lr=0.02, lam=1.0, seed=1)
    return tables.predict(ev, model).select("event_id", "y", "score")


def solve3(a: list[list[str]], c: list[str]) -> list[str]:
    """Cramer's rule as SQL expressions."""
    det = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    return [f"{det([[c[i] if j == k else a[i][j] for j in range(3)] for i in range(3)])} / {det(a)}" for k in range(3)]


def ridge_sql(by: str = "") -> str:
    """fit(by, w0, w1, w2, bias, r2) of three standardized features, by the normal
    equations; one row for each value of `by`."""
    on = f"PARTITION BY {by}" if by else ""
    key, lead = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    g = [[f"g{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    gram = ", ".join(f"sum(z{i} * z{j}) + {'1e-4' if i == j else '0'} AS g{i}{j}" for i in range(3) for j in range(i, 3))
    sums = ", ".join(f"sum(z{i} * t) AS c{i}, sum(z{i}) AS s{i}" for i in range(3))
    w = solve3(g, ["c0", "c1", "c2"])
    join = f"JOIN w ON {' AND '.join(f'w.{c.strip()} = z.{c.strip()}' for c in by.split(','))}" if by else ", w"
    z = ", ".join(f"({c} - avg({c}) OVER ({on})) / (stddev_pop({c}) OVER ({on}) + 1e-8) AS z{k}" for k, c in enumerate(_FEATURES))
    zkey = ", ".join(f"z.{c.strip()}" for c in by.split(",")) + ", " if by else ""
    return f"""WITH z AS (SELECT {key}{z}, l_extendedprice AS t, avg(l_extendedprice) OVER ({on}) AS mt FROM lineitem),
n AS (SELECT {key}count(*) AS n, any_value(mt) AS mt, {gram}, {sums} FROM z {lead}),
w AS (SELECT {key}n, mt, w0, w1, w2, mt - (w0 * s0 + w1 * s1 + w2 * s2) / n AS bias FROM (SELECT *, {w[0]} AS w0, {w[1]} AS w1, {w[2]} AS w2 FROM n)),
fit AS (SELECT {zkey}any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, any_value(bias) AS bias, 1 - sum(pow(t - (w0 * z0 + w1 * z1 + w2 * z2 + bias), 2)) / (sum(pow(t - z.mt, 2)) + 1e-12) AS r2 FROM z {join} {"GROUP BY " + zkey.rstrip(", ") if by else ""})"""


@query(lambda: ridge_sql() + " SELECT round(w0, 2) + 0.0 AS w0, round(w1, 2) + 0.0 AS w1, round(w2, 2) + 0.0 AS w2, round(bias, 2) + 0.0 AS bias, round(r2, 6) + 0.0 AS r2 FROM fit")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three features, by ordered tree sums; SQL has the normal equations."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.array(*_FEATURES).alias("x"))
    c = tables.calibrate(li, "x", "l_extendedprice", order=["l_orderkey", "l_linenumber", "l_partkey"])
    return spark.createDataFrame([(*[round(float(w), 2) for w in c.coef], round(c.bias, 2), round(c.r2, 6))], "w0 double, w1 double, w2 double, bias double, r2 double")


# -------------------------------------------------------------- anomaly search


_W1 = f"""WITH {_X}, f AS (SELECT label, x FROM x WHERE pos = 0), n AS (SELECT label, count(*) AS n FROM f GROUP BY label),
p AS (SELECT a.label AS la, b.label AS lb, a.n AS na, b.n AS nb FROM n a JOIN n b ON a.label < b.label),
z AS (SELECT la, lb, na, nb, x, 0 AS side FROM p JOIN f ON f.label = la UNION ALL SELECT la, lb, na, nb, x, 1 FROM p JOIN f ON f.label = lb),
m AS (SELECT la, lb, na, nb, x, lead(x) OVER w AS nx, sum(1 - side) OVER w AS i, sum(side) OVER w AS j FROM z WINDOW w AS (PARTITION BY la, lb ORDER BY x, side ROWS UNBOUNDED PRECEDING))
SELECT la, lb, round(sum(abs(i / na - j / nb) * (nx - x)), 6) + 0.0 AS w1 FROM m WHERE nx IS NOT NULL GROUP BY la, lb"""


@query(_W1)
def w1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wasserstein-1 of the first coordinate between any two labels, by a window
    over the merged samples."""
    f = read(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"))
    n = f.groupBy("label").agg(F.count("*").alias("n"))
    p = n.select(F.col("label").alias("la"), F.col("n").alias("na")).join(n.select(F.col("label").alias("lb"), F.col("n").alias("nb")), F.col("la") < F.col("lb"))
    side = lambda c, v: p.join(f, F.col(c) == F.col("label")).select("la", "lb", "na", "nb", "x", F.lit(v).alias("side"))
    w = Window.partitionBy("la", "lb").orderBy("x", "side")
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    m = side("la", 0).unionByName(side("lb", 1)).select("la", "lb", "na", "nb", "x", F.lead("x").over(w).alias("nx"), F.sum(1 - F.col("side")).over(rows).alias("i"), F.sum("side").over(rows).alias("j"))
    return m.where("nx is not null").groupBy("la", "lb").agg(rounded(F.sum(F.abs(F.col("i") / F.col("na") - F.col("j") / F.col("nb")) * (F.col("nx") - F.col("x"))), 6).alias("w1"))


N_DIRS = 8


@functools.lru_cache(maxsize=1)
def _dirs() -> np.ndarray:
    return anomaly.directions(8, N_DIRS, 0)


def _topk_sql(tail: str) -> str:
    return f"""WITH {_X}, {definitions.directions("d", 8, N_DIRS)},
p AS (SELECT vec_id, k, pos // 8 AS point, sum(x * w) AS v FROM x JOIN d ON d.c = pos % 8 GROUP BY ALL),
o AS (SELECT vec_id, k, v, row_number() OVER (PARTITION BY vec_id, k ORDER BY v) AS r FROM p),
s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, avg(abs(a.v - b.v)) AS sw1 FROM o a JOIN o b ON a.k = b.k AND a.r = b.r AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
t AS (SELECT query, neighbour, sw1, row_number() OVER (PARTITION BY query ORDER BY sw1, neighbour) AS rank FROM s QUALIFY rank <= 10) {tail}"""


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.project_clouds(read(spark, sf_dir, "embeddings"), _dirs(), id_col="vec_id", cloud_col="embedding")
    return tables.sw1_top_k(p, p.where("vec_id % 100 = 0"), 10, N_DIRS, id_col="vec_id")


@query(lambda: _topk_sql("SELECT query, neighbour, CAST(rank AS INTEGER) AS rank, round(sw1, 6) + 0.0 AS sw1 FROM t"))
def sw1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest clouds: the query set is every row whose id is divisible by
    100, held against all rows."""
    return _top(spark, sf_dir).select("query", "neighbour", "rank", rounded(F.col("sw1"), 6).alias("sw1"))


@query(lambda: _topk_sql("SELECT query, round(max(sw1) FILTER (rank = 10), 6) + 0.0 AS kth_distance, coalesce(max(sw1) FILTER (rank = 10) > 0.62, false) AS flagged FROM t GROUP BY query"))
def detect_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.detect_flags(_top(spark, sf_dir), 10, 0.62).select("query", rounded(F.col("kth_distance"), 6).alias("kth_distance"), "flagged")


@query(lambda: _topk_sql("SELECT DISTINCT least(query, neighbour) AS i, greatest(query, neighbour) AS j FROM t"))
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges of the exact neighbour lists of the query set."""
    return _top(spark, sf_dir).select(F.least("query", "neighbour").alias("i"), F.greatest("query", "neighbour").alias("j")).distinct()


def _index(spark: SparkSession, sf_dir: str) -> tables.Shards:
    """Every row, in graphs of bounded size."""
    return tables.index_shards(read(spark, sf_dir, "embeddings"), 8, id_col="vec_id", cloud_col="embedding", tau=0.5, k=5, directions=N_DIRS, shard=250)


@query()
def layer0_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges of layer 0 of each shard's graph, over all rows, with their
    distances."""
    return tables.layer0_edges(_index(spark, sf_dir))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is divisible by 100, against all others."""
    e = read(spark, sf_dir, "embeddings")
    return tables.indexed_knn(e, e.where("vec_id % 100 = 0"), 8, id_col="vec_id", cloud_col="embedding", tau=0.5, k=10, directions=N_DIRS)


@query()
def hnsw_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).drop("distances")


@query("SELECT count(*) AS queries, count(*) * least(10, (SELECT count(*) FROM embeddings) - 1) AS neighbours, TRUE AS recalled, TRUE AS exact FROM embeddings WHERE vec_id % 100 = 0")
def hnsw_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against the exact lists (which SQL has): does it find at least nine
    tenths of them, at the same distances."""
    found = _nearest(spark, sf_dir).select(F.col("vec_id").alias("query"), F.explode(F.arrays_zip("nearest", "distances")).alias("n")).select("query", F.col("n.nearest").alias("neighbour"), F.col("n.distances").alias("d"))
    both = _top(spark, sf_dir).where("rank <= 10").join(found, ["query", "neighbour"], "left")
    got = both.agg(F.count("d").alias("hits"), F.count("*").alias("all"), F.max(F.abs(F.col("d") - F.col("sw1"))).alias("off")).join(found.agg(F.countDistinct("query").alias("queries"), F.count("*").alias("neighbours")))
    return got.select("queries", "neighbours", (F.col("hits") >= 0.9 * F.col("all")).alias("recalled"), (F.col("off") < 1e-12).alias("exact"))


@query()
def anomaly_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for every row, flagged and laid out within its shard's graph."""
    return tables.shard_graphs(_index(spark, sf_dir))


# ------------------------------------------------------ random streams, identity


def _stream_words(spark: SparkSession, n: int, seed: int, stream: int) -> DataFrame:
    def run(batches):
        for t in batches:
            i = t.column(0).to_numpy()
            w = rng.Stream(seed, stream).words(i.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(w.astype(np.int64))], names=["i", "word"])

    return spark.range(n).mapInArrow(run, "i long, word long")


def _philox_sql(tail: str) -> str:
    return f"WITH {definitions.words('w', 1, 7, 4096)} {tail}"


@query(lambda: _philox_sql("SELECT i, word FROM w"))
def philox_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of one stream, each from its index alone."""
    return _stream_words(spark, 4096, 1, 7)


@query(lambda: _philox_sql("SELECT i, (word >> 8) / 16777216.0::DOUBLE AS u FROM w"))
def unit_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _stream_words(spark, 4096, 1, 7)
    return w.select("i", (F.shiftrightunsigned("word", 8) * F.lit(2.0**-24)).alias("u"))


@query(lambda: f"WITH {definitions.words('w', 1, 7, 4 * 4096)}, {definitions.normals('n', 'w')} SELECT i, round(z, 9) + 0.0 AS z FROM n")
def normal_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for t in batches:
            i = t.column(0).to_numpy()
            z = rng.Stream(1, 7, 4 * int(i[0])).next_normal(len(i))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(z)], names=["i", "z"])

    return spark.range(4096).mapInArrow(run, "i long, z double").select("i", rounded(F.col("z"), 9).alias("z"))


@query()
def oid_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.with_oids(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", "oid")


@query()
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest hash of each event's scattering run."""
    e = signals.with_oids(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", out="input_oid")
    s = signals.scatter(e, ONE_D, id_col="vec_id", signal_col="embedding", with_oid=True, keep=("input_oid",)).select("vec_id", "input_oid", F.col("oid").alias("output_oid"))

    def run(batches):
        plan = Scattering.compile(ONE_D)
        for t in batches:
            h = [provenance.scattering_manifest(plan, 1, a, b).manifest_hash() for a, b in zip(t.column(1).to_pylist(), t.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(h, pa.string())], names=["vec_id", "input_oid", "output_oid", "manifest_hash"])

    return s.mapInArrow(run, "vec_id long, input_oid string, output_oid string, manifest_hash string")


@query("SELECT 'float32' AS dtype, 64 AS elements, CAST(256 AS INTEGER) AS n_bytes, count(DISTINCT embedding) AS tensors, TRUE AS ok FROM embeddings")
def tensor_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding written to a tensor table under its identifier, read again
    and verified; the table is removed again."""
    s = store.TensorStore(spark, f"{scratch_dir(spark)}/tensors-{uuid.uuid4().hex}")
    s.put_column(read(spark, sf_dir, "embeddings"), "embedding", "float32")
    got = s.verified().groupBy("dtype", F.col("shape")[0].alias("elements"), F.length("bytes").alias("n_bytes")).agg(F.count("*").alias("tensors"), F.every("ok").alias("ok")).collect()
    s.drop()
    return spark.createDataFrame(got, "dtype string, elements int, n_bytes int, tensors long, ok boolean")


@query(lambda: _scatter_sql() + "SELECT path_id, pos, count(*) AS n, round(avg(v), 4) + 0.0 AS v FROM s GROUP BY path_id, pos")
def stream_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scattering of a file stream, run until all files are read."""
    from ..streaming.scatter import scatter_stream

    e = read(spark, sf_dir, "embeddings")
    name = f"wavemill_{uuid.uuid4().hex}"
    got = scatter_stream(spark, f"{sf_dir}/embeddings.parquet", e.schema, ONE_D, id_col="vec_id", signal_col="embedding", name=name)
    long = signals.coeffs_long(got, ONE_D, id_col="vec_id")
    return long.groupBy("path_id", "pos").agg(F.count("*").alias("n"), rounded(F.avg(F.col("value").cast("double")), 4).alias("v"))


#: Cases of each family, as the suite states them.
FAMILIES = [("fft1d", 192), ("fft2d", 12), ("modulus", 9), ("mul_real_filter", 21), ("scatter", 169), ("sweep", 13), ("tier2", 18)]


@query("SELECT family, CAST(cases AS BIGINT) AS cases, CAST(cases AS BIGINT) AS passed FROM " + values(FAMILIES) + " t(family, cases)")
def conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cases against the recorded digests, a task for each group of cases."""
    got = suite.check(spark)
    return got.groupBy(F.split("name", "/")[0].alias("family")).agg(F.sum("cases").alias("cases"), F.sum(F.when(F.col("passed"), F.col("cases")).otherwise(0)).alias("passed"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import kernel_queries  # noqa: F401  (registers its own)

    return dict(Q)


def oracle_sql() -> dict[str, str]:
    from . import kernel_queries  # noqa: F401

    return dict(SQL)
