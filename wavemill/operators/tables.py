"""Statistics, training and anomaly search on DataFrames.

Two modes: `exact` sums follow the ordered tree over a declared key, so they are the
same bits for any partitioning; plain aggregates let Catalyst choose and are equal
up to rounding.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import anomaly, stats, training
from ..functions.rng import STREAM_CHUNKS, Stream
from ..functions.sums import block_of, psum
from ..sources.scratch import cut
from .signals import list_array, matrix

# --------------------------------------------------------------- ordered sums


def ranged(df: DataFrame, order: list) -> DataFrame:
    """Rows sorted into ranges of a key, a range per partition (`wm_range`), written
    down: ranges are drawn from samples, so they must not be drawn twice."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("wm_range", F.spark_partition_id()))


def _ahead(parts: DataFrame, columns: list[str]) -> DataFrame:
    """(wm_range, a_<c>): totals of the ranges before each; parts has a row per range."""
    kinds = dict(parts.dtypes)
    rows, total = [], [0 if kinds[c] in ("bigint", "int") else 0.0 for c in columns]
    for r in sorted(parts.collect()):
        rows.append((r[0], *total))
        total = [t + (v or 0) for t, v in zip(total, r[1:])]
    return parts.sparkSession.createDataFrame(rows, ", ".join(["wm_range int", *(f"`a_{c}` {kinds[c]}" for c in columns)]))


def dense_index(df: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """Adds 0, 1, 2, ... in the order of a key: rows are sorted into ranges, each is
    numbered on its own and shifted by the rows ahead of it."""
    rows = ranged(df, order)
    place = F.row_number().over(Window.partitionBy("wm_range").orderBy(*order)) - 1
    shift = _ahead(rows.groupBy("wm_range").agg(F.count("*").alias("n")), ["n"])
    return rows.withColumn("wm_row", place).join(F.broadcast(shift), "wm_range").withColumn(out, F.col("wm_row") + F.col("a_n")).drop("wm_range", "wm_row", "a_n")


def running_sums(df: DataFrame, order: list, columns: list[str]) -> DataFrame:
    """Adds `run_<c>`: the sum of c over all rows up to each, in the order of a key, by
    ranges of the key: no task sees all rows."""
    rows = ranged(df, order)
    upto = Window.partitionBy("wm_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    shift = _ahead(rows.groupBy("wm_range").agg(*[F.sum(c).alias(c) for c in columns]), columns)
    rows = rows.withColumns({f"run_{c}": F.sum(c).over(upto) for c in columns}).join(F.broadcast(shift), "wm_range")
    return rows.withColumns({f"run_{c}": F.col(f"run_{c}") + F.col(f"a_{c}") for c in columns}).drop("wm_range", *[f"a_{c}" for c in columns])


def tree_sums(rows: DataFrame, n: int, k: int, f: Callable[[pa.RecordBatch], np.ndarray], depth: int = 6) -> np.ndarray:
    """k tree sums over n rows that `idx` numbers; f gives (rows, k) values of a batch.
    The nodes at `depth` are contiguous blocks of rows; each is summed by one task, the
    driver adds the 2^depth values by the rest of the tree."""
    if n == 0:
        return np.zeros(k)
    depth = min(depth, n.bit_length() - 1)
    names = [f"v{j}" for j in range(k)]
    fields = ", ".join(f"{c} double" for c in names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            v, idx = f(t), t.column("idx")
            yield pa.RecordBatch.from_arrays([pa.array(block_of(idx.to_numpy(), n, depth)), idx, *(pa.array(np.ascontiguousarray(v[:, j])) for j in range(k))], names=["wm_block", "idx", *names])

    def add(key: tuple, t: pa.Table) -> pa.Table:
        o = np.argsort(t.column("idx").to_numpy())
        return pa.table({"wm_block": pa.array([key[0].as_py()], pa.int64()), **{c: pa.array([float(psum(t.column(c).to_numpy()[o]))]) for c in names}})

    parts = sorted(rows.mapInArrow(blocks, f"wm_block long, idx long, {fields}").groupBy("wm_block").applyInArrow(add, f"wm_block long, {fields}").collect())
    return np.array([psum(np.array([r[1 + j] for r in parts])) for j in range(k)])


def psum_columns(df: DataFrame, order: list[str], columns: list[str], depth: int = 6) -> dict[str, float]:
    """Tree sums over all rows in the order of a key."""
    rows = cut(dense_index(df.select(*order, *columns), order).select("idx", *[F.col(c).cast("double").alias(c) for c in columns]))
    got = tree_sums(rows, rows.count(), len(columns), lambda t: np.stack([t.column(c).to_numpy() for c in columns], 1), depth)
    return dict(zip(columns, got.tolist()))


# -------------------------------------------------------- distance correlation


def dcorr2(df: DataFrame, x: str, y: str, w: str | None = None, *, keys: list[str], order: str, exact_up_to: int = stats.EXACT_UP_TO, chunk: int = stats.CHUNK) -> DataFrame:
    """(keys, n, dcorr2) of every group, its rows in the order of a key: exact up to
    10,000 rows, a group in a task. Above, as the estimator is defined, the mean over
    chunks of a permutation, which is drawn in tasks; each chunk is a task's work, so a
    group that holds most rows is split."""
    exact = lambda o, a, b, c: {"n": pa.array([len(a)]), "dcorr2": pa.array([stats.dcorr2_exact(a, b, c)])}
    large = cut(df.groupBy(*keys).agg(F.count("*").alias("wm_n")).where(F.col("wm_n") > exact_up_to))
    if large.isEmpty():
        return _by_group(df, x, y, w, keys, order, "n long, dcorr2 double", exact)
    same = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
    small = df.alias("a").join(large.alias("b"), same, "left_anti")
    hot = df.alias("a").join(large.alias("b"), same).select(*[F.col(f"a.`{k}`").alias(k) for k in keys], "wm_n", F.col(f"a.`{order}`").cast("long").alias("wm_o"), F.col(f"a.`{x}`").cast("double").alias("wm_x"), F.col(f"a.`{y}`").cast("double").alias("wm_y"), (F.col(f"a.`{w}`").cast("double") if w else F.lit(1.0)).alias("wm_w"))
    hot = hot.withColumn("wm_i", F.row_number().over(Window.partitionBy(*keys).orderBy("wm_o")) - 1)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hot.schema)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            i, words = t.column("wm_i").to_numpy().astype(np.uint64), Stream(0, STREAM_CHUNKS)
            v = words.words(2 * i) | words.words(2 * i + np.uint64(1)) << np.uint64(32)
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array((v >> np.uint64(1)).view(np.int64))], names=[*t.schema.names, "wm_draw"])

    place = F.row_number().over(Window.partitionBy(*keys).orderBy("wm_draw", "wm_i")) - 1
    hot = hot.mapInArrow(draw, f"{fields}, wm_draw long").withColumn("wm_place", place)
    hot = hot.withColumn("wm_chunk", F.floor(F.col("wm_place") / chunk).cast("long")).where(F.col("wm_chunk") < F.floor(F.col("wm_n") / chunk))
    parts = _by_group(hot.repartition(*keys, "wm_chunk"), "wm_x", "wm_y", "wm_w", [*keys, "wm_n", "wm_chunk"], "wm_place", "n long, dcorr2 double", exact)
    means = parts.groupBy(*keys, "wm_n").agg(F.avg("dcorr2").alias("dcorr2")).select(*keys, F.col("wm_n").alias("n"), "dcorr2")
    return _by_group(small, x, y, w, keys, order, "n long, dcorr2 double", exact).unionByName(means)


def dcorr2_grad(df: DataFrame, s: str, m: str, w: str | None = None, *, keys: list[str], order: str) -> DataFrame:
    """(keys, order, grad) of every row, within its group."""
    return _by_group(df, s, m, w, keys, order, "wm_order long, grad double", lambda o, a, b, c: {"wm_order": pa.array(o), "grad": pa.array(stats.dcorr2_grad(a, b, c)[1])}).withColumnRenamed("wm_order", order)


def _by_group(df, x, y, w, keys, order, schema, f) -> DataFrame:
    kinds = dict(df.dtypes)
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    rows = df.select(*keys, F.col(order).cast("long").alias("wm_o"), F.col(x).cast("double").alias("wm_x"), F.col(y).cast("double").alias("wm_y"), weight.alias("wm_w"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        o = np.argsort(t.column("wm_o").to_numpy(), kind="stable")
        cols = [t.column(c).to_numpy()[o] for c in ("wm_o", "wm_x", "wm_y", "wm_w")]
        out = f(*cols)
        n = len(next(iter(out.values())))
        return pa.table({**{k: pa.array([v.as_py()] * n, v.type) for k, v in zip(keys, key)}, **out})

    return rows.groupBy(*keys).applyInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), schema]))


def dcorr2_chunks(df: DataFrame, x: str, y: str, w: str | None = None, *, order: str, seed: int = 0, chunk: int = stats.CHUNK, permutation: str = "drawn") -> DataFrame:
    """(chunk, value): the exact statistic of each chunk of a permutation of all rows, a
    task each. As the estimator is defined, a last chunk that is not full is left out;
    fewer than 8 rows are one chunk.

    `drawn`: rows in order of random words of their number, by a range sort. `reference`:
    the shuffle of the estimator in `stats`, with its bits; it is sequential, so it
    is made on the driver and bounded by `REFERENCE_ROWS`."""
    if permutation not in ("drawn", "reference"):
        raise ValueError("permutation is drawn or reference")
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    rows = dense_index(df.select(order, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), weight.alias("w")), [order])
    n = rows.count()
    size = min(chunk, n // 2)
    if size < 4:
        placed, size, full = rows.withColumn("place", F.col("idx")), max(n, 1), 1
    else:
        full = n // size
        if permutation == "drawn":

            def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for t in batches:
                    i = t.column("idx").to_numpy().astype(np.uint64)
                    words = Stream(seed, STREAM_CHUNKS)
                    v = words.words(2 * i) | words.words(2 * i + np.uint64(1)) << np.uint64(32)
                    yield pa.RecordBatch.from_arrays([*(t.column(c) for c in ("idx", "x", "y", "w")), pa.array((v >> np.uint64(1)).view(np.int64))], names=["idx", "x", "y", "w", "draw"])

            placed = dense_index(rows.mapInArrow(draw, "idx long, x double, y double, w double, draw long"), ["draw", "idx"], "place")
        else:
            if n > REFERENCE_ROWS:
                raise ValueError(f"the reference permutation is made for {REFERENCE_ROWS} rows at most")
            place = np.empty(n, np.int64)
            place[Stream(seed, STREAM_CHUNKS).permutation(n)] = np.arange(n)
            shared = df.sparkSession.sparkContext.broadcast(place)

            def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for t in batches:
                    yield pa.RecordBatch.from_arrays([*(t.column(c) for c in ("x", "y", "w")), pa.array(shared.value[t.column("idx").to_numpy()])], names=["x", "y", "w", "place"])

            placed = rows.mapInArrow(look, "x double, y double, w double, place long")

    def one(key: tuple, t: pa.Table) -> pa.Table:
        o = np.argsort(t.column("place").to_numpy())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "value": pa.array([stats.dcorr2_exact(*(t.column(c).to_numpy()[o] for c in "xyw"))])})

    parts = placed.select((F.floor(F.col("place") / size)).cast("long").alias("chunk"), "place", "x", "y", "w").where(F.col("chunk") < full)
    return parts.groupBy("chunk").applyInArrow(one, "chunk long, value double")


#: Rows whose reference permutation the driver makes, at most: 8 bytes each.
REFERENCE_ROWS = 20_000_000


def dcorr2_chunked(df: DataFrame, x: str, y: str, w: str | None = None, *, order: str, seed: int = 0, chunk: int = stats.CHUNK, permutation: str = "drawn") -> float:
    """The mean of `dcorr2_chunks`, by the ordered sum."""
    got = sorted(dcorr2_chunks(df, x, y, w, order=order, seed=seed, chunk=chunk, permutation=permutation).collect())
    return float(psum(np.array([r.value for r in got])) / len(got)) if got else 0.0


# -------------------------------------------------------- plain aggregate forms


def proxy_gradient(df: DataFrame, s: str, m: str, w: str) -> DataFrame:
    """`df` with `grad`: the gradient of the squared weighted correlation. All moments
    are one aggregate, one row, that meets the rows."""
    x, y, v = F.col(s).cast("double"), F.col(m).cast("double"), F.col(w).cast("double")
    t = df.agg(F.sum(v).alias("wm_w"), F.sum(v * x).alias("wm_x"), F.sum(v * y).alias("wm_y"), F.sum(v * x * y).alias("wm_xy"), F.sum(v * x * x).alias("wm_xx"), F.sum(v * y * y).alias("wm_yy"))
    den, c = F.col("wm_w") + 1e-12, lambda a, b, ab: F.col(ab) / F.col("wm_den") - 2 * F.col(a) * F.col(b) + F.col(a) * F.col(b) * F.col("wm_w") / F.col("wm_den")
    t = t.withColumn("wm_den", den).withColumn("wm_mx", F.col("wm_x") / den).withColumn("wm_my", F.col("wm_y") / den)
    t = t.select("wm_den", "wm_mx", "wm_my", c("wm_mx", "wm_my", "wm_xy").alias("wm_cov"), (c("wm_mx", "wm_mx", "wm_xx") + 1e-12).alias("wm_vx"), (c("wm_my", "wm_my", "wm_yy") + 1e-12).alias("wm_vy"))
    sd = F.sqrt(F.col("wm_vx") * F.col("wm_vy"))
    r = F.col("wm_cov") / sd
    grad = 2 * r * (v / F.col("wm_den")) * ((y - F.col("wm_my")) / sd - r * (x - F.col("wm_mx")) / F.col("wm_vx"))
    return df.join(F.broadcast(t)).withColumn("grad", grad).drop("wm_den", "wm_mx", "wm_my", "wm_cov", "wm_vx", "wm_vy")


def bin_column(v: Column, lo: Column, hi: Column, n_bins: int) -> Column:
    t = (v - lo) / F.when(hi > lo, hi - lo) * n_bins
    return F.when(hi <= lo, F.lit(0)).otherwise(F.least(F.greatest(F.floor(t), F.lit(0)), F.lit(n_bins - 1))).cast("int")


def histograms(df: DataFrame, value: str, weights: dict[str, Column], n_bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(bin, one column for each of `weights`) of every bin, empty ones too, in one
    pass; the range is one small row."""
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")) if lo is None else df.sparkSession.createDataFrame([(lo, hi)], "lo double, hi double")
    b = df.join(F.broadcast(bounds)).select(bin_column(F.col(value), F.col("lo"), F.col("hi"), n_bins).alias("bin"), *[w.cast("double").alias(n) for n, w in weights.items()])
    sums = b.groupBy("bin").agg(*[F.sum(n).alias(n) for n in weights])
    return df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin")).join(sums, "bin", "left").select("bin", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in weights])


def histogram(df: DataFrame, value: str, weight: str, n_bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(bin, weight) of every bin."""
    return histograms(df, value, {"weight": F.col(weight)}, n_bins, lo, hi)


def jsd_of(both: DataFrame, p: str, q: str) -> DataFrame:
    """One row: jsd of two columns of a histogram; null where one is empty."""
    every = Window.partitionBy(F.lit(1))  # a row per bin
    j = both.select("bin", F.col(p).alias("p"), F.col(q).alias("q"))
    j = j.withColumn("p", F.col("p") / F.nullif(F.sum("p").over(every), F.lit(0.0))).withColumn("q", F.col("q") / F.nullif(F.sum("q").over(every), F.lit(0.0)))
    mid = 0.5 * (F.col("p") + F.col("q"))
    term = lambda a: F.when(a.isNull(), None).when(a == 0, 0.0).otherwise(a * F.ln(a / F.nullif(mid, F.lit(0.0))))
    return j.agg((0.5 * F.sum(term(F.col("p"))) + 0.5 * F.sum(term(F.col("q")))).alias("jsd"))


def cut_at(df: DataFrame, score: str, label: str, weight: str, order: str, targets: list[float]) -> DataFrame:
    """(target, threshold, s, b, sig_eff, bkg_eff). Weights are summed per score, then
    accumulated by ranges of the score."""
    per = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) == 1, F.col(weight)).otherwise(0.0)).alias("ws"), F.sum(F.when(F.col(label) != 1, F.col(weight)).otherwise(0.0)).alias("wb"), F.count_if(F.col(label) == 1).alias("ns"))
    run = running_sums(per, [F.col("score").desc()], ["ws", "wb"]).where("ns > 0").withColumnsRenamed({"run_ws": "s", "run_wb": "b"})
    total = df.agg(F.sum(F.when(F.col(label) == 1, F.col(weight)).otherwise(0.0)).alias("ts"), F.sum(F.when(F.col(label) != 1, F.col(weight)).otherwise(0.0)).alias("tb"))
    t = df.sparkSession.createDataFrame([(float(x),) for x in targets], "target double").join(total)
    met = run.join(F.broadcast(t), F.col("s") >= F.col("target") * F.col("ts"))
    best = met.groupBy("target").agg(F.max_by(F.struct("score", "s", "b", "ts", "tb"), "score").alias("c"))
    return best.select("target", F.col("c.score").alias("threshold"), F.col("c.s").alias("s"), F.col("c.b").alias("b"), (F.col("c.s") / F.col("c.ts")).alias("sig_eff"), (F.col("c.b") / F.col("c.tb")).alias("bkg_eff"))


def asimov(s: Column, b: Column) -> Column:
    return F.when((b > 0) & (s >= 0), F.sqrt(2.0 * F.greatest((s + b) * F.ln(1.0 + s / F.when(b > 0, b)) - s, F.lit(0.0))))


def verdict_of(frontier: DataFrame, star: float) -> DataFrame:
    """One row: delta_sigma, delta_jsd, result, by a join with lambda = 0."""
    base = frontier.where("lambda = 0").select(F.col("z_asimov").alias("z0"), F.col("jsd").alias("j0"))
    own = frontier.where(F.col("lambda") == star)
    d = own.join(F.broadcast(base)).select((F.col("z_asimov") - F.col("z0")).alias("delta_sigma"), (F.col("jsd") - F.col("j0")).alias("delta_jsd"))
    return d.withColumn("result", F.coalesce((F.col("delta_sigma") > 0) & (F.col("delta_jsd") <= 0), F.lit(False)))


# -------------------------------------------------------------------- training


def synthetic_dataset(spark: SparkSession, n: int, d: int, seed: int, split: int = 0) -> DataFrame:
    """(event_id, x, y, w, m): every task makes its own range of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            i = t.column(0).to_numpy()
            data = training.synthetic_rows(int(i[0]), len(i), d, seed, split)
            yield pa.RecordBatch.from_arrays([pa.array(i), list_array(data.x), pa.array(data.y.astype(np.int8)), pa.array(data.w), pa.array(data.m)], names=["event_id", "x", "y", "w", "m"])

    return spark.range(n).mapInArrow(run, "event_id long, x array<double>, y tinyint, w double, m double")


#: Rows of a training table, and clouds of one index, that the driver holds at most.
DRIVER_ROWS = 5_000_000


def _bounded(df: DataFrame, most: int = DRIVER_ROWS) -> DataFrame:
    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows; training and a single index are sequential and take {most} at most")
    return df


def dataset(df: DataFrame) -> training.Dataset:
    """A training table in event order, on the driver: minibatches are sequential. Its
    size is checked (`DRIVER_ROWS`)."""
    t = _bounded(df.select("event_id", "x", "y", "w", "m")).orderBy("event_id").toArrow()
    x = np.array(t.column("x").to_pylist(), np.float64)
    return training.Dataset(x.reshape(len(t), -1), t.column("y").to_numpy().astype(np.uint8), t.column("w").to_numpy(), t.column("m").to_numpy())


def train_tag(df: DataFrame, **config) -> training.TaggerModel:
    return training.train(dataset(df), training.TrainConfig(**config))


def predict(df: DataFrame, model: training.TaggerModel, *, id_col: str = "event_id") -> DataFrame:
    """`df` with `score`."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x = np.array(t.column("x").to_pylist(), np.float64)
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(np.atleast_1d(shared.value.predict(x)) if len(x) else np.zeros(0))], names=[*t.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, score double")


def bench_report(train_df: DataFrame, eval_df: DataFrame, lambdas: list[float], lambda_star: float, *, n_bins: int = 20, target: float = 0.5, **config) -> stats.Report:
    """A model per lambda, each trained and evaluated in a task of its own."""
    training.check_lambdas(lambdas, lambda_star)
    tr, ev = dataset(train_df), dataset(eval_df)
    spark = train_df.sparkSession
    cfg = training.TrainConfig(**config)
    shared = spark.sparkContext.broadcast((tr, ev))
    names = ["threshold", "s", "b", "sig_eff", "bkg_eff", "z_asimov", "jsd", "dcorr2_bkg"]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        from dataclasses import replace

        tr, ev = shared.value
        lam = key[0].as_py()
        model = training.train(tr, replace(cfg, lam=lam))
        row = stats.evaluate(lam, model.predict(ev.x), ev.y, ev.w, ev.m, n_bins, target)
        return pa.table({"lambda": pa.array([lam]), **{k: pa.array([row.value()[k]], pa.float64()) for k in names}, "oid": pa.array([model.oid])})

    grid = spark.createDataFrame([(float(x),) for x in lambdas], "lambda double").repartition(len(lambdas), "lambda")
    got = {r["lambda"]: r for r in grid.groupBy("lambda").applyInArrow(run, "lambda double, " + ", ".join(f"{k} double" for k in names) + ", oid string").collect()}
    rows = [stats.FrontierRow(float(x), *(got[x][k] for k in names)) for x in lambdas]
    inputs = {"eval_events": len(ev.y), "eval_oid": ev.oid(), "features": tr.x.shape[1], "model_oids": [got[x]["oid"] for x in lambdas], "train_events": len(tr.y), "train_oid": tr.oid()}
    return training.benchmark_report(lambdas, lambda_star, rows, cfg, inputs, n_bins, target)


def calibrate(df: DataFrame, features: str, target: str, *, order: list[str], strength: float = 1e-4) -> training.Calibration:
    """Ridge in closed form, all sums by the ordered tree in the order of a key: the bits
    of `training.ridge`, but rows stay where they are. Residuals are not gathered; see
    `residuals`."""
    # Six passes read what is numbered once.
    rows = cut(dense_index(df.select(*order, F.col(features).cast("array<double>").alias("wm_x"), F.col(target).cast("double").alias("wm_t")), order).select("idx", "wm_x", "wm_t"))
    n = rows.count()
    if not n:
        raise training.TrainError("no events")
    d = len(rows.first()["wm_x"])
    x_of = lambda t: matrix(t.column("wm_x"), d, np.float64)
    t_of = lambda t: t.column("wm_t").to_numpy()
    mu = tree_sums(rows, n, d, x_of) / n
    std = np.sqrt(tree_sums(rows, n, d, lambda t: (x_of(t) - mu) * (x_of(t) - mu)) / n) + 1e-8
    z_of = lambda t: (x_of(t) - mu) / std

    def products(t: pa.RecordBatch) -> np.ndarray:
        z, own = z_of(t), t_of(t)
        return np.concatenate([(z[:, :, None] * z[:, None, :]).reshape(len(z), d * d), z * own[:, None]], 1)

    got = tree_sums(rows, n, d * d + d, products)
    g = got[: d * d].reshape(d, d).copy()
    g[np.arange(d), np.arange(d)] += strength
    coef = training.cholesky_solve(training.cholesky(g), got[d * d :])
    t_sum, fit_sum = tree_sums(rows, n, 2, lambda t: np.stack([t_of(t), training.dot(z_of(t), coef)], 1))
    bias = float(t_sum / n - fit_sum / n)
    left = lambda t: t_of(t) - (training.dot(z_of(t), coef) + bias)
    spread = lambda t: t_of(t) - t_sum / n
    res, square, total = tree_sums(rows, n, 3, lambda t: np.stack([left(t), left(t) * left(t), spread(t) * spread(t)], 1))
    mean = res / n
    var = tree_sums(rows, n, 1, lambda t: ((left(t) - mean) ** 2)[:, None])[0] / n
    return training.Calibration(coef, bias, float(1.0 - square / (total + 1e-12)), float(np.sqrt(var)), None, mu, std)


def residuals(df: DataFrame, model: training.Calibration, features: str, target: str) -> DataFrame:
    """`df` with `residual`."""
    d = len(model.coef)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            fit = model.predict(matrix(t.column(len(t.schema) - 2), d, np.float64)) if len(t) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*t.columns[:-2], pa.array(t.columns[-1].to_numpy() - fit)], names=[*t.schema.names[:-2], "residual"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)
    return df.select("*", F.col(features).cast("array<double>").alias("wm_x"), F.col(target).cast("double").alias("wm_t")).mapInArrow(run, f"{fields}residual double")


def gram(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(i, j, g): sums of products of standardized columns, and with the target as
    j = -1; one aggregation over the rows."""
    mu = {c: F.avg(c).alias(f"mu_{c}") for c in columns}
    sd = {c: (F.stddev_pop(c) + 1e-8).alias(f"sd_{c}") for c in columns}
    z = df.join(F.broadcast(df.agg(*mu.values(), *sd.values())))
    z = z.select(*[((F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}")).alias(f"z{k}") for k, c in enumerate(columns)], F.col(target).cast("double").alias("t"))
    n = len(columns)
    sums = z.agg(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"g_{i}_{j}") for i in range(n) for j in range(n)], *[F.sum(F.col(f"z{i}") * F.col("t")).alias(f"g_{i}_m1") for i in range(n)])
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g_{i}_{j}").alias("g")) for i in range(n) for j in range(n)] + [F.struct(F.lit(i).alias("i"), F.lit(-1).alias("j"), F.col(f"g_{i}_m1").alias("g")) for i in range(n)]
    return sums.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


# -------------------------------------------------------------- anomaly search


def project_clouds(df: DataFrame, dirs: np.ndarray, *, id_col: str, cloud_col: str) -> DataFrame:
    """(id, projected): per direction the sorted projections, flat. Clouds are flat
    arrays of points with as many coordinates as the directions."""
    kind = dict(df.select(F.col(id_col).alias("i")).dtypes)["i"]
    dim = dirs.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out = [anomaly.project(anomaly.cloud(np.array(v, np.float64).reshape(-1, dim)), dirs).ravel() for v in t.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(out, pa.list_(pa.float64()))], names=[id_col, "projected"])

    return df.select(id_col, cloud_col).mapInArrow(run, f"`{id_col}` {kind}, projected array<double>")


#: Queries that are broadcast at most; more meet the rows in blocks.
BROADCAST_QUERIES = 2000
#: Rows and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 2000, 200


def _nearest_rows(ids: list[int], rows: list[np.ndarray], queries: list[tuple[int, np.ndarray]], k: int, n_dirs: int, best: dict[int, list[tuple[float, int]]]) -> None:
    """Merge the k nearest of some rows into `best`, for each query."""
    shaped = [r.reshape(n_dirs, -1) for r in rows]
    for width in {r.shape[1] for r in shaped}:
        own = [i for i, r in enumerate(shaped) if r.shape[1] == width]
        block = np.stack([shaped[i] for i in own])
        for name, p in queries:
            p = p.reshape(n_dirs, -1)
            d = psum(anomaly.w1_sorted(np.broadcast_to(p, (len(own), *p.shape)), block)) / n_dirs
            cand = best.get(name, []) + [(float(x), ids[i]) for x, i in zip(d, own) if ids[i] != name]
            best[name] = sorted(cand)[:k]


def _found(best: dict[int, list[tuple[float, int]]]) -> pa.RecordBatch:
    a, i, d = zip(*[(a, i, d) for a, near in best.items() for d, i in near]) if any(best.values()) else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], names=["query", "neighbour", "sw1"])


def sw1_top_k(projected: DataFrame, queries: DataFrame, k: int, n_dirs: int, *, id_col: str, broadcast: int = BROADCAST_QUERIES) -> DataFrame:
    """(query, neighbour, rank, sw1): exact nearest of all rows to each row of a stated
    query set. Up to `broadcast` queries go to all tasks; a larger set meets the rows in
    blocks. Every task keeps the k nearest that it sees, and these are merged."""
    rows = projected.select(F.col(id_col).cast("long").alias("id"), "projected")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), "projected")
    first = asked.limit(broadcast + 1).collect()
    schema = "query long, neighbour long, sw1 double"
    if len(first) <= broadcast:
        shared = projected.sparkSession.sparkContext.broadcast([(r[0], np.array(r[1])) for r in first])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple[float, int]]] = {}
            for t in batches:
                _nearest_rows(t.column(0).to_pylist(), [np.array(v) for v in t.column(1).to_pylist()], shared.value, k, n_dirs, best)
            yield _found(best)

        near = rows.mapInArrow(run, schema)
    else:

        def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
            n = max(1, -(-df.count() // size))
            return df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(f"{name}_block")).agg(F.collect_list(F.struct("id", "projected")).alias(name))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                for own, other in zip(t.column("rows").to_pylist(), t.column("asked").to_pylist()):
                    best: dict[int, list[tuple[float, int]]] = {}
                    _nearest_rows([r["id"] for r in own], [np.array(r["projected"]) for r in own], [(q["id"], np.array(q["projected"])) for q in other], k, n_dirs, best)
                    yield _found(best)

        both = blocks(rows, BLOCK_ROWS, "rows").crossJoin(blocks(asked, BLOCK_QUERIES, "asked"))
        near = both.repartition("rows_block", "asked_block").select("rows", "asked").mapInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("sw1", "neighbour"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "neighbour", "rank", "sw1")


def detect_flags(top: DataFrame, k: int, tau: float) -> DataFrame:
    """(query, kth_distance, flagged): undefined, and not flagged, below k."""
    d = top.groupBy("query").agg(F.max(F.when(F.col("rank") == k, F.col("sw1"))).alias("kth_distance"))
    return d.withColumn("flagged", F.coalesce(F.col("kth_distance") > tau, F.lit(False)))


class AnomalyIndex:
    """An index of reference clouds, built in order of their ids on the driver (its
    links depend on the order) and shared with tasks that answer queries."""

    def __init__(self, index: anomaly.AnomalyIndex, ids: list[int], dim: int):
        self.index, self.ids, self.dim = index, ids, dim

    @classmethod
    def fit(cls, clouds: DataFrame, dim: int, *, id_col: str, cloud_col: str, tau: float, **config) -> AnomalyIndex:
        rows = _bounded(clouds.select(id_col, cloud_col)).orderBy(id_col).collect()
        refs = [np.array(r[1], np.float64).reshape(-1, dim) for r in rows]
        return cls(anomaly.AnomalyIndex(refs, anomaly.AnomalyConfig(tau, **config)), [r[0] for r in rows], dim)

    def __len__(self) -> int:
        return len(self.index)

    def graph_bytes(self) -> bytes:
        return self.index.graph_bytes()

    @property
    def config_digest(self) -> str:
        return self.index.cfg.digest()

    def transform(self, clouds: DataFrame, *, id_col: str, cloud_col: str) -> DataFrame:
        """(id, kth_distance, nearest, flagged)."""
        shared = clouds.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            me = shared.value
            for t in batches:
                got = me.index.detect([np.array(v, np.float64).reshape(-1, me.dim) for v in t.column(1).to_pylist()])
                near = [[me.ids[i] for _, i in g.neighbours] for g in got]
                yield pa.RecordBatch.from_arrays([t.column(0), pa.array([g.kth_distance for g in got], pa.float64()), pa.array(near, pa.list_(pa.int64())), pa.array([g.flagged for g in got])], names=[id_col, "kth_distance", "nearest", "flagged"])

        return clouds.select(F.col(id_col).cast("long").alias(id_col), cloud_col).mapInArrow(run, f"`{id_col}` long, kth_distance double, nearest array<long>, flagged boolean")


#: Rows in one index of `indexed_knn`, about, and queries that go to it at a time.
SHARD, CHUNK = 1000, 64


def _near_sw1(a: np.ndarray, b: np.ndarray) -> float:
    """Of clouds of one size the mean gap, equal to `sw1` up to rounding: for finding
    the way in an index. Distances that are returned come from `sw1`."""
    return float(np.abs(a - b).sum()) / a.size if a.shape == b.shape else anomaly.sw1(a, b)


@dataclass(frozen=True)
class Shards:
    """Rows dealt by their ids to shards of bounded size, a graph of its own for each:
    `built` has (shard, built), the latter the pickled ids, projections and graph."""

    built: DataFrame
    cfg: anomaly.AnomalyConfig
    dirs: np.ndarray


def index_shards(clouds: DataFrame, dim: int, *, id_col: str, cloud_col: str, tau: float, shard: int = SHARD, **config) -> Shards:
    cfg = anomaly.AnomalyConfig(tau, **config)
    dirs = anomaly.directions(dim, cfg.directions, cfg.seed)
    rows = clouds.select(F.col(id_col).cast("long").alias("id"), F.col(cloud_col).cast("array<double>").alias("cloud"))
    n = max(1, -(-rows.count() // shard))

    def build(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids = t.column("id").to_pylist()
        refs = [anomaly.project(anomaly.cloud(np.array(v).reshape(-1, dim)), dirs) for v in t.column("cloud").to_pylist()]
        index = anomaly.Hnsw.build(len(refs), lambda i, j: _near_sw1(refs[i], refs[j]), anomaly.HnswConfig(cfg.m, cfg.ef_construction, cfg.ef_search, cfg.seed))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "built": pa.array([pickle.dumps((ids, refs, index))], pa.binary())})

    return Shards(rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("shard")).applyInArrow(build, "shard int, built binary"), cfg, dirs)


def layer0_edges(shards: Shards) -> DataFrame:
    """(shard, i, j, sw1): undirected edges of layer 0 of each shard's graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for k, built in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                ids, refs, index = pickle.loads(built)
                e = index.layer0_edges()
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(e), pa.int32()), pa.array([ids[i] for i, _ in e], pa.int64()), pa.array([ids[j] for _, j in e], pa.int64()), pa.array([anomaly.sw1(refs[i], refs[j]) for i, j in e], pa.float64())], names=["shard", "i", "j", "sw1"])

    return shards.built.mapInArrow(run, "shard int, i long, j long, sw1 double")


def shard_graphs(shards: Shards) -> DataFrame:
    """(shard, id, x, y, kth_distance, flagged): every row as a node of its shard's
    graph, laid out there and flagged by the distance to its k-th neighbour there."""
    cfg = shards.cfg

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for k, built in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                ids, refs, index = pickle.loads(built)
                kth: list[float | None] = []
                for i, p in enumerate(refs):
                    near = [e for e in index.knn(lambda j: _near_sw1(p, refs[j]), cfg.k + 1) if e[1] != i][: cfg.k]  # noqa: B023
                    kth.append(near[cfg.k - 1][0] if len(near) >= cfg.k else None)
                at = anomaly.spring_layout(len(ids), index.layer0_edges(), cfg.layout_iterations, cfg.seed)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(kth, pa.float64()), pa.array([d is not None and d > cfg.tau for d in kth])], names=["shard", "id", "x", "y", "kth_distance", "flagged"])

    return shards.built.mapInArrow(run, "shard int, id long, x double, y double, kth_distance double, flagged boolean")


def indexed_knn(clouds: DataFrame, queries: DataFrame, dim: int, *, id_col: str, cloud_col: str, tau: float, shard: int = SHARD, **config) -> DataFrame:
    """(id, kth_distance, nearest, distances, flagged): the k nearest of all rows but
    the query itself. Every shard's graph answers every query of the stated set; answers
    are merged per query."""
    shards = index_shards(clouds, dim, id_col=id_col, cloud_col=cloud_col, tau=tau, shard=shard, **config)
    cfg, dirs = shards.cfg, shards.dirs

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = ids = refs = index = None
        for t in batches:
            for k, built, asked in zip(*(t.column(c).to_pylist() for c in range(3))):
                if k != name:
                    name, (ids, refs, index) = k, pickle.loads(built)
                out = []
                for q in asked:
                    p = anomaly.project(anomaly.cloud(np.array(q["cloud"]).reshape(-1, dim)), dirs)
                    found = index.knn(lambda j: _near_sw1(p, refs[j]), cfg.k + 1)  # noqa: B023
                    out += [(q["id"], ids[i], anomaly.sw1(p, refs[i])) for _, i in found if ids[i] != q["id"]]
                q, i, d = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], names=["query", "neighbour", "sw1"])

    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(cloud_col).cast("array<double>").alias("cloud"))
    m = max(1, -(-asked.count() // CHUNK))
    asked = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(m)).alias("chunk")).agg(F.collect_list(F.struct("id", "cloud")).alias("asked"))
    both = shards.built.crossJoin(asked).repartition("shard", "chunk").select("shard", "built", "asked")
    near = both.mapInArrow(search, "query long, neighbour long, sw1 double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("sw1", "neighbour"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= cfg.k).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "sw1"))).alias("near"))
    kth = F.when(F.size("near") == cfg.k, F.col("near")[cfg.k - 1]["sw1"])
    near = near.select("query", kth.alias("kth_distance"), F.col("near.neighbour").alias("nearest"), F.col("near.sw1").alias("distances"))
    return near.select(F.col("query").alias(id_col), "kth_distance", "nearest", "distances", F.coalesce(F.col("kth_distance") > tau, F.lit(False)).alias("flagged"))
