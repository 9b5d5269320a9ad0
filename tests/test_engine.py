"""The signal engine: fixed values, definitions, invariants, DataFrame forms."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.functions import anomaly, detmath, kernels, provenance, rng, stats, sums, sweeps, training
from wavemill.operators import signals, tables
from wavemill.plans import scattering as S
from wavemill.plans.scattering import ConfigError, ScatterConfig, Scattering
from wavemill.sources.store import TensorStore

# ------------------------------------------------------------------- numerics


@pytest.mark.parametrize("name", sorted(sweeps.HASHES))
def test_sweeps(name):
    assert sweeps.sweep_hash(name) == sweeps.HASHES[name]


def test_known_answers():
    """Published answers of both generators."""
    hexes = lambda *a: [int(x, 16) for x in a]
    for ctr, key, out in (
        (["00000000"] * 4, ["00000000"] * 2, ["6627e8d5", "e169c58d", "bc57ac4c", "9b00dbd8"]),
        (["ffffffff"] * 4, ["ffffffff"] * 2, ["408f276d", "41c83b0e", "a20bc7c6", "6d5451fd"]),
        (["243f6a88", "85a308d3", "13198a2e", "03707344"], ["a4093822", "299f31d0"], ["d16cfe09", "94fdcceb", "5001e420", "24126ea1"]),
    ):
        got = rng.philox(tuple(hexes(*key)), *[np.array([c], np.uint64) for c in hexes(*ctr)])
        assert [int(x[0]) for x in got] == hexes(*out)
    assert [f"{v:016x}" for v in rng.splitmix64(0, 0, 3).tolist()] == ["e220a8397b1dcdaf", "6e789e6aa1b965f4", "06c45d188009454f"]


def test_streams_are_functions_of_the_index():
    s = rng.Stream(5, 9)
    w = s.next_u32(1000)
    assert s.position == 1000 and (rng.Stream(5, 9).words(np.arange(123, 900)) == w[123:900]).all()
    assert rng.Stream(5, 9).word_at(77) == w[77]
    p = rng.Stream(1, 2).permutation(500)
    assert sorted(p.tolist()) == list(range(500))
    one = rng.Stream(1, 2)
    slow = list(range(500))
    for i in range(499, 0, -1):
        j = one.below(i + 1)
        slow[i], slow[j] = slow[j], slow[i]
    assert p.tolist() == slow


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e12, 1e12), max_size=300))
def test_tree_sum(x):
    assert sums.psum(np.array(x)) == sums.psum_recursive(x)


def test_blocks_are_nodes_of_the_tree():
    for n in (1, 5, 64, 1000):
        x = np.random.default_rng(n).normal(size=n)
        depth = min(3, n.bit_length() - 1)
        b = sums.block_of(np.arange(n), n, depth)
        assert sums.psum(np.array([sums.psum(x[b == k]) for k in range(1 << depth)])) == sums.psum(x)


def test_total_order():
    x = np.array([3.0, -0.0, 0.0, -5.0, np.inf, -np.inf, 3.0])
    assert sums.argsort(x).tolist() == [5, 3, 1, 2, 0, 6, 4]
    assert sums.argsort_desc(x).tolist() == [4, 0, 6, 2, 1, 3, 5]


def test_flush_rules():
    tiny = np.float32(2.0**-126)
    x = np.array([tiny, tiny / 2, -tiny / 4, 0.0, -0.0, 1.0], np.float32)
    y = kernels.ftz(x)
    assert (y == [tiny, 0, 0, 0, 0, 1]).all() and np.signbit(y).tolist() == [False, False, True, False, True, False]
    a = np.float32(1 - 2.0**-24)
    # exact product below 2^-126, rounded product not
    assert kernels.mul(np.array([a], np.float32), np.array([tiny], np.float32))[0] == 0


@pytest.mark.parametrize("m", range(1, 7))
@pytest.mark.parametrize("scale", [1, 1e-20, 1e-36])
def test_fft_is_its_definition(m, scale):
    g = np.random.default_rng(m)
    re, im = ((g.normal(size=1 << m) * scale).astype(np.float32) for _ in range(2))
    want = kernels.fft_recursive(re, im)
    for flush in (False, True):
        got = kernels.fft(re[:, None], im[:, None], always_flush=flush)
        assert all((a[:, 0].view(np.uint32) == b.view(np.uint32)).all() for a, b in zip(got, want))


def test_fft_inverts_and_is_accurate():
    g = np.random.default_rng(0)
    x = g.normal(size=(64, 32, 3)).astype(np.float32)
    re, im = kernels.fft2(x, np.zeros_like(x))
    want = np.fft.fft2(x.astype(np.float64), axes=(0, 1))
    assert np.abs(re + 1j * im - want).max() < 1e-3
    back, _ = kernels.fft2(re, im, inverse=True)
    assert np.abs(back - x).max() < 1e-5


def test_activations():
    z = np.array([-800.0, -1.0, 0.0, 2.0, 800.0])
    assert np.allclose(detmath.sigmoid(z), [0, 1 / (1 + math.e), 0.5, 1 / (1 + math.exp(-2)), 1])
    assert np.allclose(detmath.tanh(z), np.tanh(z)) and np.allclose(detmath.softplus(z), [0, math.log1p(math.exp(-1)), math.log(2), 2 + math.log1p(math.exp(-2)), 800])


# ------------------------------------------------------------------ scattering


def test_geometry_and_rules():
    assert [(a.canvas, a.out, a.out_offset) for a in ScatterConfig.two_d(64, 64, 3, pad=("zero_pad", "circular")).axes] == [(128, 8, 1), (64, 8, 0)]
    assert len(Scattering.compile(ScatterConfig.two_d(64, 64, 3, 8, "circular")).paths) == 217
    assert Scattering.compile(ScatterConfig.one_d(256, 4)).run(np.zeros((1, 256))).shape == (1, 13, 16)
    for bad in ({"J": 0, "shape": 64}, {"J": 12, "shape": 4096}, {"J": 2, "shape": 63}, {"J": 2, "shape": [8, 8], "L": 3, "dim": 2}, {"J": 2, "shape": 64, "wrong": 1}, {"shape": 64}, {"J": 2, "shape": 64, "group": "so2"}):
        with pytest.raises(ConfigError):
            ScatterConfig.parse(bad)


def test_filter_banks():
    for cfg, least, most in ((ScatterConfig.one_d(256, 4, pad="circular"), 0.165797, 1.0), (ScatterConfig.two_d(64, 64, 3, 4, "circular"), 0.132018, 1.0), (ScatterConfig.two_d(64, 64, 3, 8, "circular"), 0.122981, 1.013572)):
        bank = S.filter_bank(cfg)
        lo, hi = S.littlewood_paley(bank)
        assert abs(lo - least) < 1.5e-6 and abs(hi - most) < 1.5e-6 and bank.imaginary <= 1e-5


def test_cascade_invariants():
    cfg = ScatterConfig.one_d(64, 3, 2, "circular", carrier_cutoff=0)
    plan = Scattering.compile(cfg)
    x = np.random.default_rng(3).normal(size=(5, 64)).astype(np.float32)
    s = plan.run(x)
    assert (plan.run(x, batch=2) == s).all() and (plan.run(x[2:3]) == s[2:3]).all()
    for k in (-6, -1, 2, 5):
        scale = np.float32(2.0**k)
        assert (plan.run(x * scale) == s * scale).all() and (plan.ratio(plan.run(x * scale)) == plan.ratio(s)).all()
    moved = plan.run(np.roll(x, 8, axis=1))
    assert np.abs(np.roll(s, 1, axis=2) - moved).max() < 1e-5 * np.abs(s).max()
    assert np.array_equal(S.clouds(s).mean(1).round(9), S.log_mean(s).round(9))


def test_pooling_is_a_mean():
    raw = ScatterConfig.two_d(16, 16, 2, 4, "circular")
    x = np.random.default_rng(4).normal(size=(2, 256)).astype(np.float32)
    a, b = Scattering.compile(raw), Scattering.compile(ScatterConfig.two_d(16, 16, 2, 4, "circular", group="so2_relative"))
    s, t = a.run(x), b.run(x)
    assert np.allclose(t[:, 1], s[:, 1:5].mean(1), rtol=1e-6) and t.shape[1] == 1 + 2 + 4


def test_path_statistics():
    s = np.array([[[1, 2, 3, 4], [-1, -1, -1, -1]]], np.float32)
    assert S.path_mean(s).tolist() == [[2.5, -1]] and np.allclose(S.path_std(s), [[1.25**0.5, 0]])


def test_backends():
    class Off(kernels.NumpyBackend):
        name = "off"

        def modulus(self, re, im):
            return np.nextafter(super().modulus(re, im), np.float32(np.inf))

    kernels.register_backend("off", Off())
    try:
        plan = Scattering.compile(ScatterConfig.one_d(64, 2, pad="circular"))
        x = np.random.default_rng(1).normal(size=(1, 64)).astype(np.float32)
        assert not np.array_equal(plan.run(x), plan.run(x, "off"))
        with pytest.raises(ValueError):
            kernels.register_backend("off", Off())
    finally:
        kernels.unregister_backend("off")
    with pytest.raises(ValueError):
        kernels.backend("off")


# ------------------------------------------------------------------ statistics


def test_distance_correlation():
    g = np.random.default_rng(0)
    x = g.normal(size=200)
    assert abs(stats.dcorr2_exact(x, x) - 1) < 1e-12 and stats.dcorr2_exact(x, np.ones(200)) == 0 and stats.dcorr2_exact([1.0], [2.0]) == 0
    y, w = x**2 + 0.5 * g.normal(size=200), g.random(200)
    assert stats.dcorr2_exact(x, y) > 0.1 and abs(stats.dcorr2_exact(x, y, w) - stats.dcorr2_exact(x, y, 7 * w)) < 1e-12
    with pytest.raises(stats.StatsError):
        stats.dcorr2_exact(x, y, -w)
    v, grad = stats.dcorr2_grad(x[:40], y[:40], w[:40])
    e = 1e-6
    for k in range(4):
        up, down = x[:40].copy(), x[:40].copy()
        up[k] += e
        down[k] -= e
        assert abs((stats.dcorr2_exact(up, y[:40], w[:40]) - stats.dcorr2_exact(down, y[:40], w[:40])) / (2 * e) - grad[k]) < 1e-7
    assert abs(grad.sum()) < 1e-12


def test_divergence_cut_verdict_text():
    assert stats.jsd([1, 0], [0, 1]) == pytest.approx(math.log(2)) and stats.jsd([1, 2], [1, 2]) == 0
    b = stats.Binning.from_range([0.0, 10.0], 5)
    assert b.bin([-1, 0, 2, 9.99, 10, 11]).tolist() == [0, 0, 1, 4, 4, 4] and stats.Binning(1, 1, 3).bin([5]).tolist() == [0]
    c = stats.cut_at_signal_efficiency([0.9, 0.8, 0.7, 0.6], [1, 0, 1, 0], [1, 1, 1, 1], 0.5)
    assert (c.threshold, c.s, c.b, c.sig_eff, c.bkg_eff) == (0.9, 1, 0, 0.5, 0)
    assert stats.asimov_z(1, 0) is None and stats.asimov_z(-1, 1) is None and stats.asimov_z(0, 1) == 0
    row = lambda lam, z, j: stats.FrontierRow(lam, 0, 1, 1, 1, 1, z, j, 0)
    assert stats.verdict([row(0.0, 1, 0.2), row(1.0, 2, 0.2)], 1.0).result
    assert not stats.verdict([row(0.0, 1, 0.2), row(1.0, 2, 0.3)], 1.0).result
    assert not stats.verdict([row(0.0, None, 0.2), row(1.0, 2, 0.1)], 1.0).result
    with pytest.raises(stats.StatsError):
        stats.verdict([row(0.0, 1, 1), row(0.0, 1, 1)], 0.0)
    assert [stats.fixed6(v) for v in (-1e-9, 0.0000005, 0.0000015, None)] == ["0.000000", "0.000000", "0.000002", "n/a"]


@pytest.mark.parametrize(
    "case,lambdas,star,head,sigma,jsd",
    [("logistic/lambdas0_1_4/star1", [0.0, 1.0, 4.0], 1.0, "logistic", "-6.666948", "-0.038645"), ("mlp16/lambdas0_0.5_2/star0.5", [0.0, 0.5, 2.0], 0.5, "mlp16", "0.020611", "0.008354")],
)
def test_training_to_report(case, lambdas, star, head, sigma, jsd):
    """The published differences of two benchmark cases."""
    from dataclasses import replace

    stream = int.from_bytes(hashlib.sha3_256(f"tier2/report/{case}/n1200".encode()).digest()[:8], "little")
    tr, ev = training.synthetic(1200, 4, sweeps.SEED, stream), training.synthetic(1200, 4, sweeps.SEED, stream + 1)
    cfg = training.TrainConfig(head=head, epochs=5, batch_size=128, lr=0.02, seed=stream)
    rows = []
    for lam in lambdas:
        m = training.train(tr, replace(cfg, lam=lam))
        rows.append(stats.evaluate(lam, m.predict(ev.x), ev.y, ev.w, ev.m))
    v = stats.verdict(rows, star)
    assert (stats.fixed6(v.delta_sigma), stats.fixed6(v.delta_jsd), v.result) == (sigma, jsd, False)
    text = stats.Report(rows, star).markdown()
    assert "Result: **FALSE**" in text and sigma in text


def test_head_gradients_and_ridge():
    g = np.random.default_rng(2)
    x = g.normal(size=(6, 3))
    for name in ("logistic", "mlp4"):
        h = training.Head.init(training.HeadKind.parse(name), 3, 1)
        h.p = h.p + 0.1 * g.normal(size=len(h.p))
        grad = h.logit_grad(x)
        for k in range(len(h.p)):
            e = np.zeros(len(h.p))
            e[k] = 1e-6
            up, down = (training.Head(h.kind, 3, h.p + s * e).logit(x) for s in (1, -1))
            assert np.allclose((up - down) / 2e-6, grad[:, k], atol=1e-6)
    t = x @ [1.0, -2.0, 0.5] + 3
    c = training.ridge(x, t)
    assert np.allclose(c.predict(x), t, atol=1e-3) and c.r2 > 0.999
    with pytest.raises(training.TrainError):
        training.cholesky(-np.eye(2))


# ------------------------------------------------------------- anomaly, identity


def test_wasserstein():
    a, b = np.array([[0.0, 1.0, 2.0]]), np.array([[5.0, 6.0, 7.0]])
    assert anomaly.w1_sorted(a, b)[0] == pytest.approx(5) and anomaly.w1_sorted(a, a)[0] == 0
    assert anomaly.w1_sorted(np.array([[0.0]]), np.array([[0.0, 2.0]]))[0] == pytest.approx(1)
    d = anomaly.directions(3, 16, 0)
    assert np.allclose((d * d).sum(1), 1)


def test_index_finds_outlier_and_neighbours():
    g = np.random.default_rng(7)
    clouds = [g.normal(size=(8, 3)) for _ in range(60)]
    clouds[17] = clouds[17] + 6
    index = anomaly.AnomalyIndex(clouds, anomaly.AnomalyConfig(tau=3.0, k=5))
    det = index.detect_self()
    assert det[17].flagged and sum(d.flagged for d in det) == 1
    hits = 0
    for q in range(60):
        exact = sorted((index.distance(q, j), j) for j in range(60))[:5]
        hits += len({j for _, j in exact} & {j for _, j in index.knn(clouds[q], 5)})
    assert hits / 300 >= 0.95
    flags = [d.flagged for d in index.detect([clouds[3], clouds[3] + 6])]
    assert flags == [False, True]
    graph = index.graph([clouds[3] + 6])
    assert len(graph["nodes"]) == 61 and all(0 <= n["x"] <= 1 for n in graph["nodes"]) and index.graph_json() == index.graph_json()
    few = anomaly.AnomalyIndex(clouds[:3], anomaly.AnomalyConfig(tau=0.0, k=5))
    assert few.detect_self()[0].kth_distance is None and not few.detect_self()[0].flagged


def test_canonical_json_and_manifests():
    assert provenance.canonical({"b": [-1, True, None], "a": 'x"y\\z\n\u0001'}) == '{"a":"x\\"y\\\\z\\n\\u0001","b":[-1,true,null]}'
    for v, text in ((1e21, "1e+21"), (1e20, "1" + "0" * 20), (1.5e-7, "1.5e-7"), (-0.0, "0"), (5e-324, "5e-324"), (0.000001, "0.000001"), (333333333.33333329, "333333333.3333333")):
        assert provenance.format_number(v) == text
    with pytest.raises(ValueError):
        provenance.canonical(float("nan"))
    plan = Scattering.compile(ScatterConfig.one_d(64, 2, pad="circular"))
    a = provenance.scattering_manifest(plan, 1, "0" * 28, "1" * 28)
    b = provenance.scattering_manifest(plan, 1, "0" * 28, "1" * 28, provenance.Execution(executor="cloud", wall_clock=(1, 2)))
    assert a.manifest_hash() == b.manifest_hash() != provenance.scattering_manifest(plan, 1, "2" * 28, "1" * 28).manifest_hash()
    import json

    assert provenance.hash_of_json(json.loads(b.to_json())) == b.manifest_hash()
    assert len(provenance.oid(b"x")) == 28 and provenance.is_oid(provenance.oid(b"x"))


# ------------------------------------------------------------------ DataFrames


def frame(spark, n=30, width=64):
    g = np.random.default_rng(11)
    return spark.createDataFrame([(i, g.normal(size=width).tolist()) for i in range(n)], "event_id long, signal array<float>")


def test_scatter_does_not_depend_on_partitions(spark):
    df, cfg = frame(spark), ScatterConfig.one_d(64, 3, pad="circular", carrier_cutoff=0)
    one = {r.event_id: r.oid for r in signals.scatter(df.coalesce(1), cfg, with_oid=True).collect()}
    many = {r.event_id: r.oid for r in signals.scatter(df.repartition(7), {"J": 3, "shape": 64, "pad": "circular", "carrier_cutoff": 0}, with_oid=True).collect()}
    assert one == many and len(one) == 30
    s = signals.scatter(df, cfg)
    direct = Scattering.compile(cfg).run(np.array([r.signal for r in df.orderBy("event_id").collect()], np.float32))
    for name, f in (("ratio", lambda x: Scattering.compile(cfg).ratio(x).reshape(len(x), -1)), ("log_mean", S.log_mean), ("mean", S.path_mean), ("std", S.path_std)):
        got = np.array([r[1] for r in signals.reduce_coefficients(s, cfg, name).orderBy("event_id").collect()])
        assert np.array_equal(got, np.asarray(f(direct)).astype(got.dtype)), name
    with pytest.raises(Exception, match="samples"):
        signals.scatter(frame(spark, 2, 32), cfg).collect()


def test_psum_does_not_depend_on_partitions(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=3000) * 10.0 ** g.integers(-8, 8, 3000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k long, v double")
    for parts in (1, 5):
        assert tables.psum_columns(df.repartition(parts), ["k"], ["v"])["v"] == sums.psum(x)
    assert tables.psum_columns(df.limit(0), ["k"], ["v"]) == {"v": 0.0}


def test_chunked_estimator(spark):
    g = np.random.default_rng(6)
    x, y = g.normal(size=9000), g.normal(size=9000)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k long, x double, y double").repartition(3)
    assert tables.dcorr2_chunked(df, "x", "y", order="k", permutation="reference") == stats.dcorr2_chunked(x, y)
    # Drawn in tasks: every row in one chunk at most, in order of its words.
    i = np.arange(9000, dtype=np.uint64)
    s = rng.Stream(0, rng.STREAM_CHUNKS)
    draw = s.words(2 * i) | s.words(2 * i + np.uint64(1)) << np.uint64(32)
    order = np.lexsort((i, draw >> np.uint64(1)))
    got = {r.chunk: r.value for r in tables.dcorr2_chunks(df, "x", "y", order="k", chunk=500).collect()}
    assert got == {k: stats.dcorr2_exact(x[p], y[p]) for k, p in enumerate(order.reshape(18, 500))}
    few = df.where("k < 7")
    assert tables.dcorr2_chunked(few, "x", "y", order="k") == stats.dcorr2_exact(x[:7], y[:7])
    with pytest.raises(ValueError):
        tables.dcorr2_chunks(df, "x", "y", order="k", permutation="none")


def test_synthetic_and_report(spark):
    df = tables.synthetic_dataset(spark, 500, 4, 3, 1).repartition(5)
    a, b = tables.dataset(df), training.synthetic(500, 4, 3, 1)
    assert a.oid() == b.oid()
    r = tables.bench_report(df, tables.synthetic_dataset(spark, 400, 4, 3, 2), [0.0, 0.5], 0.5, epochs=2, batch_size=64)
    assert r.json() == tables.bench_report(df, tables.synthetic_dataset(spark, 400, 4, 3, 2), [0.0, 0.5], 0.5, epochs=2, batch_size=64).json()
    model = tables.train_tag(df, epochs=1)
    got = {x.event_id: x.score for x in tables.predict(df, model).collect()}
    assert np.array_equal([got[i] for i in range(500)], model.predict(b.x))


def test_large_groups_are_split(spark):
    g = np.random.default_rng(12)
    rows = [(k, u, float(a), float(b)) for k, (u, a, b) in enumerate(zip(["hot"] * 900 + ["cold"] * 80 + [None] * 50, g.normal(size=1030), g.normal(size=1030)))]
    df = spark.createDataFrame(rows, "k long, user string, x double, y double").repartition(6)
    got = {r.user: r for r in tables.dcorr2(df, "x", "y", keys=["user"], order="k", exact_up_to=100, chunk=90).collect()}
    value = lambda own: stats.dcorr2_exact([r[2] for r in own], [r[3] for r in own])
    for u in ("cold", None):
        own = [r for r in rows if r[1] == u]
        assert got[u].n == len(own) and got[u].dcorr2 == value(own)
    hot = rows[:900]
    i = np.arange(900, dtype=np.uint64)
    s = rng.Stream(0, rng.STREAM_CHUNKS)
    order = np.lexsort((i, (s.words(2 * i) | s.words(2 * i + np.uint64(1)) << np.uint64(32)) >> np.uint64(1)))
    assert got["hot"].n == 900 and abs(got["hot"].dcorr2 - np.mean([value([hot[k] for k in p]) for p in order.reshape(10, 90)])) < 1e-12


def test_calibration_in_place_has_the_same_bits(spark):
    g = np.random.default_rng(8)
    x = g.normal(size=(700, 3)) * [1, 50, 0.1] + [0, 5, 2]
    t = x @ [2.0, -0.3, 4.0] + g.normal(size=700)
    df = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, t))], "k long, x array<double>, t double").repartition(5)
    want, got = training.ridge(x, t), tables.calibrate(df, "x", "t", order=["k"])
    for name in ("coef", "bias", "r2", "residual_std", "mu", "std"):
        assert np.array_equal(getattr(want, name), getattr(got, name)), name
    left = {r.k: r.residual for r in tables.residuals(df, got, "x", "t").collect()}
    assert np.allclose([left[i] for i in range(700)], want.residuals, atol=1e-12) and "residuals_oid" not in got.constants()
    with pytest.raises(training.TrainError):
        tables.calibrate(df.limit(0), "x", "t", order=["k"])


def test_running_sums_by_ranges(spark):
    g = np.random.default_rng(9)
    v = g.integers(0, 100, 5000)
    df = spark.createDataFrame([(i, int(a), float(a) / 4) for i, a in enumerate(v)], "k long, a long, b double").repartition(7)
    got = sorted(tables.running_sums(df, ["k"], ["a", "b"]).collect())
    assert [r.run_a for r in got] == np.cumsum(v).tolist() and [r.run_b for r in got] == (np.cumsum(v) / 4).tolist()
    assert tables.running_sums(df.limit(0), ["k"], ["a"]).collect() == []
    assert sorted(r.idx for r in tables.dense_index(df, ["k"]).collect()) == list(range(5000))


def test_queries_in_blocks_equal_those_that_are_broadcast(spark):
    df = frame(spark, 60)
    p = tables.project_clouds(df, anomaly.directions(8, 6, 0), id_col="event_id", cloud_col="signal")
    one = sorted(tables.sw1_top_k(p, p, 4, 6, id_col="event_id").collect())
    assert sorted(tables.sw1_top_k(p, p, 4, 6, id_col="event_id", broadcast=10).collect()) == one and len(one) == 240


def test_null_signals(spark):
    cfg = ScatterConfig.one_d(8, 2, pad="circular", carrier_cutoff=0)
    rows = [(1, [1.0] * 8, "a"), (2, None, "b"), (3, [1.0, None] + [0.0] * 6, "c"), (4, [0.5] * 8, "d")]
    df = spark.createDataFrame(rows, "event_id long, signal array<float>, label string")
    s = signals.scatter(df, cfg, with_oid=True, keep=("label",))
    got = {r.event_id: r for r in s.collect()}
    assert s.columns == ["event_id", "label", "coeffs", "oid"] and [got[k].coeffs is None for k in (1, 2, 3, 4)] == [False, True, True, False]
    assert got[2].oid is None and got[3].label == "c" and got[1].oid != got[4].oid
    both = {r.event_id: r for r in signals.reduced(s, cfg, ["mean", "std", "log_mean"], keep=("label",)).collect()}
    assert both[2].mean is None and len(both[1].mean) == len(both[4].std) == len(both[1].fp)
    none = df.where("signal is null")
    assert signals.scatter(none, cfg).first().coeffs is None and signals.scatter(df.limit(0), cfg).collect() == []


def test_labels_go_along_without_a_shuffle(spark):
    df = frame(spark, 10).withColumn("label", F.col("event_id") % 3)
    cfg = ScatterConfig.one_d(64, 3, pad="circular", carrier_cutoff=0)
    out = signals.reduced(signals.scatter(df, cfg, keep=("label",)), cfg, ["mean", "std"], keep=("label",))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_index_on_tables(spark):
    df = frame(spark, 40)
    index = tables.AnomalyIndex.fit(df, 8, id_col="event_id", cloud_col="signal", tau=0.1, k=3)
    got = index.transform(df, id_col="event_id", cloud_col="signal").collect()
    assert len(got) == 40 and all(r.nearest[0] == r.event_id for r in got) and len(index) == 40


def test_tensor_store(spark, tmp_path):
    s = TensorStore(spark, f"file://{tmp_path}/t")
    x = np.arange(6, dtype=np.float32).reshape(2, 3)
    name = s.put(x, "float32")
    assert s.put(x, "float32") == name and (s.get(name) == x).all() and s.table().count() == 1
    with pytest.raises(KeyError):
        s.get("0" * 28)
    s.put_column(frame(spark, 5), "signal", "float32")
    s.put_column(frame(spark, 5), "signal", "float32")
    assert s.verified().where("ok").count() == 6
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / f"{name}.bin").write_bytes(x.tobytes())
    (tmp_path / "f" / ("0" * 28)).write_bytes(b"z")
    got = {r.oid: r.ok for r in s.from_files(f"file://{tmp_path}/f").collect()}
    assert got == {name: True, "0" * 28: False}
    assert s.remove(name) and not s.remove(name) and s.table().count() == 5
    with pytest.raises(KeyError):
        s.get(name)
    assert s.put(x, "float32") == name and (s.get_many([name])[name] == x).all()
    s.drop()
    assert s.table().count() == 0


def test_stream(spark, tmp_path):
    from wavemill.streaming.scatter import scatter_stream

    df, cfg = frame(spark, 20), ScatterConfig.one_d(64, 2, pad="circular")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    out = scatter_stream(spark, f"file://{tmp_path}/in", df.schema, cfg, id_col="event_id", signal_col="signal", out=f"file://{tmp_path}/out", files_per_batch=1)
    want = {r.event_id: r.coeffs for r in signals.scatter(df, cfg).collect()}
    assert {r.event_id: r.coeffs for r in out.collect()} == want
    one = next(p for p in (tmp_path / "in").iterdir() if p.name.startswith("part"))
    alone = scatter_stream(spark, f"file://{one}", df.schema, cfg, id_col="event_id", signal_col="signal")
    assert 0 < alone.count() < 20


def test_pruned_inverse_has_the_same_bits():
    class Plain(kernels.NumpyBackend):
        name = "plain"
        ifft_subsample = None

    kernels.register_backend("plain", Plain())
    try:
        for cfg in (ScatterConfig.two_d(16, 32, 2, 4, ("zero_pad", "circular")), ScatterConfig.one_d(48, 4), ScatterConfig.one_d(64, 6, pad="circular")):
            plan = Scattering.compile(cfg)
            for scale in (1, 1e-19, 1e-37):
                x = (np.random.default_rng(2).normal(size=(3, cfg.signal_len)) * scale).astype(np.float32)
                assert np.array_equal(plan.run_raw(x).view(np.uint32), plan.run_raw(x, "plain").view(np.uint32))
    finally:
        kernels.unregister_backend("plain")


# ------------------------------------------------------------ conformance, certificates


def test_cases():
    from wavemill.plans import conformance as C

    names = C.cases()
    assert len(names) == 434 and names[0] == "fft1d/n2/forward/uniform"
    cfg, x = C.scatter_case("scatter/2d/32x32/J2-Q1-L4/circular-circular/so2_relative/o2/uniform")
    assert cfg.group == "so2_relative" and np.array_equal(x, C.scatter_case("scatter/2d/32x32/J2-Q1-L4/circular-circular/trivial/o2/uniform")[1])
    for kind in C.MODULUS + C.PATTERNS + ["long_tail", "signed_zero"]:
        assert C._samples(kind, rng.Stream(1, 1), 4, 8, 2).shape == (32, 2)
    assert C.first_difference("float32", np.float32([1, 2]).tobytes(), np.nextafter(np.float32([1, 2]), np.float32(9)).tobytes()) == (0, 1)
    assert C.first_difference("utf8", b"abc", b"abd") == (2, None) and C.first_difference("utf8", b"a", b"a") is None


def test_suite_finds_one_unit_in_the_last_place(spark):
    from wavemill.plans import conformance as C

    class Off(kernels.NumpyBackend):
        name = "off"

        def modulus(self, re, im):
            m = super().modulus(re, im).copy()
            m.flat[0] = np.nextafter(m.flat[0], np.float32(np.inf))
            return m

    want = C.run(spark, ("modulus/", "fft1d/n8/")).cache()
    same = C.compare(C.run(spark, ("modulus/", "fft1d/n8/")), want)
    assert same.where("not passed").count() == 0 and same.count() == want.count()
    kernels.register_backend("off", Off())
    try:
        got = C.selftest("off")
        assert got["failed"] > 0 and "modulus/n1024" in got["failures"] and "fft1d/n64" not in got["failures"]
    finally:
        kernels.unregister_backend("off")


@pytest.mark.parametrize("name", ["fft", "ifft", "mul_real_filter", "modulus", "subsample"])
def test_selftest_sees_a_last_bit_of_any_kernel(monkeypatch, name):
    """The default backend is held against recorded digests, not against itself."""
    from wavemill.plans import conformance as C

    real = getattr(kernels.NumpyBackend, name)

    def off(self, *a):
        out = real(self, *a)
        first = out[0] if isinstance(out, tuple) else out
        first = first.copy()
        first.flat[-1] = np.nextafter(first.flat[-1], np.float32(np.inf))
        return (first, *out[1:]) if isinstance(out, tuple) else first

    assert C.selftest()["failed"] == 0
    monkeypatch.setattr(kernels.NumpyBackend, name, off)
    monkeypatch.setattr(kernels.NumpyBackend, "ifft_subsample", None)
    assert C.selftest()["failed"] > 0


def test_every_group_has_a_digest():
    from wavemill.plans import conformance as C

    own = C.groups()
    assert sum(map(len, own.values())) == 434 and all(C.recorded(g) for g in own) and set(C.DIGESTS) <= set(own)


def test_backends_and_canvases_are_checked():
    for bad in (("", 3), ("cpu", 3), ("x" * 65, 3), ("older", 2)):
        b = kernels.NumpyBackend()
        b.numerics_version = bad[1]
        with pytest.raises(kernels.BackendError):
            kernels.register_backend(bad[0], b)
    with pytest.raises(kernels.BackendError):
        kernels.register_backend("half", type("Half", (), {"numerics_version": 3})())
    x = np.zeros((4, 8, 2), np.float32)
    kernels.check_planes(4, 8, x, x)
    for f in (lambda: kernels.check_canvas(3, 8), lambda: kernels.check_planes(8, 4, x), lambda: kernels.check_planes(4, 8, x.astype(float)), lambda: kernels.check_subsample(4, 8, (2, 2), (0, 0), (3, 4)), lambda: kernels.check_subsample(4, 8, (0, 2), (0, 0), (1, 1))):
        with pytest.raises(kernels.BackendError):
            f()
    kernels.check_subsample(4, 8, (2, 2), (0, 1), (2, 3))


def test_vectors_and_command_line(spark, tmp_path, capsys):
    import json

    from wavemill import cli
    from wavemill.plans import conformance as C

    path = f"file://{tmp_path}/vectors"
    assert cli.main(["generate", path, "fft1d/n2/", "modulus/"], spark) == 0
    assert C.load_expected(spark, path).count() == 25 and cli.main(["check", path, "fft1d/n2/", "modulus/"], spark) == 0
    wrong = C.load_expected(spark, path).withColumn("sha3", F.lit("0")).withColumn("data", F.unhex(F.lit("00")))
    wrong.write.parquet(f"{path}-wrong")
    assert cli.main(["check", f"{path}-wrong", "modulus/"], spark) == 1
    capsys.readouterr()
    assert cli.main(["run", "fft1d/n8", "modulus/"], spark) == 0
    assert json.loads(capsys.readouterr().out)["cases"] == 16 + 9
    assert cli.main(["list", "tier2/"]) == 0 and len(capsys.readouterr().out.split()) == 18
    assert cli.main(["hashes"]) == 0 and len(json.loads(capsys.readouterr().out)["sweeps"]) == 13
    assert cli.main(["selftest"]) == 0 and json.loads(capsys.readouterr().out)["cases"] == 92
    assert cli.main(["wrong"]) == 2


@pytest.mark.parametrize("cfg", [ScatterConfig.one_d(256, 4, 4, "circular"), ScatterConfig.one_d(256, 6, 8, "circular"), ScatterConfig.one_d(256, 3, 2, "zero_pad"), ScatterConfig.one_d(192, 4, 1, "zero_pad"), ScatterConfig.two_d(32, 32, 3, 8, "circular", group="so2_relative"), ScatterConfig.two_d(32, 64, 2, 4, ("zero_pad", "circular"))], ids=str)
def test_cascade_against_platform_transforms(cfg):
    """The same cascade in binary64 by numpy's FFT: orders agree to 2e-6 of their
    greatest value, with padding, several filters an octave, and pooling."""
    plan = Scattering.compile(cfg)
    x = np.random.default_rng(5).normal(size=cfg.signal_len).astype(np.float32)
    axes = cfg.axes if cfg.dim == 2 else (S.Axis(1, 1, 0, 1, 0), cfg.axes[0])
    canvas = np.zeros(cfg.canvas)
    canvas[axes[0].offset : axes[0].offset + axes[0].n, axes[1].offset : axes[1].offset + axes[1].n] = x.reshape(axes[0].n, axes[1].n)
    step = 1 << cfg.J

    def smooth(u):
        v = np.fft.ifft2(np.fft.fft2(u) * plan.bank.phi).real[:: step if cfg.dim == 2 else 1, ::step]
        return v[axes[0].out_offset : axes[0].out_offset + axes[0].out, axes[1].out_offset : axes[1].out_offset + axes[1].out].ravel()

    u1 = [np.abs(np.fft.ifft2(np.fft.fft2(canvas) * h)) for h in plan.bank.first]
    raw = [smooth(canvas), *map(smooth, u1)] + [smooth(np.abs(np.fft.ifft2(np.fft.fft2(u1[k]) * plan.bank.of_second()[m]))) for k, ms in enumerate(plan.partners) for m in ms]
    want = {p.n: v for p, v in zip(plan.raw_paths, raw)}
    if cfg.group != "trivial":
        L, mean = cfg.L, lambda names: np.mean([want[n] for n in names], 0)
        raw = [raw[0]] + [mean([(j * L + q,) for q in range(L)]) for j in range(cfg.J)] + [mean([(a * L + q, b * L + (q + d) % L) for q in range(L)]) for a in range(cfg.J) for b in range(a + 1, cfg.J) for d in range(L)]
    got, raw = plan.run(x[None])[0], np.array(raw)
    for order in (0, 1, 2):
        own = [k for k, p in enumerate(plan.paths) if p.order == order]
        assert np.abs(got[own] - raw[own]).max() <= 2e-6 * np.abs(raw[own]).max()


def test_far_arguments():
    """Against numpy's sines, which are right to a unit in the last place here."""
    x = np.random.default_rng(1).normal(size=4000) * 10.0 ** np.arange(4000).__mod__(300)
    assert np.abs(detmath.sin(x) - np.sin(x)).max() < 3e-16 and np.abs(detmath.cos(x) - np.cos(x)).max() < 3e-16


def test_certificates(tmp_path):
    import json

    from wavemill.plans import certificate

    plan = Scattering.compile(ScatterConfig.one_d(64, 2, pad="circular"))
    x = np.random.default_rng(1).normal(size=(2, 64)).astype(np.float32)
    a, b = provenance.tensor_bytes(x, "float32"), provenance.tensor_bytes(plan.run(x), "float32")
    m = provenance.scattering_manifest(plan, 2, provenance.oid(a), provenance.oid(b))
    cert = certificate.issue(m.to_json())
    assert json.loads(cert)["conformance"]["selftest_result"] == "pass"
    assert certificate.verify(cert, str(tmp_path)).error
    (tmp_path / f"{provenance.oid(a)}.bin").write_bytes(a)
    assert certificate.verify(cert, str(tmp_path)).verified
    wrong = json.loads(cert)
    wrong["manifest"]["outputs"][0]["oid"] = "0" * 28
    got = certificate.verify(json.dumps(wrong), str(tmp_path))
    assert not got.verified and not got.manifest_hash_ok
    (tmp_path / f"{provenance.oid(a)}.bin").write_bytes(a[:-1] + b"\x00")
    assert not certificate.verify(cert, str(tmp_path)).verified
    with pytest.raises(ValueError):
        certificate.issue("{}")


def test_session(spark, tmp_path):
    from wavemill.sources.session import Session, SessionError

    s = Session(spark, f"file://{tmp_path}/s")
    g = np.random.default_rng(3)
    cfg = {"J": 3, "dim": 1, "pad": "circular"}
    runs = [s.compute_scattering(s.put(g.normal(size=(4, 64))), cfg) for _ in range(2)]
    odd = s.compute_scattering(s.put(50 * g.normal(size=(1, 64))), cfg)
    assert runs[0]["shape"][0] == 4 and s.runs().count() == 3
    assert s.reduce(runs[0]["oid"], "log_mean")["shape"] == [4, runs[0]["shape"][1]]
    with pytest.raises(SessionError):
        s.reduce(s.put(g.normal(size=(1, 64))))
    near = s.compare(runs[0]["oid"], k=2)
    assert len(near["events"]) == 4 and {n["oid"] for e in near["events"] for n in e["neighbours"]} <= {runs[1]["oid"], odd["oid"]}
    assert s.detect_anomaly(odd["oid"], 1.0, k=2)["events"][0]["flagged"]
    assert not s.detect_anomaly(runs[0]["oid"], 1.0, k=1)["events"][0]["flagged"]
    with pytest.raises(SessionError):
        s.detect_anomaly(odd["oid"], 0.0)
    import io
    import json

    from wavemill.sources import server

    ask = lambda method, ident=1, **p: json.dumps({"jsonrpc": "2.0", "id": ident, "method": method, "params": p})
    call = lambda name, **a: ask("tools/call", name=name, arguments=a)
    lines = [ask("initialize"), ask("tools/list"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), call("compare", oid=runs[0]["oid"], k=2), call("reduce_scattering", oid=runs[0]["oid"], method="mean"), call("reduce", oid="0" * 28), call("reduce", wrong=1), call("none"), ask("none"), "{", "[]", ""]
    out = io.StringIO()
    server.serve(s, io.StringIO("\n".join(lines)), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(got) == 10 and len(got[1]["result"]["tools"]) == 4 and got[0]["result"]["capabilities"] == {"tools": {}}
    assert got[2]["result"]["structuredContent"] == near and got[3]["result"]["structuredContent"]["shape"] == [4, runs[0]["shape"][1]]
    assert [g["result"]["isError"] for g in got[2:6]] == [False, False, True, True] and [g["error"]["code"] for g in got[6:]] == [-32602, -32601, -32700, -32600]
    s.close()
    assert s.runs().count() == 0


def test_api_names():
    import wavemill.api as api

    for n in "scatter scatter_paths r2 fingerprint fingerprint_clouds dcorr2 synthetic_dataset train_tag calibrate AnomalyIndex bench_report scattering_manifest issue_certificate verify_certificate conformance_selftest oid Session".split():
        assert hasattr(api, n)


# ------------------------------------------------------------------ arrays, segments

CFG = {"J": 4, "Q": 2, "pad": "zero_pad"}


def test_arrays_of_any_layout():
    from wavemill import arrays

    x = np.random.default_rng(7).normal(size=(3, 256)).astype(np.float32)
    s, name = arrays.scatter(x, CFG)
    for v in (np.asfortranarray(x), np.repeat(x, 2, 1)[:, ::2], x.astype(">f4"), x.astype(np.float64), x.tolist()):
        assert arrays.scatter(v, CFG)[1] == name
    one, _ = arrays.scatter(x[1], CFG)
    assert s.shape == (3, len(arrays.scatter_paths({**CFG, "shape": [256]})), 16) and one[0].tobytes() == s[1].tobytes()
    for bad in ({**CFG, "other": 1}, {"J": 0}, {"J": 4, "shape": 255}):
        with pytest.raises(ValueError):
            arrays.scatter(x, bad)
    full = {**CFG, "shape": [256]}
    fp, clouds, (ratio, _) = arrays.fingerprint(s, full)[0], arrays.fingerprint_clouds(s, full), arrays.r2(s, full)
    assert np.allclose(clouds.mean(1), fp, rtol=0, atol=1e-12) and ratio.shape[0] == 3 and ratio.shape[2] == 16
    images, _ = arrays.scatter(np.zeros((2, 16, 16)), {"J": 2, "L": 4, "pad": "circular"})
    assert images.shape == (2, 25, 4, 4)


def test_arrays_provenance(tmp_path):
    import json

    from wavemill import arrays

    x = np.random.default_rng(5).normal(size=(2, 256)).astype(np.float32)
    s, name = arrays.scatter(x, CFG)
    local, digest = arrays.provenance_manifest(x, CFG, name)
    other, same = arrays.provenance_manifest(x, CFG, name, backend="elsewhere", backend_version="9", executor="cloud", started_unix_ms=1, finished_unix_ms=2)
    m = json.loads(local)
    assert digest == same == m["manifest_hash"] and local != other and json.loads(other)["execution"]["wall_clock"] == {"finished_unix_ms": 2, "started_unix_ms": 1}
    assert m["inputs"][0] == {"dtype": "float32", "name": "signal", "oid": arrays.oid(x.tobytes()), "shape": [2, 256]} and m["outputs"][0]["shape"] == list(s.shape)
    cert = arrays.issue_certificate(local)
    (tmp_path / f"{arrays.oid(x.tobytes())}.bin").write_bytes(x.tobytes())
    assert arrays.verify_certificate(cert, str(tmp_path)) == {"verified": True, "manifest_hash_ok": True, "outputs": [{"name": "coefficients", "ok": True}], "error": None}
    (tmp_path / f"{arrays.oid(x.tobytes())}.bin").write_bytes((x + 1).tobytes())
    assert not arrays.verify_certificate(cert, str(tmp_path))["verified"]
    with pytest.raises(ValueError):
        arrays.provenance_manifest(x, CFG, "none")


def test_arrays_statistics_and_search():
    import json

    from wavemill import arrays

    data = arrays.synthetic_dataset(600, 4, 3)
    a, b = (arrays.train_tag(data["x"], data["y"], data["w"], data["m"], epochs=4, batch_size=128) for _ in range(2))
    assert a.oid == b.oid and a.epoch_loss[-1] < a.epoch_loss[0] and a.predict(data["x"]).shape == (600,)
    with pytest.raises(ValueError):
        arrays.train_tag(data["x"], data["y"], lam=1.0)
    text, page = arrays.bench_report(data, arrays.synthetic_dataset(500, 4, 3, 1), lambdas=[0.0, 0.5], lambda_star=0.5, epochs=2)
    assert json.loads(text)["win_condition"]["result"] in ("TRUE", "FALSE") and page.startswith("#")
    g = np.random.default_rng(4)
    x = g.normal(size=(300, 3))
    c = arrays.calibrate(x, 2 * x[:, 0] - x[:, 1] + 1)
    assert c["r2"] > 0.999999 and json.loads(c["constants_json"])["residuals_oid"] == c["residuals_oid"]
    index = arrays.anomaly_index(g.normal(size=(40, 8, 4)), tau=1.0, k=5, seed=11)
    got = arrays.anomaly_query(index, [g.normal(size=(8, 4)), g.normal(size=(8, 4)) + 6.0])
    assert got["flagged"].tolist() == [False, True] and got["nearest"].shape == (2, 5) and len(json.loads(got["graph_json"])["nodes"]) == 42
    few = arrays.anomaly_query(arrays.anomaly_index(g.normal(size=(3, 4)), tau=1.0, k=5), [g.normal(size=4)])
    assert np.isnan(few["kth_distance"][0]) and (few["nearest"][0] == -1).sum() == 2
    v = g.normal(size=400)
    assert arrays.dcorr2_w(v, v) == pytest.approx(1) and arrays.dcorr2_w(v, v * v, g.random(400)) > 0.05


@pytest.mark.parametrize("kind", ["file", "posix_shm"])
def test_segments(tmp_path, kind):
    from wavemill.sources import segments

    s = segments.FolderSegments(str(tmp_path)) if kind == "file" else segments.SharedSegments()
    b = np.random.default_rng(6).bytes(1000)
    name = provenance.oid(b)
    assert s.kind == kind and s.write(name, b) and not s.write(name, b) and s.read(name, 1000) == b
    if kind == "posix_shm":
        from multiprocessing import shared_memory

        m = shared_memory.SharedMemory(name=name, track=False)
        assert bytes(m.buf[:1000]) == b
        m.close()
    with pytest.raises(ValueError):
        s.read(name, 999)
    with pytest.raises(ValueError):
        s.write("0" * 28, b)
    with pytest.raises(ValueError):
        s.read("../x", 1)
    s.remove(name)
    with pytest.raises(OSError):
        s.read(name, 1000)
    s.write(name, b)
    s.close()
