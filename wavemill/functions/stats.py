"""Weighted statistics with ordered sums: distance correlation and its gradient,
divergences, cuts, significance, reports. Events count in their natural order.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np

from . import detmath
from .provenance import NAMESPACE, NUMERICS_VERSION, TIER2_VERSION, canonical
from .rng import STREAM_CHUNKS, Stream
from .sums import argsort_desc, normalised, psum

EXACT_UP_TO = 10_000
CHUNK = 4096
#: Rows of a pairwise matrix that are held at once.
TILE_CELLS = 4_000_000


class StatsError(ValueError):
    pass


def _checked(x, y, w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    w = np.ones(len(x)) if w is None else np.asarray(w, np.float64)
    if not len(x) == len(y) == len(w):
        raise StatsError("lengths differ")
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise StatsError("values are finite")
    if len(x):
        try:
            normalised(w)
        except ValueError as e:
            raise StatsError(str(e)) from None
    return x, y, w


def _tiles(n: int):
    step = max(1, TILE_CELLS // max(1, n))
    return ((a, min(n, a + step)) for a in range(0, n, step))


def centering(x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float]:
    """Weighted row means of |x_i - x_j|, and their mean."""
    r = np.concatenate([psum(v * np.abs(x[a:b, None] - x)) for a, b in _tiles(len(x))])
    return r, float(psum(v * r))


def _centred(x, r, mu, a, b):
    return ((np.abs(x[a:b, None] - x) - r[a:b, None]) - r) + mu


def moments(x, y, v) -> tuple[float, float, float]:
    """Squared distance covariances of (x, y), (x, x), (y, y)."""
    rx, mx = centering(x, v)
    ry, my = centering(y, v)
    rows = [[], [], []]
    for a, b in _tiles(len(x)):
        ca, cb = _centred(x, rx, mx, a, b), _centred(y, ry, my, a, b)
        va = v * ca
        rows[0].append(psum(va * cb))
        rows[1].append(psum(va * ca))
        rows[2].append(psum((v * cb) * cb))
    return tuple(float(psum(v * np.concatenate(r))) for r in rows)


def _ratio(xy: float, xx: float, yy: float) -> float:
    p = xx * yy
    if p <= 0 or np.sqrt(p) < 1e-12:
        return 0.0
    return float(xy / np.sqrt(p))


def dcorr2_exact(x, y, w=None) -> float:
    x, y, w = _checked(x, y, w)
    return 0.0 if len(x) < 2 else _ratio(*moments(x, y, normalised(w)))


def chunks(n: int, seed: int = 0) -> list[np.ndarray] | None:
    """Events of each chunk, or None where the exact statistic is used."""
    c = min(CHUNK, n // 2)
    if c < 4:
        return None
    order = Stream(seed, STREAM_CHUNKS).permutation(n)
    return [order[k * c : (k + 1) * c] for k in range(n // c)]


def dcorr2_chunked(x, y, w=None, seed: int = 0) -> float:
    x, y, w = _checked(x, y, w)
    parts = chunks(len(x), seed)
    if parts is None:
        return dcorr2_exact(x, y, w)
    return float(psum(np.array([dcorr2_exact(x[p], y[p], w[p]) for p in parts])) / len(parts))


def weighted_dcorr2(x, y, w=None) -> float:
    return dcorr2_exact(x, y, w) if len(x) <= EXACT_UP_TO else dcorr2_chunked(x, y, w, 0)


def dcorr2_grad(s, m, w=None) -> tuple[float, np.ndarray]:
    """The statistic of scores and a protected variable, and its gradient in the
    scores; sign(0) = 0."""
    s, m, w = _checked(s, m, w)
    n = len(s)
    if n < 2:
        return 0.0, np.zeros(n)
    v = normalised(w)
    d, vs, vm = moments(s, m, v)
    value = _ratio(d, vs, vm)
    if vs * vm <= 0 or np.sqrt(vs * vm) < 1e-12:
        return 0.0, np.zeros(n)
    den, c = np.sqrt(vs * vm), d / vs
    rs, ms = centering(s, v)
    rm, mm = centering(m, v)
    out = []
    for a, b in _tiles(n):
        ca, cb = _centred(s, rs, ms, a, b), _centred(m, rm, mm, a, b)
        sign = np.sign(s[a:b, None] - s)
        out.append(((2.0 * v[a:b]) / den) * psum((v * sign) * (cb - c * ca)))
    return value, np.concatenate(out)


def pearson_proxy_grad(s, m, w=None) -> np.ndarray:
    s, m, w = _checked(s, m, w)
    v = w / (psum(w) + 1e-12)
    ds, dm = s - psum(v * s), m - psum(v * m)
    cov = psum(ds * dm * v)
    var_s, var_m = psum(ds * ds * v) + 1e-12, psum(dm * dm * v) + 1e-12
    sd = np.sqrt(var_s * var_m)
    r = cov / sd
    return 2.0 * r * v * (dm / sd - r * ds / var_s)


# ------------------------------------------------------------------ histograms


@dataclass(frozen=True)
class Binning:
    lo: float
    hi: float
    n_bins: int

    @classmethod
    def from_range(cls, reference, n_bins: int) -> Binning:
        x = np.asarray(reference, np.float64)
        if not len(x) or not np.isfinite(x).all() or n_bins < 1:
            raise StatsError("a binning needs finite values and a bin")
        return cls(float(x.min()), float(x.max()), n_bins)

    def bin(self, v) -> np.ndarray:
        v = np.asarray(v, np.float64)
        if self.hi <= self.lo:
            return np.zeros(v.shape, np.int64)
        t = ((v - self.lo) / (self.hi - self.lo)) * self.n_bins
        return np.clip(np.floor(np.where(t <= 0, 0.0, t)), 0, self.n_bins - 1).astype(np.int64)

    def histogram(self, values, weights) -> np.ndarray:
        b, w = self.bin(values), np.asarray(weights, np.float64)
        return np.array([psum(w[b == k]) for k in range(self.n_bins)])


def kl(p, q) -> float:
    p, q = np.asarray(p, np.float64), np.asarray(q, np.float64)
    with np.errstate(all="ignore"):
        return float(psum(np.where(p == 0, 0.0, p * detmath.ln(np.where(p == 0, 1.0, p / q)))))


def jsd(p, q) -> float:
    """In nats, 0 to ln 2."""
    p, q = np.asarray(p, np.float64), np.asarray(q, np.float64)
    if len(p) != len(q):
        raise StatsError("histograms differ in bins")
    tp, tq = psum(p), psum(q)
    if not (tp > 0 and tq > 0):
        raise StatsError("a histogram is empty")
    p, q = p / tp, q / tq
    mid = 0.5 * (p + q)
    return 0.5 * kl(p, mid) + 0.5 * kl(q, mid)


# ------------------------------------------------------- cuts and significance


def asimov_z(s: float, b: float) -> float | None:
    if not (np.isfinite(s) and np.isfinite(b)) or b <= 0 or s < 0:
        return None
    return float(np.sqrt(2.0 * max((s + b) * float(detmath.ln(1.0 + s / b)) - s, 0.0)))


@dataclass(frozen=True)
class Cut:
    threshold: float
    s: float
    b: float
    sig_eff: float
    bkg_eff: float


def cut_at_signal_efficiency(scores, labels, weights, target: float = 0.5) -> Cut:
    scores, labels, w = np.asarray(scores, np.float64), np.asarray(labels), np.asarray(weights, np.float64)
    if not len(scores) == len(labels) == len(w):
        raise StatsError("lengths differ")
    if not 0 < target <= 1:
        raise StatsError("the target is above 0 and at most 1")
    sig = labels == 1
    if not sig.any() or sig.all():
        raise StatsError("both classes are needed")
    total_s, total_b = psum(w[sig]), psum(w[~sig])
    if total_s <= 0 or total_b <= 0:
        raise StatsError("a class has no weight")
    order = argsort_desc(scores[sig])
    run = np.cumsum(w[sig][order])  # sequential
    reach = np.flatnonzero(run >= target * total_s)
    t = float(scores[sig][order[reach[0] if len(reach) else -1]])
    ok = scores >= t
    s, b = psum(w[sig & ok]), psum(w[~sig & ok])
    return Cut(t, float(s), float(b), float(s / total_s), float(b / total_b))


@dataclass(frozen=True)
class FrontierRow:
    lam: float
    threshold: float
    s: float
    b: float
    sig_eff: float
    bkg_eff: float
    z_asimov: float | None
    jsd: float | None
    dcorr2_bkg: float

    def value(self) -> dict:
        return {"lambda": self.lam, **{k: v for k, v in asdict(self).items() if k != "lam"}}


def evaluate(lam: float, scores, labels, weights, protected, n_bins: int = 20, target: float = 0.5) -> FrontierRow:
    scores, labels, w, m = np.asarray(scores, np.float64), np.asarray(labels), np.asarray(weights, np.float64), np.asarray(protected, np.float64)
    cut = cut_at_signal_efficiency(scores, labels, w, target)
    bkg = labels != 1
    bins = Binning.from_range(m[bkg], n_bins)
    after = bkg & (scores >= cut.threshold)
    pre, post = bins.histogram(m[bkg], w[bkg]), bins.histogram(m[after], w[after])
    return FrontierRow(float(lam), cut.threshold, cut.s, cut.b, cut.sig_eff, cut.bkg_eff, asimov_z(cut.s, cut.b), jsd(pre, post) if psum(post) > 0 else None, weighted_dcorr2(scores[bkg], m[bkg], w[bkg]))


@dataclass(frozen=True)
class Verdict:
    lambda_star: float
    delta_sigma: float | None
    delta_jsd: float | None
    result: bool


def verdict(rows: list[FrontierRow], lambda_star: float) -> Verdict:
    def one(lam: float) -> FrontierRow:
        own = [r for r in rows if r.lam == lam]
        if len(own) != 1:
            raise StatsError(f"lambda {lam} must occur once")
        return own[0]

    base, star = one(0.0), one(lambda_star)
    less = lambda a, b: None if a is None or b is None else a - b
    ds, dj = less(star.z_asimov, base.z_asimov), less(star.jsd, base.jsd)
    return Verdict(lambda_star, ds, dj, ds is not None and dj is not None and ds > 0 and dj <= 0)


def fixed6(x: float | None) -> str:
    if x is None:
        return "n/a"
    s = f"{x:.6f}"
    return "0.000000" if s == "-0.000000" else s


METHOD = "Asimov proxy, not a Wilks fit"
RULE = "delta_sigma > 0 AND delta_jsd <= 0"


@dataclass(frozen=True)
class Report:
    rows: list[FrontierRow]
    lambda_star: float
    config: dict = field(default_factory=dict)
    inputs: dict = field(default_factory=dict)
    namespace: str = NAMESPACE

    def json(self) -> str:
        v = verdict(self.rows, self.lambda_star)
        win = {"rule": RULE, "lambda_star": v.lambda_star, "delta_sigma": v.delta_sigma, "delta_jsd": v.delta_jsd, "result": "TRUE" if v.result else "FALSE"}
        return canonical({"config": self.config, "frontier": [r.value() for r in self.rows], "inputs": self.inputs, "kind": f"{self.namespace}.benchmark_report", "numerics_version": NUMERICS_VERSION, "significance_method": METHOD, "tier2_version": TIER2_VERSION, "win_condition": win}) + "\n"

    def markdown(self) -> str:
        v = verdict(self.rows, self.lambda_star)
        names = ["lambda", "threshold", "s", "b", "sig_eff", "bkg_eff", "z_asimov", "jsd", "dcorr2_bkg"]
        lines = ["# Benchmark report", "", f"Significance: {METHOD}.", "", "Configuration:", "", f"    {canonical(self.config)}", "", "Inputs:", "", f"    {canonical(self.inputs)}", "", "| " + " | ".join(names) + " |", "|" + "---:|" * len(names)]
        lines += ["| " + " | ".join(fixed6(r.value()[k]) for k in names) + " |" for r in self.rows]
        lines += ["", f"At lambda {fixed6(v.lambda_star)}: delta sigma {fixed6(v.delta_sigma)}, delta JSD {fixed6(v.delta_jsd)}; {RULE}.", "", f"Result: **{'TRUE' if v.result else 'FALSE'}**", ""]
        return "\n".join(lines)
