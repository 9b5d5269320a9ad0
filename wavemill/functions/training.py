"""Small decorrelated classifiers, their sweep over the decorrelation strength, and
ridge calibration. Minibatch training is sequential: its order is the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import detmath, stats
from .provenance import NAMESPACE, canonical, oid, tensor_bytes
from .rng import STREAM_EPOCH, STREAM_HEAD, STREAM_SYNTHETIC, Stream, normal
from .sums import psum


class TrainError(ValueError):
    pass


@dataclass(frozen=True)
class Dataset:
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    m: np.ndarray

    def __post_init__(self):
        n = len(self.y)
        if self.x.ndim != 2 or not len(self.x) == n == len(self.w) == len(self.m):
            raise TrainError("lengths differ")
        if not np.isin(self.y, (0, 1)).all():
            raise TrainError("labels are 0 or 1")
        if not all(np.isfinite(a).all() for a in (self.x, self.w, self.m)) or (self.w < 0).any():
            raise TrainError("values are finite and weights not negative")

    def canonical_bytes(self) -> bytes:
        return b"".join([tensor_bytes(self.x, "float64"), tensor_bytes(self.y, "uint8"), tensor_bytes(self.w, "float64"), tensor_bytes(self.m, "float64")])

    def oid(self) -> str:
        return oid(self.canonical_bytes())


def synthetic_rows(first: int, n: int, d: int, seed: int, split: int = 0) -> Dataset:
    """Events first .. first + n - 1 of a labelled sample. Every event takes the
    same number of words of the stream, so any range can be made alone."""
    if d < 2:
        raise TrainError("the sample has at least two features")
    per = 4 * d + 6
    s = Stream(seed, (STREAM_SYNTHETIC + split) & ((1 << 64) - 1), first * per)
    w = s.next_u32(n * per).reshape(n, per)
    unit = lambda k: ((w[:, k] | (w[:, k + 1] << np.uint64(32))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    gauss = lambda k: normal(np.stack([unit(k), unit(k + 2)], 1).ravel())
    sig = unit(0) < 0.3
    # signal: u, z, features; background: u, u', features, u''
    m = np.where(sig, 120.0 + 8.0 * gauss(2), 50.0 + 150.0 * unit(2))
    z = np.stack([np.where(sig, gauss(6 + 4 * j), gauss(4 + 4 * j)) for j in range(d)], 1)
    x = z.copy()
    x[:, 0] = np.where(sig, 1.0, 0.0) + z[:, 0]
    x[:, 1] = 0.04 * (m - 100.0) + z[:, 1]
    weight = np.where(sig, 1.0, 0.5 + unit(4 + 4 * d))
    return Dataset(x, sig.astype(np.uint8), weight, m)


def synthetic(n: int, d: int, seed: int, split: int = 0) -> Dataset:
    return synthetic_rows(0, n, d, seed, split)


# -------------------------------------------------------------------- features


@dataclass(frozen=True)
class Standardizer:
    mu: np.ndarray
    std: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray) -> Standardizer:
        n = len(x)
        if not n:
            raise TrainError("no events")
        mu = psum(x.T) / n
        d = (x - mu).T
        return cls(mu, np.sqrt(psum(d * d) / n) + 1e-8)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mu) / self.std


def dot(x: np.ndarray, w: np.ndarray, start=0.0) -> np.ndarray:
    """Sequential dot products of rows with w, from `start`."""
    total = np.zeros(len(x)) + start
    for j in range(x.shape[1]):
        total = total + x[:, j] * w[j]
    return total


# ----------------------------------------------------------------------- heads


@dataclass(frozen=True)
class HeadKind:
    hidden: int = 0

    @classmethod
    def parse(cls, name: str) -> HeadKind:
        if name == "logistic":
            return cls()
        if name.startswith("mlp") and name[3:].isdigit() and int(name[3:]) > 0:
            return cls(int(name[3:]))
        raise TrainError(f"no head {name}")

    @property
    def name(self) -> str:
        return f"mlp{self.hidden}" if self.hidden else "logistic"


@dataclass
class Head:
    kind: HeadKind
    d: int
    p: np.ndarray

    @classmethod
    def init(cls, kind: HeadKind, d: int, seed: int) -> Head:
        s = Stream(seed, STREAM_HEAD)
        if not kind.hidden:
            return cls(kind, d, np.concatenate([[0.0], 0.01 * s.next_normal(d)]))
        h = kind.hidden
        w1 = np.sqrt(1.0 / d) * s.next_normal(h * d)
        w2 = np.sqrt(1.0 / h) * s.next_normal(h)
        return cls(kind, d, np.concatenate([w1, np.zeros(h), w2, [0.0]]))

    def _parts(self):
        h, d = self.kind.hidden, self.d
        return self.p[: h * d].reshape(h, d), self.p[h * d : h * d + h], self.p[h * d + h : h * d + 2 * h], self.p[-1]

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        w1, b1, _, _ = self._parts()
        return np.stack([detmath.tanh(b1[k] + dot(x, w1[k])) for k in range(self.kind.hidden)], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        if not self.kind.hidden:
            return self.p[0] + dot(x, self.p[1:])
        _, _, w2, b2 = self._parts()
        t, z = self._hidden(x), np.zeros(len(x)) + b2
        for k in range(self.kind.hidden):
            z = z + w2[k] * t[:, k]
        return z

    def logit_grad(self, x: np.ndarray) -> np.ndarray:
        """(rows, parameters)."""
        if not self.kind.hidden:
            return np.concatenate([np.ones((len(x), 1)), x], 1)
        _, _, w2, _ = self._parts()
        t = self._hidden(x)
        back = w2 * (1.0 - t * t)
        return np.concatenate([(back[:, :, None] * x[:, None, :]).reshape(len(x), -1), back, t, np.ones((len(x), 1))], 1)


@dataclass
class Adam:
    lr: float
    n: int

    def __post_init__(self):
        self.m, self.v = np.zeros(self.n), np.zeros(self.n)
        self.b1 = self.b2 = 1.0

    def step(self, p: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.b1, self.b2 = self.b1 * 0.9, self.b2 * 0.999
        self.m = 0.9 * self.m + (1.0 - 0.9) * g
        self.v = 0.999 * self.v + (1.0 - 0.999) * (g * g)
        mh, vh = self.m / (1.0 - self.b1), self.v / (1.0 - self.b2)
        return p - (self.lr * mh) / (np.sqrt(vh) + 1e-8)


# -------------------------------------------------------------------- training


@dataclass(frozen=True)
class TrainConfig:
    head: str = "logistic"
    epochs: int = 20
    batch_size: int = 256
    lr: float = 0.01
    lam: float = 0.0
    gradient: str = "exact"
    seed: int = 0

    def __post_init__(self):
        HeadKind.parse(self.head)
        if self.gradient not in ("exact", "pearson_proxy"):
            raise TrainError("gradient is exact or pearson_proxy")
        if self.epochs < 0 or self.batch_size < 1 or not np.isfinite(self.lam) or not self.lr > 0:
            raise TrainError("bad training configuration")


def batch_step(head: Head, x, y, w, m, cfg: TrainConfig) -> tuple[float, np.ndarray]:
    """Loss of a minibatch of standardized rows, and its gradient."""
    total = psum(w)
    if not total > 0:
        return 0.0, np.zeros(len(head.p))
    v = w / total
    z = head.logit(x)
    prob = detmath.sigmoid(z)
    loss = float(psum(v * (detmath.softplus(z) - y * z)))
    dz = v * (prob - y)
    bkg = np.flatnonzero(y == 0)
    if cfg.lam != 0 and len(bkg) >= 2 and psum(w[bkg]) > 0:
        s = prob[bkg]
        if cfg.gradient == "exact":
            value, g = stats.dcorr2_grad(s, m[bkg], w[bkg])
            loss = loss + cfg.lam * value
        else:
            g = stats.pearson_proxy_grad(s, m[bkg], w[bkg])
        dz[bkg] = dz[bkg] + ((cfg.lam * g) * s) * (1.0 - s)
    return loss, psum((dz[:, None] * head.logit_grad(x)).T)


@dataclass(frozen=True)
class TaggerModel:
    head: Head
    standardizer: Standardizer
    epoch_loss: np.ndarray

    @property
    def params(self) -> np.ndarray:
        return self.head.p

    @property
    def mu(self) -> np.ndarray:
        return self.standardizer.mu

    @property
    def std(self) -> np.ndarray:
        return self.standardizer.std

    def canonical_bytes(self) -> bytes:
        return b"".join(tensor_bytes(a, "float64") for a in (self.mu, self.std, self.params, self.epoch_loss))

    @property
    def oid(self) -> str:
        return oid(self.canonical_bytes())

    def predict(self, x: np.ndarray) -> np.ndarray:
        return detmath.sigmoid(self.head.logit(self.standardizer.apply(np.asarray(x, np.float64))))


def train(data: Dataset, cfg: TrainConfig) -> TaggerModel:
    n = len(data.y)
    if not n:
        raise TrainError("no events")
    st = Standardizer.fit(data.x)
    x, y = st.apply(data.x), data.y.astype(np.float64)
    head = Head.init(HeadKind.parse(cfg.head), data.x.shape[1], cfg.seed)
    adam, losses = Adam(cfg.lr, len(head.p)), []
    for e in range(cfg.epochs):
        order = Stream(cfg.seed, STREAM_EPOCH + e).permutation(n)
        batch = []
        for a in range(0, n, cfg.batch_size):
            k = order[a : a + cfg.batch_size]
            loss, g = batch_step(head, x[k], y[k], data.w[k], data.m[k], cfg)
            head.p = adam.step(head.p, g)
            batch.append(loss)
        losses.append(psum(np.array(batch)) / len(batch))
    return TaggerModel(head, st, np.array(losses))


def check_lambdas(lambdas: list[float], lambda_star: float) -> None:
    if list(lambdas).count(0) != 1 or lambda_star not in lambdas:
        raise TrainError("the sweep holds 0 once, and lambda_star")


def benchmark_report(lambdas, lambda_star, rows, cfg: TrainConfig, inputs: dict, n_bins: int, target: float, namespace: str = NAMESPACE) -> stats.Report:
    config = {"batch_size": cfg.batch_size, "epochs": cfg.epochs, "gradient": cfg.gradient, "head": cfg.head, "lambda_star": lambda_star, "lambdas": list(lambdas), "lr": cfg.lr, "n_bins": n_bins, "seed": str(cfg.seed), "target_sig_eff": target}
    return stats.Report(rows, lambda_star, config, inputs, namespace)


# ----------------------------------------------------------------- calibration


def cholesky(a: np.ndarray) -> np.ndarray:
    n = len(a)
    low = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1):
            s = a[i, j]
            for k in range(j):
                s = s - low[i, k] * low[j, k]
            if i == j:
                if not s > 0:
                    raise TrainError("the matrix is not positive definite")
                low[i, i] = np.sqrt(s)
            else:
                low[i, j] = s / low[j, j]
    return low


def cholesky_solve(low: np.ndarray, c: np.ndarray) -> np.ndarray:
    n = len(c)
    y, w = np.zeros(n), np.zeros(n)
    for i in range(n):
        s = c[i]
        for k in range(i):
            s = s - low[i, k] * y[k]
        y[i] = s / low[i, i]
    for i in range(n - 1, -1, -1):
        s = y[i]
        for k in range(i + 1, n):
            s = s - low[k, i] * w[k]
        w[i] = s / low[i, i]
    return w


@dataclass(frozen=True)
class Calibration:
    coef: np.ndarray
    bias: float
    r2: float
    residual_std: float
    residuals: np.ndarray | None  # not held where a table was fitted in place
    mu: np.ndarray
    std: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        return dot((np.asarray(x, np.float64) - self.mu) / self.std, self.coef) + self.bias

    def residual_bytes(self) -> bytes:
        if self.residuals is None:
            raise TrainError("residuals are not held")
        return tensor_bytes(self.residuals, "float64")

    def constants(self, namespace: str = NAMESPACE) -> str:
        own = {} if self.residuals is None else {"residuals_oid": oid(self.residual_bytes())}
        return canonical({"bias": self.bias, "coef": self.coef.tolist(), "kind": f"{namespace}.calibration", "mu": self.mu.tolist(), "r2": self.r2, "residual_std": self.residual_std, "std": self.std.tolist(), **own})


def ridge(x: np.ndarray, t: np.ndarray, strength: float = 1e-4) -> Calibration:
    x, t = np.asarray(x, np.float64), np.asarray(t, np.float64)
    n, d = x.shape
    st = Standardizer.fit(x)
    z = st.apply(x)
    g = np.array([[psum(z[:, i] * z[:, j]) for j in range(d)] for i in range(d)])
    g[np.arange(d), np.arange(d)] += strength
    coef = cholesky_solve(cholesky(g), np.array([psum(z[:, j] * t) for j in range(d)]))
    fit = dot(z, coef)
    bias = float(psum(t) / n - psum(fit) / n)
    res = t - (fit + bias)
    spread = t - psum(t) / n
    r2 = float(1.0 - psum(res * res) / (psum(spread * spread) + 1e-12))
    mean = psum(res) / n
    return Calibration(coef, bias, r2, float(np.sqrt(psum((res - mean) ** 2) / n)), res, st.mu, st.std)
