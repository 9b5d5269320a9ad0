"""The engine on numpy arrays, without Spark: for a batch that fits one process, with the
bits that the DataFrame operators give. Arrays of any layout and byte order, or lists,
are taken in logical order."""

from __future__ import annotations

import json
from typing import Any

import numpy as np

from .functions import anomaly, provenance, stats, training
from .functions.provenance import NUMERICS_VERSION, oid
from .plans import certificate, conformance, scattering
from .plans.certificate import issue as issue_certificate
from .plans.scattering import ScatterConfig, Scattering

conformance_selftest = conformance.selftest


def _binary32(x: Any) -> np.ndarray:
    return np.ascontiguousarray(np.asarray(x), dtype=np.float32)


def _config(config: dict | ScatterConfig, data_shape: tuple[int, ...] | None = None) -> ScatterConfig:
    """The signal's shape is the configuration's, else the last axes of the data; two
    axes where the configuration says so, or names a shape of two, or the data has a
    batch axis and two more."""
    if isinstance(config, ScatterConfig):
        return config
    own = config.get("shape")
    axes = len(own) if isinstance(own, (list, tuple)) else 1 if own is not None else 2 if len(data_shape or ()) >= 3 else 1
    dim = int(config.get("dim", axes))
    return ScatterConfig.parse({**config, "dim": dim}, None if data_shape is None else tuple(data_shape)[-dim:])


def _with_oid(x: np.ndarray, kind: str) -> tuple[np.ndarray, str]:
    return x, oid(provenance.tensor_bytes(x, kind))


def scatter(batch: Any, config: dict | ScatterConfig, backend: str = "cpu") -> tuple[np.ndarray, str]:
    """(coefficients (batch, paths, *positions), their identifier)."""
    x = _binary32(batch)
    plan = Scattering.compile(_config(config, x.shape))
    s = plan.run(x.reshape(-1, plan.cfg.signal_len), backend)
    return _with_oid(s.reshape(len(s), len(plan.paths), *plan.cfg.out_shape), "float32")


def scatter_paths(config: dict | ScatterConfig) -> list[dict]:
    return [{"order": p.order, "j": list(p.j), "theta": list(p.theta)} for p in Scattering.compile(_config(config)).paths]


def _coefficients(coeffs: Any, config: dict | ScatterConfig) -> tuple[Scattering, np.ndarray]:
    plan, s = Scattering.compile(_config(config)), _binary32(coeffs)
    return plan, s.reshape(-1, len(plan.paths), plan.cfg.out_len)


def r2(coeffs: Any, config: dict | ScatterConfig) -> tuple[np.ndarray, str]:
    plan, s = _coefficients(coeffs, config)
    return _with_oid(plan.ratio(s).reshape(len(s), -1, *plan.cfg.out_shape), "float32")


def fingerprint(coeffs: Any, config: dict | ScatterConfig) -> tuple[np.ndarray, str]:
    return _with_oid(scattering.log_mean(_coefficients(coeffs, config)[1]), "float64")


def fingerprint_clouds(coeffs: Any, config: dict | ScatterConfig) -> np.ndarray:
    """(batch, positions, paths)."""
    return scattering.clouds(_coefficients(coeffs, config)[1])


def dcorr2_w(x: Any, y: Any, w: Any = None) -> float:
    return stats.weighted_dcorr2(x, y, w)


def synthetic_dataset(n: int, d: int, seed: int, split: int = 0) -> dict:
    s = training.synthetic(n, d, seed, split)
    return {"x": s.x, "y": s.y, "w": s.w, "m": s.m, "oid": s.oid()}


def _dataset(x: Any, y: Any, w: Any = None, m: Any = None) -> training.Dataset:
    y = np.asarray(y, np.uint8)
    one = lambda v, default: np.full(len(y), default) if v is None else np.asarray(v, np.float64)
    return training.Dataset(np.asarray(x, np.float64), y, one(w, 1.0), one(m, 0.0))


def train_tag(x: Any, y: Any, w: Any = None, m: Any = None, **config) -> training.TaggerModel:
    """`m`, the protected variable, is needed where `lam` is not 0."""
    cfg = training.TrainConfig(**config)
    if cfg.lam != 0 and m is None:
        raise training.TrainError("m is needed where lam is not 0")
    return training.train(_dataset(x, y, w, m), cfg)


def calibrate(x: Any, t: Any, ridge_strength: float = 1e-4) -> dict:
    c = training.ridge(np.asarray(x, np.float64), np.asarray(t, np.float64), ridge_strength)
    return {"coef": c.coef, "bias": c.bias, "r2": c.r2, "residual_std": c.residual_std, "residuals": c.residuals, "residuals_oid": oid(c.residual_bytes()), "constants_json": c.constants()}


def anomaly_index(references: Any, *, tau: float, **config) -> anomaly.AnomalyIndex:
    """References: (clouds, points, dimensions), (clouds, dimensions) for clouds of one
    point, or a list of clouds."""
    return anomaly.AnomalyIndex(list(references), anomaly.AnomalyConfig(tau, **config))


def anomaly_query(index: anomaly.AnomalyIndex, queries: Any) -> dict:
    """kth_distance (NaN where there are fewer than k), nearest (-1 there), flagged, and
    the graph of references and queries as JSON."""
    queries = list(queries)
    found = index.detect(queries)
    k = index.cfg.k
    nearest = np.full((len(found), k), -1, np.int64)
    for row, d in zip(nearest, found):
        row[: len(d.neighbours)] = [i for _, i in d.neighbours]
    return {"kth_distance": np.array([np.nan if d.kth_distance is None else d.kth_distance for d in found]), "nearest": nearest, "flagged": np.array([d.flagged for d in found], bool), "graph_json": index.graph_json(queries)}


def bench_report(train: dict, evaluation: dict, *, lambdas: list[float], lambda_star: float, n_bins: int = 20, target_sig_eff: float = 0.5, **config) -> tuple[str, str]:
    """(JSON, Markdown) of a sweep over the strength of decorrelation."""
    from dataclasses import replace

    training.check_lambdas(lambdas, lambda_star)
    tr, ev = (_dataset(d["x"], d["y"], d.get("w"), d.get("m")) for d in (train, evaluation))
    cfg = training.TrainConfig(**config)
    models = [training.train(tr, replace(cfg, lam=float(v))) for v in lambdas]
    rows = [stats.evaluate(float(v), m.predict(ev.x), ev.y, ev.w, ev.m, n_bins, target_sig_eff) for v, m in zip(lambdas, models)]
    inputs = {"eval_events": len(ev.y), "eval_oid": ev.oid(), "features": tr.x.shape[1], "model_oids": [m.oid for m in models], "train_events": len(tr.y), "train_oid": tr.oid()}
    r = training.benchmark_report(lambdas, lambda_star, rows, cfg, inputs, n_bins, target_sig_eff)
    return r.json(), r.markdown()


def provenance_manifest(batch: Any, config: dict | ScatterConfig, coeffs_oid: str, *, backend: str = "cpu", backend_version: str = "", executor: str = "local", started_unix_ms: int | None = None, finished_unix_ms: int | None = None, namespace: str = provenance.NAMESPACE) -> tuple[str, str]:
    """(JSON, hash) of a scattering run; who ran it, and when, is not hashed."""
    x = _binary32(batch)
    plan = Scattering.compile(_config(config, x.shape))
    if not provenance.is_oid(coeffs_oid):
        raise ValueError(f"{coeffs_oid} is no identifier")
    clock = None if started_unix_ms is None or finished_unix_ms is None else (started_unix_ms, finished_unix_ms)
    execution = provenance.Execution(backend, backend_version, "", executor, clock)
    m = provenance.scattering_manifest(plan, x.size // plan.cfg.signal_len, oid(provenance.tensor_bytes(x, "float32")), coeffs_oid, execution, namespace)
    return m.to_json(), m.manifest_hash()


def verify_certificate(certificate_json: str, inputs_dir: str) -> dict:
    got = certificate.verify(certificate_json, inputs_dir)
    return {"verified": got.verified, "manifest_hash_ok": got.manifest_hash_ok, "outputs": [{"name": n, "ok": ok} for n, ok in got.outputs], "error": got.error}


def conformance_report(subset: str = "quick") -> str:
    return json.dumps(conformance.selftest(subset=subset), sort_keys=True)


__all__ = ["NUMERICS_VERSION", "anomaly_index", "anomaly_query", "bench_report", "calibrate", "conformance_report", "conformance_selftest", "dcorr2_w", "fingerprint", "fingerprint_clouds", "issue_certificate", "oid", "provenance_manifest", "r2", "scatter", "scatter_paths", "synthetic_dataset", "train_tag", "verify_certificate"]
