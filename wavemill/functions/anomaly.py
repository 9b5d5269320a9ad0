"""Sliced Wasserstein distances between point clouds, a deterministic HNSW index, and
detection by the distance to the k-th neighbour.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np

from . import detmath
from .provenance import NUMERICS_VERSION, TIER2_VERSION, canonical, digest
from .rng import STREAM_DIRECTIONS, STREAM_LAYOUT, STREAM_LEVELS, Stream
from .sums import order_key, psum

TOP_LEVEL = 16


class AnomalyError(ValueError):
    pass


def cloud(points) -> np.ndarray:
    """(points, dimensions), finite and not empty; a vector is one point."""
    x = np.atleast_2d(np.asarray(points, np.float64))
    if x.ndim != 2 or not x.size or not np.isfinite(x).all():
        raise AnomalyError("a cloud has points, all finite")
    return x


def directions(dim: int, count: int, seed: int = 0) -> np.ndarray:
    g = Stream(seed, STREAM_DIRECTIONS).next_normal(count * dim).reshape(count, dim)
    norm = np.sqrt(psum(g * g))
    out = g / np.where(norm == 0, 1.0, norm)[:, None]
    out[norm == 0] = 0.0
    out[norm == 0, 0] = 1.0
    return out


def project(points: np.ndarray, dirs: np.ndarray) -> np.ndarray:
    """(directions, points): sorted projections; sums run over dimensions in turn."""
    total = np.zeros((len(dirs), len(points)))
    for c in range(points.shape[1]):
        total = total + points[None, :, c] * dirs[:, c, None]
    return np.take_along_axis(total, np.argsort(order_key(total), axis=1, kind="stable"), 1)


def w1_sorted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Wasserstein-1 of sorted samples along the last axis, merged with `a` first
    on ties."""
    n, m = a.shape[-1], b.shape[-1]
    z = np.concatenate([a, b], -1)
    order = np.argsort(z, axis=-1, kind="stable")
    z = np.take_along_axis(z, order, -1)
    i = np.cumsum(order < n, -1)
    j = np.arange(1, n + m + 1) - i
    gap = np.abs(i * m - j * n)[..., :-1] / float(n * m)
    return psum(gap * np.diff(z, axis=-1))


def sw1(a: np.ndarray, b: np.ndarray) -> float:
    """Of two projected clouds."""
    return float(psum(w1_sorted(a, b)) / len(a))


@dataclass(frozen=True)
class HnswConfig:
    m: int = 8
    ef_construction: int = 64
    ef_search: int = 32
    seed: int = 0


@dataclass
class Hnsw:
    """Built one node at a time, in order; `distance(i, j)` is between nodes."""

    cfg: HnswConfig
    levels: list[int] = field(default_factory=list)
    links: list[list[list[int]]] = field(default_factory=list)
    entry: int = -1
    top: int = -1

    @classmethod
    def build(cls, n: int, distance, cfg: HnswConfig = HnswConfig()) -> Hnsw:
        g = cls(cfg)
        u = 1.0 - Stream(cfg.seed, STREAM_LEVELS).next_f64_unit(n) if n else np.zeros(0)
        scale = 1.0 / float(detmath.ln(float(cfg.m)))
        level = np.minimum(np.floor(-detmath.ln(u) * scale), TOP_LEVEL).astype(int).tolist() if n else []
        for i in range(n):
            g._insert(i, level[i], distance)
        return g

    def max_links(self, layer: int) -> int:
        return 2 * self.cfg.m if layer == 0 else self.cfg.m

    def _search(self, dq, entries: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """Nearest found, ascending by (distance, id)."""
        seen = {i for _, i in entries}
        todo, best = sorted(entries), sorted(entries)
        while todo:
            d, i = todo.pop(0)
            if len(best) >= ef and (d, i) > best[-1]:
                break
            for j in self.links[i][layer]:
                if j in seen:
                    continue
                seen.add(j)
                e = (dq(j), j)
                if len(best) < ef or e < best[-1]:
                    bisect.insort(todo, e)
                    bisect.insort(best, e)
                    if len(best) > ef:
                        best.pop()
        return best

    def _descend(self, dq, down_to: int) -> list[tuple[float, int]]:
        at = [(dq(self.entry), self.entry)]
        for layer in range(self.top, down_to, -1):
            at = self._search(dq, at, 1, layer)[:1]
        return at

    def _insert(self, i: int, level: int, distance) -> None:
        self.levels.append(level)
        self.links.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry, self.top = i, level
            return
        known: dict[int, float] = {}

        def dq(j: int) -> float:
            if j not in known:
                known[j] = distance(i, j)
            return known[j]

        at = self._descend(dq, level)
        for layer in range(min(level, self.top), -1, -1):
            at = self._search(dq, at, self.cfg.ef_construction, layer)
            near = [j for _, j in at[: self.cfg.m]]
            self.links[i][layer] = near[:]
            for j in near:
                own = self.links[j][layer]
                own.append(i)
                if len(own) > self.max_links(layer):
                    self.links[j][layer] = [k for _, k in sorted((distance(j, k), k) for k in own)[: self.max_links(layer)]]
        if level > self.top:
            self.entry, self.top = i, level

    def knn(self, dq, k: int) -> list[tuple[float, int]]:
        if self.entry < 0 or k < 1:
            return []
        return self._search(dq, self._descend(dq, 0), max(self.cfg.ef_search, k), 0)[:k]

    def layer0_edges(self) -> list[tuple[int, int]]:
        return sorted({(min(i, j), max(i, j)) for i, ls in enumerate(self.links) for j in ls[0]})

    def graph_bytes(self) -> bytes:
        out = [len(self.levels), max(self.entry, 0), max(self.top, 0)]
        for level, ls in zip(self.levels, self.links):
            out.append(level)
            for own in ls:
                out += [len(own), *own]
        return np.array(out, "<u4").tobytes()


@dataclass(frozen=True)
class AnomalyConfig:
    tau: float
    k: int = 10
    directions: int = 32
    m: int = 8
    ef_construction: int = 64
    ef_search: int = 32
    layout_iterations: int = 100
    seed: int = 0

    def __post_init__(self):
        if self.k < 1 or not np.isfinite(self.tau):
            raise AnomalyError("k is at least 1 and tau is finite")
        if self.m < 2 or min(self.directions, self.ef_construction, self.ef_search) < 1:
            raise AnomalyError("bad index configuration")

    def value(self) -> dict:
        return {"directions": self.directions, "distance": "sliced_wasserstein_1", "ef_construction": self.ef_construction, "ef_search": self.ef_search, "fingerprint": "log_coefficients_per_position", "k": self.k, "layout_iterations": self.layout_iterations, "m": self.m, "seed": str(self.seed), "tau": self.tau}

    def digest(self) -> str:
        return digest(self.value())


@dataclass(frozen=True)
class Detection:
    neighbours: list[tuple[float, int]]
    kth_distance: float | None
    flagged: bool


class AnomalyIndex:
    def __init__(self, references: list, cfg: AnomalyConfig):
        clouds = [cloud(c) for c in references]
        if not clouds or len({c.shape[1] for c in clouds}) != 1:
            raise AnomalyError("references have one dimension")
        self.cfg = cfg
        self.dirs = directions(clouds[0].shape[1], cfg.directions, cfg.seed)
        self.projected = [project(c, self.dirs) for c in clouds]
        self.hnsw = Hnsw.build(len(clouds), self.distance, HnswConfig(cfg.m, cfg.ef_construction, cfg.ef_search, cfg.seed))

    def __len__(self) -> int:
        return len(self.projected)

    def distance(self, i: int, j: int) -> float:
        return sw1(self.projected[i], self.projected[j])

    def _of(self, query) -> np.ndarray:
        q = cloud(query)
        if q.shape[1] != self.dirs.shape[1]:
            raise AnomalyError("a query has the references' dimension")
        return project(q, self.dirs)

    def knn(self, query, k: int | None = None) -> list[tuple[float, int]]:
        q = self._of(query)
        return self.hnsw.knn(lambda j: sw1(q, self.projected[j]), k or self.cfg.k)

    def _rule(self, near: list[tuple[float, int]]) -> Detection:
        kth = near[self.cfg.k - 1][0] if len(near) >= self.cfg.k else None
        return Detection(near, kth, kth is not None and kth > self.cfg.tau)

    def detect(self, queries: list) -> list[Detection]:
        return [self._rule(self.knn(q)) for q in queries]

    def detect_self(self) -> list[Detection]:
        """Each reference against the others."""
        out = []
        for i, q in enumerate(self.projected):
            near = self.hnsw.knn(lambda j: sw1(q, self.projected[j]), self.cfg.k + 1)  # noqa: B023
            out.append(self._rule([e for e in near if e[1] != i][: self.cfg.k]))
        return out

    def graph_bytes(self) -> bytes:
        return self.hnsw.graph_bytes()

    def graph(self, queries: list = ()) -> dict:
        """Nodes with positions and flags, edges with distances; no features."""
        own, other = self.detect_self(), self.detect(list(queries))
        n = len(self)
        edges = [(i, j, self.distance(i, j)) for i, j in self.hnsw.layer0_edges()]
        edges += [(r, n + q, d) for q, det in enumerate(other) for d, r in det.neighbours]
        at = spring_layout(n + len(other), [(i, j) for i, j, _ in edges], self.cfg.layout_iterations, self.cfg.seed)
        nodes = [{"flagged": d.flagged, "id": k, "x": float(x), "y": float(y)} for k, (d, (x, y)) in enumerate(zip([*own, *other], at))]
        return {"config_digest": self.cfg.digest(), "edges": [{"i": i, "j": j, "sw1": d} for i, j, d in edges], "nodes": nodes, "numerics_version": NUMERICS_VERSION, "tau": self.cfg.tau, "tier2_version": TIER2_VERSION}

    def graph_json(self, queries: list = ()) -> str:
        return canonical(self.graph(queries)) + "\n"


def spring_layout(n: int, edges: list[tuple[int, int]], iterations: int, seed: int) -> np.ndarray:
    """Fruchterman and Reingold's layout in the unit square."""
    at = Stream(seed, STREAM_LAYOUT).next_f64_unit(2 * n).reshape(n, 2)
    if n == 0:
        return at
    k = np.sqrt(1.0 / n)
    for t in range(iterations):
        temperature = 0.1 * (1.0 - t / iterations)
        move = np.zeros((n, 2))
        for j in range(n):  # sums run in ascending j
            d = at - at[j]
            r = np.maximum(np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]), 1e-9)
            f = (k * k) / r
            step = (d / r[:, None]) * f[:, None]
            step[j] = 0.0
            move = move + step
        for i, j in edges:
            d = at[i] - at[j]
            r = max(float(np.sqrt(d[0] * d[0] + d[1] * d[1])), 1e-9)
            step = (d / r) * ((r * r) / k)
            move[i] = move[i] - step
            move[j] = move[j] + step
        r = np.maximum(np.sqrt(move[:, 0] * move[:, 0] + move[:, 1] * move[:, 1]), 1e-9)
        at = np.clip(at + (move / r[:, None]) * np.minimum(r, temperature)[:, None], 0.0, 1.0)
    return at
