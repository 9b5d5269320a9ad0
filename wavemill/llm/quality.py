"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's features are hashed and binary: its words (A-Z lower-cased), how longer words
begin (their first 3, 4 and 5 bytes, so that inflected and compound forms of a word
that matters are known by those that were rated), the words' marks (which characters
other than letters they hold, and whether they hold letters), and words repeated at
once. One weight vector w serves all grades; with
thresholds t_1 < t_2 < ... the model is

    P(grade <= k) = 1 / (1 + exp(w . x - t_k)),

which gives an expected grade and the tail probability P(grade >= g) that selection
uses. Thresholds are kept ordered by fitting the logarithms of their gaps. Rated rows
count alike, so a text without any telling feature gets the grades' own frequencies; a
penalty keeps the weights of words small that tell little.

Grades come from the ratings: 0 toxic, 1 of low quality, 2 good. Only the sample of
rated rows is bounded: `sample` rows by order of a hash of the id. Scoring covers
every whole text in place, without a shuffle.

Defined results: null, empty or wordless text has no features and gets the grades of
the thresholds alone; where no rated row exists every row is kept with null
scores; of several ratings of one id the lowest grade counts; repeated rows and ties get
equal results; texts of any length are graded whole; an empty table gives no rows;
columns of the input with the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, U64, arrow_batches, free, mix, slices, utf8, words

BITS = 18
SIZE = 1 << BITS
#: Bytes at a word's beginning that are a feature of their own.
BEGINNINGS = (3, 4, 5)

_MARK = np.random.Generator(np.random.Philox(3)).integers(1, 1 << 62, 256).astype(U64)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, places): each text's distinct features, hashed to SIZE places."""
    w, at = words(data, offs)
    n = len(offs) - 1
    if not len(w):
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    full = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    start = full.copy()
    start[1:] &= ~full[:-1] | edge[1:-1]
    s = np.flatnonzero(start)
    letter = _LETTER[data]
    marks = np.add.reduceat(np.where(letter | ~full, U64(0), _MARK[LOWER[data]]), s)
    marks = mix(marks * U64(2) + np.logical_or.reduceat(letter, s).astype(U64) + U64(0xABCDEF))
    own = np.repeat(np.arange(n), np.diff(at))
    again = np.flatnonzero((w[1:] == w[:-1]) & (own[1:] == own[:-1]))
    places, owners = [w, marks, np.full(len(again), mix(np.array([77], U64))[0], U64)], [own, own, own[again]]
    stop = full.copy()
    stop[:-1] &= ~full[1:] | edge[1:-1]
    length = np.flatnonzero(stop) + 1 - s
    low = LOWER[data].astype(U64)
    for k in BEGINNINGS:
        some = length > k
        h = np.full(int(some.sum()), U64(1000003 * k))
        for i in range(k):
            h = (h ^ low[s[some] + i]) * U64(0x9FB21C651E98DF25)
            h ^= h >> U64(29)
        places.append(mix(h))
        owners.append(own[some])
    place, own = np.concatenate(places), np.concatenate(owners)
    key = np.unique((own << BITS) | (place >> U64(64 - BITS)).astype(np.int64))
    return np.searchsorted(key, np.arange(n + 1) << BITS), key & (SIZE - 1)


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1

    def score(self, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[place])])
        return (sums[at[1:]] - sums[at[:-1]]) / norm(at)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """(rows, grades - 1): P(grade >= 1), P(grade >= 2), ..."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))

    @classmethod
    def fit(cls, at: np.ndarray, place: np.ndarray, grade: np.ndarray, grades: int, *, steps: int = 200, rate: float = 0.1, l2: float = 1e-4) -> OrdinalModel:
        """Adam on the mean negative log-likelihood. Features of fewer than 3 rows
        keep weight 0."""
        rows = len(grade)
        own = np.repeat(np.arange(rows), np.diff(at))
        common = np.bincount(place, minlength=SIZE) >= min(3, max(1, rows // 4))
        keep = common[place]
        used, code = np.unique(place[keep], return_inverse=True)
        own, x = own[keep], 1 / norm(at)
        weight = np.full(rows, 1 / rows)
        p = np.concatenate([np.zeros(len(used)), [-1.0], np.zeros(grades - 2)])
        m, v = np.zeros(len(p)), np.zeros(len(p))
        for step in range(1, steps + 1):
            _, g = loss_and_gradient(p, own, code, x, grade, weight, grades, l2)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w = np.zeros(SIZE)
        w[used] = p[: len(used)]
        return cls(w, thresholds(p[len(used) :]))


def thresholds(p: np.ndarray) -> np.ndarray:
    """From the first one and the logarithms of the gaps: always in order."""
    return p[0] + np.concatenate([[0.0], np.cumsum(np.exp(p[1:]))])


def loss_and_gradient(p: np.ndarray, own: np.ndarray, code: np.ndarray, x: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int, l2: float) -> tuple[float, np.ndarray]:
    """Weighted negative log-likelihood of grades with a penalty on the weights, and its
    gradient, in p = (weights, first threshold, logarithms of the gaps). Row own[i] has
    the feature code[i]; a row's features all have its value of x."""
    rows, k = len(grade), grades - 1
    n = len(p) - k
    t = thresholds(p[n:])
    s = np.bincount(own, weights=p[code], minlength=rows) * x
    up = 1 / (1 + np.exp(-np.clip(s[:, None] - t, -60, 60)))  # P(grade > k)
    i = np.arange(rows)
    tail = np.concatenate([np.ones((rows, 1)), up, np.zeros((rows, 1))], 1)
    slope = np.concatenate([np.zeros((rows, 1)), up * (1 - up), np.zeros((rows, 1))], 1)
    like = np.maximum(tail[i, grade] - tail[i, grade + 1], 1e-12)
    above, below = slope[i, grade] / like, slope[i, grade + 1] / like
    ds = -weight * (above - below)
    dt = np.zeros(k)
    np.add.at(dt, grade[grade > 0] - 1, (weight * above)[grade > 0])
    np.add.at(dt, grade[grade < k], -(weight * below)[grade < k])
    loss = -(weight * np.log(like)).sum() + 0.5 * l2 * (p[:n] ** 2).sum()
    dw = np.bincount(code, weights=(ds * x)[own], minlength=n) + l2 * p[:n]
    return float(loss), np.concatenate([dw, [dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * np.exp(p[n + 1 :])])


def norm(at: np.ndarray) -> np.ndarray:
    """Long texts hold more features by chance; a mark of low grade should show
    in them all the same, so the divisor grows slowly."""
    return np.maximum(np.diff(at), 1) ** 0.25


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic", sample: int = 6000) -> OrdinalModel | None:
    """A model of a bounded sample of the rated rows that `docs` holds."""
    arrow_batches(docs.sparkSession)
    grade = F.when(F.col(toxic_col) == 1, 0).when(F.col(quality_col) == 1, 2).when(F.col(quality_col) == 0, 1)
    rated = labels.select(F.col(id_col).alias("id"), grade.alias("grade")).where("id is not null and grade is not null")
    rated = rated.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    few = rated.groupBy("id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(sample)
    rows = few.collect()
    few = docs.sparkSession.createDataFrame([(r.id, r.grade) for r in rows], f"id {dict(rated.dtypes)['id']}, grade int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            data, offs = utf8(t.column(2))
            for a, b in slices(offs):
                at, place = features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                blobs = [place[i:j].astype(np.uint32).tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.record_batch([t.column(0).slice(a, b - a), t.column(1).slice(a, b - a), pa.array(blobs, pa.binary())], names=["id", "grade", "blob"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(few), "id").select("id", "grade", "text")
    got = joined.mapInArrow(run, f"id {dict(rated.dtypes)['id']}, grade int, blob binary").collect()
    if not got:
        return None
    got = sorted(got, key=lambda r: (r.id, r.grade, bytes(r.blob)))
    parts = [np.frombuffer(bytes(r.blob), np.int32) for r in got]
    return OrdinalModel.fit(np.cumsum([0, *map(len, parts)]), np.concatenate(parts), np.array([r.grade for r in got]), 3)


def grade_quality(docs: DataFrame, model: OrdinalModel | None, *, text_col: str = "text", least: float = 0.5, new: tuple[str, str, str] = ("expected_grade", "tail_prob", "keep")) -> DataFrame:
    """`docs` with the expected grade, the tail probability (of the best grade) and
    whether that is `least` or more."""
    arrow_batches(docs.sparkSession)
    own = [f for f in docs.schema if f.name.lower() not in {c.lower() for c in new}]
    names, n = [f.name for f in own], len(own)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(*[F.col(f"`{c}`") for c in names], none.alias(new[0]), none.alias(new[1]), F.lit(True).alias(new[2]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for t in batches:
            data, offs = utf8(t.column(n))
            out = [model.tails(model.score(*features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]))) for a, b in slices(offs)]
            tail = np.concatenate(out) if out else np.zeros((0, model.grades - 1))
            yield pa.RecordBatch.from_arrays([*t.columns[:n], pa.array(tail.sum(1)), pa.array(tail[:, -1]), pa.array(tail[:, -1] >= least)], names=[*names, *new])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own)
    return docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").cast("string").alias(free(docs, "wm_text"))).mapInArrow(run, f"{fields}`{new[0]}` double, `{new[1]}` double, `{new[2]}` boolean")
