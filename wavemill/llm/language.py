"""Language ID by string kernels.

The kernel of two texts is the number of n-grams (bytes of UTF-8, n = 1 to 4, ASCII
lower-cased, all ASCII that is no letter as one space) that both hold, over the
root of the product of their numbers: a blended-spectrum presence kernel, on
n-grams hashed to 2^15 places. Landmarks z_1..z_m from the training sample give
the Nystroem map k(x, Z) K_ZZ^(-1/2), on which one ridge regression per language
(one versus rest, targets -1 and 1) is fitted.

As k(x, z) is an inner product of presence vectors, scoring a batch is a product of
its presence matrix with one matrix that holds landmarks, map and regression
weights; whole texts are scored, in place, without a shuffle.

Only the sample of labelled rows is bounded: `per_language` rows of each language
by order of a hash of the id. A language with fewer rows gives all it has. How far the
order is followed is known from counts of ranges of the hash, so that no task sees
more than the sample and one range.

Defined results: null text, or text without any letter, is `und` with score 0; so
is everything where no labelled row exists; ties go to the language that is first
by name; repeated rows get equal results; long texts are scored whole; an empty table
gives no rows; columns of the input with the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, free, slices, utf8

ORDERS = 4
BITS = 15
SIZE = 1 << BITS
#: From scores of the regressions, about -1 to 1, to shares.
SHARPNESS = 6.0
#: Ranges of the hash by which the sample is ordered.
RANGES = 4096

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)


def presence(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, SIZE) flags of the hashed n-grams of each text."""
    n = len(offs) - 1
    flags = np.zeros(n * SIZE, bool)
    b = _FOLD[data].astype(np.uint32)
    own = np.repeat(np.arange(n, dtype=np.int64) * SIZE, np.diff(offs))
    h = np.zeros(len(b), np.uint32)
    for k in range(min(ORDERS, len(b))):
        m = len(b) - k
        h = h[:m] * np.uint32(0x01000193) + b[k:] + np.uint32(1)
        place = (h * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)
        if k:
            inside = own[:m] == own[k:]
            flags[own[:m][inside] + place[inside]] = True
        else:
            flags[own + place] = True
    return flags.reshape(n, SIZE)


def normed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: (SIZE, languages): landmarks times map times regression weights.
    weights: np.ndarray

    def scores(self, flags: np.ndarray) -> np.ndarray:
        return normed(flags) @ self.weights

    @classmethod
    def fit(cls, bits: np.ndarray, langs: np.ndarray, *, landmarks: int = 192, ridge: float = 1e-3) -> LanguageModel:
        """bits: (rows, SIZE / 8) packed flags. Rows are unpacked a few at a time;
        only the landmarks are held as floats."""
        names = tuple(sorted(set(langs.tolist())))
        rows = lambda k: normed(np.unpackbits(bits[k], axis=1))
        # Landmarks in turn from each language.
        turn = np.zeros(len(langs), np.int64)
        for name in names:
            own = langs == name
            turn[own] = np.arange(own.sum())
        z = rows(np.argsort(turn, kind="stable")[:landmarks])
        val, vec = np.linalg.eigh((z @ z.T).astype(np.float64))
        val = np.where(val > 1e-6 * val.max(), val, np.inf)
        root = (vec / np.sqrt(val)) @ vec.T
        phi = np.concatenate([rows(slice(k, k + 128)) @ z.T for k in range(0, len(bits), 128)]).astype(np.float64) @ root
        y = np.where(langs[:, None] == np.array(names)[None, :], 1.0, -1.0)
        # Each language weighs the same, however many rows it has.
        w = (1 / np.maximum((y > 0).sum(0), 1))[np.argmax(y, 1)]
        a = np.linalg.solve(phi.T @ (phi * w[:, None]) + ridge * np.eye(len(z)), phi.T @ (y * w[:, None]))
        return cls(names, (z.T.astype(np.float64) @ (root @ a)).astype(np.float32))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, landmarks: int = 192) -> LanguageModel | None:
    """A model of a bounded sample of labelled rows that are not held out."""
    arrow_batches(docs.sparkSession)
    lang = F.col(lang_col).cast("string")
    k = F.shiftrightunsigned(F.xxhash64(F.lit(2), F.col(id_col)), 1)
    rows = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), k.alias("k"), F.floor(k * F.lit(RANGES * 2.0**-63)).cast("int").alias("range")).where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    upto = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    enough = rows.groupBy("lang", "range").count().withColumn("before", F.coalesce(F.sum("count").over(upto), F.lit(0))).where(F.col("before") < per_language)
    near = rows.join(enough.select("lang", "range"), ["lang", "range"], "left_semi")
    first = Window.partitionBy("lang").orderBy("range", "k", "id")
    chosen = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language).select("id")
    ids = sorted({r.id for r in chosen.collect()})
    few = docs.sparkSession.createDataFrame([(i,) for i in ids], f"id {dict(rows.dtypes)['id']}")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            data, offs = utf8(t.column(2))
            for a, b in slices(offs, 1 << 20):
                bits = np.packbits(presence(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]), axis=1)
                yield pa.record_batch([t.column(0).slice(a, b - a), t.column(1).slice(a, b - a), pa.array([x.tobytes() for x in bits], pa.binary())], names=["id", "lang", "bits"])

    texts = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    got = texts.join(F.broadcast(few), "id", "left_semi").mapInArrow(features, f"id {dict(rows.dtypes)['id']}, lang string, bits binary").collect()
    if not got:
        return None
    got = sorted(got, key=lambda r: (r.id, r.lang, bytes(r.bits)))
    bits = np.frombuffer(b"".join(bytes(r.bits) for r in got), np.uint8).reshape(len(got), SIZE // 8)
    return LanguageModel.fit(bits, np.array([r.lang for r in got]), landmarks=landmarks)


def predict_language(docs: DataFrame, model: LanguageModel | None, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """`docs` with the predicted language and its share of the scores."""
    arrow_batches(docs.sparkSession)
    keep = [f for f in docs.schema if f.name.lower() not in (lang_out.lower(), score_out.lower())]
    names, n = [f.name for f in keep], len(keep)
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in names], F.lit("und").alias(lang_out), F.lit(0.0).alias(score_out))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for t in batches:
            data, offs = utf8(t.column(n))
            langs: list[str] = []
            share: list[np.ndarray] = []
            for a, b in slices(offs, 1 << 18):
                for c in range(a, b, 64):
                    d = min(b, c + 64)
                    f = model.scores(presence(data[offs[c] : offs[d]], offs[c : d + 1] - offs[c])).astype(np.float64)
                    e = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
                    best = np.argmax(f, 1)
                    langs += [model.languages[k] for k in best.tolist()]
                    share.append(e[np.arange(d - c), best] / e.sum(1))
            ok = t.column(n + 1).to_pylist()
            score = np.where(ok, np.concatenate(share), 0.0) if share else np.zeros(0)
            lang = [x if y else "und" for x, y in zip(langs, ok)]
            yield pa.RecordBatch.from_arrays([*t.columns[:n], pa.array(lang, pa.string()), pa.array(score)], names=[*names, lang_out, score_out])

    text = F.col(f"`{text_col}`").cast("string")
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return docs.select(*[F.col(f"`{c}`") for c in names], text.alias(free(docs, "wm_text")), letter.alias(free(docs, "wm_letter"))).mapInArrow(run, f"{fields}`{lang_out}` string, `{score_out}` double")
