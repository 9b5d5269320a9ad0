"""Language ID and quality: held-out accuracy, and cases without a model."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import language, quality
from wavemill.llm.queries import op2_language_id, op3_quality_classifier

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sf():
    import os

    if not os.path.isdir(SF):
        pytest.skip("test tables are absent")
    return SF


def kernel(a: str, b: str) -> float:
    def grams(t):
        t = bytes(c + 32 if 65 <= c < 91 else c if c >= 128 or 97 <= c < 123 else 32 for c in t.encode())
        return {t[i : i + k] for k in range(1, 5) for i in range(len(t) - k + 1)}

    x, y = grams(a), grams(b)
    return len(x & y) / (len(x) * len(y)) ** 0.5


def test_presence_is_the_kernel():
    texts = ["Hello World", "hello there, world", "Größe und Maß", "x"]
    b = [t.encode() for t in texts]
    x = language.normed(language.presence(np.frombuffer(b"".join(b), np.uint8), np.cumsum([0, *map(len, b)])))
    got = x @ x.T
    want = [[kernel(s, t) for t in texts] for s in texts]
    assert np.allclose(got, want, atol=0.03)


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op2_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_ignores_labels_of_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(200)
    wrong = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert "zz" not in language.fit_language(wrong).languages


def test_language_edges(spark):
    rows = [(k, "the cat sat on the mat", "en") for k in range(20)] + [(k + 50, "der Hund und die Katze", "de") for k in range(20)]
    rows += [(100, None, "en"), (101, "123 !!", "de"), (102, "", None), (None, "the cat", "en"), (103, "die Katze " * 9000, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict_language(docs, language.fit_language(docs)).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[None][0] == "en" and got[103][0] == "de" and got[3] == got[4]
    assert {r.lang_pred for r in language.predict_language(docs, language.fit_language(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}
    assert language.predict_language(docs.limit(0), language.fit_language(docs)).collect() == []
    for m in (None, language.fit_language(docs)):
        clash = language.predict_language(docs.withColumnRenamed("source", "score").withColumnRenamed("lang", "wm_text"), m)
        assert clash.columns == ["doc_id", "text", "wm_text", "lang_pred", "score"] and dict(clash.dtypes)["score"] == "double" and clash.count() == docs.count()


def test_sample_is_the_first_of_each_language(spark, monkeypatch):
    """Rows by order of the hash, however it is cut into ranges."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("lang"))
    k = F.shiftrightunsigned(F.xxhash64(F.lit(2), F.col("doc_id")), 1)
    rows = docs.where(~language.held_out(F.col("doc_id"))).select("doc_id", "lang", k.alias("k")).collect()
    want = {x: {r.doc_id for r in sorted((r for r in rows if r.lang == x), key=lambda r: (r.k, r.doc_id))[:70]} for x in "ab"}
    seen = {}

    def fit(bits, langs, **more):
        seen["n"] = {x: int((langs == x).sum()) for x in "ab"}
        seen["bits"] = {x: {b.tobytes() for b in bits[langs == x]} for x in "ab"}

    monkeypatch.setattr(language.LanguageModel, "fit", fit)
    language.fit_language(docs, per_language=70)
    assert seen["n"] == {"a": 70, "b": 70}
    for x in "ab":
        b = [f"text {i}".encode() for i in want[x]]
        flags = language.presence(np.frombuffer(b"".join(b), np.uint8), np.cumsum([0, *map(len, b)]))
        assert {r.tobytes() for r in np.packbits(flags, axis=1)} == seen["bits"][x]


def test_scores_are_kernel_ridge_regression():
    """With every row a landmark, the map gives the dual solution."""
    rng = np.random.default_rng(4)
    vocab = {x: ["".join(rng.choice(list(c), 6)) for _ in range(40)] for x, c in (("p", "abcdefgh"), ("q", "efghijkl"), ("r", "ijklmnop"))}
    make = lambda x: " ".join(rng.choice(vocab[x], 12)).encode()
    langs = np.array(["p"] * 12 + ["q"] * 8 + ["r"] * 10)
    pack = lambda b: language.presence(np.frombuffer(b"".join(b), np.uint8), np.cumsum([0, *map(len, b)]))
    train, test = pack([make(x) for x in langs]), pack([make(x) for x in "pqrpqr"])
    model = language.LanguageModel.fit(np.packbits(train, axis=1), langs, landmarks=len(langs), ridge=1e-3)
    unit = lambda f: f / np.sqrt(f.sum(1, keepdims=True))
    x, z = unit(test.astype(float)), unit(train.astype(float))
    y = np.where(langs[:, None] == np.array(model.languages), 1.0, -1.0)
    count = {a: (langs == a).sum() for a in model.languages}
    dual = np.linalg.solve(z @ z.T + 1e-3 * np.diag([float(count[a]) for a in langs]), y)
    assert np.allclose(model.scores(test), x @ z.T @ dual, atol=2e-4)
    assert [model.languages[k] for k in model.scores(test).argmax(1)] == list("pqrpqr")


def test_quality_separates(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = op3_quality_classifier(spark, sf).join(labels, "doc_id").collect()
    clean = [r for r in got if r.quality == 1 and r.toxic == 0]
    toxic = [r for r in got if r.toxic == 1]
    poor = [r for r in got if r.quality == 0]
    assert sum(r.keep for r in clean) / len(clean) > 0.97
    assert sum(not r.keep for r in toxic) / len(toxic) > 0.9 and sum(not r.keep for r in poor) / len(poor) > 0.9
    assert all(0 <= r.tail_prob <= 1 and r.tail_prob <= r.expected_grade <= 2 for r in got)


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(5)
    grade = rng.integers(0, 3, 600)
    sets = [np.unique(np.concatenate([[10 + g], rng.integers(100, 2000, 20)])) for g in grade]
    at = np.cumsum([0, *map(len, sets)])
    m = quality.OrdinalModel.fit(at, np.concatenate(sets), grade, 3)
    assert m.thresholds[0] < m.thresholds[1] and m.weights[10] < m.weights[11] < m.weights[12]
    tails = m.tails(m.score(at, np.concatenate(sets)))
    assert (tails[:, 0] >= tails[:, 1]).all() and (np.round(tails.sum(1)) == grade).mean() > 0.95


def test_likelihood_and_gradient():
    """Against the model's definition, written out, and its differences."""
    rng = np.random.default_rng(6)
    rows, n, grades = 30, 5, 4
    own, code = np.repeat(np.arange(rows), 3), rng.integers(0, n, 3 * rows)
    x, grade, weight = rng.random(rows), rng.integers(0, grades, rows), rng.random(rows)
    p = np.concatenate([rng.normal(size=n), [-0.7], rng.normal(size=grades - 2) * 0.3])

    def loss(p):
        t = [p[n]]
        for g in p[n + 1 :]:
            t.append(t[-1] + np.exp(g))
        total = 0.0
        for r in range(rows):
            s = x[r] * sum(p[code[i]] for i in range(len(own)) if own[i] == r)
            upto = [0.0, *(1 / (1 + np.exp(s - v)) for v in t), 1.0]  # P(grade < k)
            total -= weight[r] * np.log(upto[grade[r] + 1] - upto[grade[r]])
        return total + 0.5 * 0.01 * (p[:n] ** 2).sum()

    value, g = quality.loss_and_gradient(p, own, code, x, grade, weight, grades, 0.01)
    assert abs(value - loss(p)) < 1e-9
    for k in range(len(p)):
        e = np.zeros(len(p))
        e[k] = 1e-6
        assert abs((loss(p + e) - loss(p - e)) / 2e-6 - g[k]) < 1e-6


def test_fit_comes_near_the_least_loss():
    rng = np.random.default_rng(7)
    grade = rng.integers(0, 3, 300)
    sets = [np.unique(np.concatenate([[10 + (g if rng.random() < 0.8 else rng.integers(0, 3))], rng.integers(100, 130, 4)])) for g in grade]
    at, place = np.cumsum([0, *map(len, sets)]), np.concatenate(sets)
    few, many = (quality.OrdinalModel.fit(at, place, grade, 3, steps=k) for k in (200, 3000))
    apart = np.abs(few.tails(few.score(at, place)) - many.tails(many.score(at, place)))
    assert apart.mean() < 0.02 and apart.max() < 0.15


def test_quality_of_rows_it_was_not_fitted_on(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels.where("doc_id % 2 = 0"))
    got = quality.grade_quality(docs.select("doc_id", "text"), model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, toxic, poor = ([r.keep for r in got if f(r)] for f in (lambda r: r.quality == 1 and r.toxic == 0, lambda r: r.toxic == 1, lambda r: r.quality == 0))
    assert min(map(len, (good, toxic, poor))) > 100
    assert sum(good) / len(good) > 0.97 and sum(toxic) / len(toxic) < 0.35 and sum(poor) / len(poor) < 0.2


def test_features_do_not_depend_on_the_batch():
    texts = [b"One word! one", b"", b"  ", "Größe GRÖSSE x".encode(), b"abcdef abcxyz", b"a" * 70_000]
    at, place = quality.features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for k, t in enumerate(texts):
        one = quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1]
        assert (place[at[k] : at[k + 1]] == one).all()
    a, b = (set(place[at[4] : at[5]].tolist()), set(quality.features(np.frombuffer(b"abcqqq", np.uint8), np.array([0, 6]))[1].tolist()))
    assert a & b  # the beginning that they share


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "fine text here", 1), (2, None, 2), (3, "", 3), (None, "x", 4), (1, "fine text here", 1), (5, "w " * 50_000, 5)], "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 1), (9, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    m = quality.fit_quality(docs, labels)
    got = quality.grade_quality(docs, m).collect()
    assert len(got) == 6 and all(0 <= r.tail_prob <= 1 for r in got)
    none = quality.grade_quality(docs, quality.fit_quality(docs, labels.limit(0))).collect()
    assert all(r.keep and r.tail_prob is None for r in none)
    assert quality.grade_quality(docs.limit(0), m).collect() == []
    for x in (m, None):
        clash = quality.grade_quality(docs.withColumnRenamed("grade", "keep"), x)
        assert clash.columns == ["doc_id", "text", "expected_grade", "tail_prob", "keep"] and clash.count() == 6


def test_ratings_of_absent_rows_take_no_places(spark):
    from wavemill.llm import quality

    docs = spark.createDataFrame([(i, "good plain text here" if i % 2 else "bad !!! junk $$$") for i in range(40)], "doc_id long, text string")
    rate = lambda n: spark.createDataFrame([(i, i % 2, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    a, b = quality.fit_quality(docs, rate(40), sample=20), quality.fit_quality(docs, rate(4000), sample=20)
    assert b is not None and (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()
