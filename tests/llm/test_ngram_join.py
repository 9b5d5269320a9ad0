import random
import re

import numpy as np
import pytest

from wavemill.llm import ngram_join
from wavemill.llm.ngram_join import ngram_jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, n=5, num=3, den=4):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                label[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def near(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    out = ["", None, "   \n", "one", "One", "a b c", "A b\tc", "a b c d e", "ünï Çode tëxt ünï Çode", "x" * 50_000]
    base = text(120)
    out += [near(rng, base, rng.randrange(0, 6)) for _ in range(60)]
    passage = text(60)
    out += [" ".join(text(rng.randrange(5, 60)) + passage) for _ in range(50)]
    out += [" ".join(text(rng.randrange(1, 200))) for _ in range(40)]
    chain = text(80)
    for _ in range(10):
        chain[rng.randrange(80)] = "x"
        out.append(" ".join(chain))
    out += [out[20]] * 5 + [" ".join(text(5000))]
    out.append(out[-1] + " tail of it")
    return [(7 * k % 1009, t) for k, t in enumerate(out)]


def run(spark, rows):
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_long_lists_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST", 3)
    rows = corpus(3)
    for block in (1500, 100):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("window, often, common", [(400, 2, 3), (10_000, 3, 20)])
def test_common_shingles_skip_the_count(spark, monkeypatch, window, often, common):
    for name, value in (("WINDOW", window), ("OFTEN", often), ("COMMON", common)):
        monkeypatch.setattr(ngram_join, name, value)
    seen = []
    real = ngram_join._common
    monkeypatch.setattr(ngram_join, "_common", lambda s: seen.append(real(s)) or seen[-1])
    rows = corpus(5)
    assert run(spark, rows) == brute(rows) and len(seen[0][0]) > 10 and (np.diff(seen[0][0].astype(float)) > 0).all()


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard_join(empty).collect() == []
    odd = spark.createDataFrame([(1, "a b c d e f", 5, 6), (2, "a b c d e f", 7, 8), (None, "a b c d e f", 1, 1)], "doc_id long, text string, cls long, component_id long")
    got = ngram_jaccard_join(odd)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 2, 1), (2, 2, 1), (None, 2, 1)]


def test_repeated_rows(spark):
    rows = [(3, "same words again and again ok"), (3, "same words again and again ok"), (9, "other"), (9, "other")]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(3, 2, 3), (3, 2, 3), (9, 1, 9), (9, 1, 9)]


@pytest.mark.parametrize("size, block", [(8, 2_000_000), (3, 1500), (3, 100), (2, 400)])
def test_every_link_counts_once(spark, monkeypatch, size, block):
    monkeypatch.setattr(ngram_join, "LIST", size)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "TILE", 3000)
    rows = corpus(4)
    sets = {i: set(zip(*(WORD.findall((t or "").translate(LOWER))[k:] for k in range(5)))) or set(map(tuple, [WORD.findall((t or "").translate(LOWER))])) - {()} for i, t in rows}
    want = {i: sum(j != i and 4 * len(a & b) >= 3 * len(a | b) > 0 for j, b in sets.items()) for i, a in sets.items()}
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), counts=True)
    assert {r.doc_id: r.n_links for r in got.collect()} == want and max(want.values()) > 20


def test_class_without_ids_connects(spark):
    w = [f"w{k}" for k in range(60)]
    rows = [(5, " ".join(w[:50])), (None, " ".join(w[:56])), (2, " ".join(w)), (8, "else")]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), num=9, den=10, counts=True)
    assert sorted(map(tuple, got.collect()), key=str) == [(2, 56, 2, 1), (5, 46, 5, 0), (8, 1, 8, 0), (None, 52, 2, 1)]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), num=17, den=20, counts=True)
    assert sorted(map(tuple, got.collect()), key=str) == [(2, 56, 2, 1), (5, 46, 2, 1), (8, 1, 8, 0), (None, 52, 2, 2)]


def family(seed, m=220):
    """Sets of shingles in order of size, rare-first, with the lengths of prefixes."""
    from collections import Counter

    rng = random.Random(seed)
    base, sets = rng.sample(range(10**6), 60), []
    for _ in range(m):
        own = set(rng.sample(base, rng.randrange(20, 60))) | set(rng.sample(range(10**6, 10**6 + 300), rng.randrange(0, 12)))
        sets.append(own)
    sets += [set(rng.sample(base, 55)) for _ in range(40)] + [set(base)] * 0
    count = Counter(x for s in sets for x in s)
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    ranked = [np.array(sorted(sets[k], key=lambda x: (count[x], x)), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in order]
    n = np.array([len(x) for x in ranked])
    return n, ranked, n - -(-3 * n // 4) + 1


@pytest.mark.parametrize("tile", [40, 3000, 1_000_000])
def test_candidates_pass_the_filters_and_are_verified_once(monkeypatch, tile):
    from collections import Counter

    monkeypatch.setattr(ngram_join, "TILE", tile)
    n, ranked, posted = family(7)
    m, verified = len(n), Counter()

    class Counting(ngram_join._Sets):
        def common(self, x, y):
            verified.update(zip(x.tolist(), y.tolist()))
            return super().common(x, y)

    s = Counting(n, ranked)
    links, label = ngram_join._links(s, np.ones(m, np.int64), ngram_join._by_prefix(s, posted, 3, 4))
    assert max(verified.values()) == 1
    sets = [set(x.tolist()) for x in ranked]
    want, edges = np.zeros(m, int), set()
    for x in range(m):
        for y in range(x + 1, m):
            if 4 * len(sets[x] & sets[y]) >= 3 * len(sets[x] | sets[y]):
                want[[x, y]] += 1
                edges.add((x, y))
    assert (links == want).all() and edges <= set(verified) and len(verified) < m * (m - 1) / 2
    part = lambda k: Counter(v >> 60 for v in ranked[k].tolist())
    for x, y in verified:
        need = -(-3 * (n[x] + n[y]) // 7)
        assert n[x] * 4 >= n[y] * 3  # length
        p, q = ranked[x][: posted[x]].tolist(), ranked[y][: posted[y]].tolist()
        shared = [k for k, v in enumerate(p) if v in q]
        assert shared  # joined on a prefix shingle
        assert min(n[x] - shared[0], n[y] - q.index(p[shared[0]])) >= need  # position
        assert sum((part(x) & part(y)).values()) >= need  # suffix
    root = list(range(m))
    for x, y in sorted(edges):
        a, b = sorted((root[x], root[y]))
        root = [a if r == b else r for r in root]
    assert [root.index(r) for r in root] == [label.tolist().index(v) for v in label.tolist()]


def test_many_small_sets_in_one_family():
    """A chain of 100,000 sets meets in about linear time."""
    import time

    m = 100_000
    g = np.random.default_rng(3)
    ids = np.sort(g.integers(1, 2**63, m + 8).astype(np.uint64))
    ranked = [ids[k : k + 8] for k in range(m)]  # neighbours share 7 of 9
    n, posted = np.full(m, 8), np.full(m, 3)
    s = ngram_join._Sets(n, ranked)
    began = time.time()
    links, label = ngram_join._links(s, np.ones(m, np.int64), ngram_join._by_prefix(s, posted, 3, 4))
    assert links[0] == links[-1] == 1 and (links[1:-1] == 2).all() and (label == 0).all()
    assert time.time() - began < 30


def test_classes_pass_through_arrow():
    low, high = np.array([0, 5, 2**64 - 1, 5], np.uint64), np.array([0, 2**32 - 1, 7, 1], np.uint32)
    a, b = ngram_join._split(ngram_join._classes(low, high))
    assert (a == low).all() and (b == high).all()
    a, b, code = ngram_join._merged(np.concatenate([low, low]), np.concatenate([high, high]))
    assert len(a) == 4 and (a[code[:4]] == low).all() and (b[code[4:]] == high).all()


def test_against_sql(spark):
    import os

    from wavemill.llm import queries

    duckdb, sf = pytest.importorskip("duckdb"), "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("test tables are absent")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    q = c.execute(queries.oracle_sql()["op1_ngram_jaccard_join"])
    names = [d[0] for d in q.description]
    want = sorted(q.fetchall())
    got = queries.op1_ngram_jaccard_join(spark, sf).select(*names).collect()
    assert sorted(map(tuple, got)) == want and max(r.n_links for r in got) > 3
