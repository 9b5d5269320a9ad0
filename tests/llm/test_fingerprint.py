import hashlib
from collections import defaultdict

import numpy as np
import pytest

from wavemill.llm import fingerprint as fp


def sets(*lists):
    at = np.cumsum([0, *map(len, lists)])
    return fp.Sketches.build(at, np.concatenate([np.unique(x).astype(np.uint64) for x in lists]))


def draw(rng, n):
    return np.unique(rng.integers(1, 2**63, n).astype(np.uint64))


def test_peeling_recovers_differences():
    rng = np.random.default_rng(1)
    base, left, right = draw(rng, 500), [], []
    for k in (0, 1, 5, 60, 400):
        left.append(base)
        right.append(np.unique(np.concatenate([base[k:], draw(rng, k)])))
    left += [base[:0], base[:0], base[:3]]
    right += [base[:0], base[:7], base[:0]]
    a, b, every = sets(*left), sets(*right), np.arange(8)
    pair, x, sign, tries = fp.differences(a, every, b, every)
    for k in range(8):
        assert sorted(x[(pair == k) & (sign == 1)]) == sorted(np.setdiff1d(left[k], right[k]))
        assert sorted(x[(pair == k) & (sign == -1)]) == sorted(np.setdiff1d(right[k], left[k]))
    # No difference: once; one that the first size cannot hold: again, larger.
    assert tries[0] == tries[5] == 1 and tries[3] > 1 and tries[4] > 1


def test_a_sketch_too_small_fails_and_a_larger_one_does_not():
    rng = np.random.default_rng(2)
    x = draw(rng, 200)
    whole = sets(x)
    assert not whole.folded(np.zeros(1, int), np.array([16])).peel()[3][0]
    own, got, sign, ok = whole.copy().peel()
    assert ok[0] and sorted(got) == sorted(x) and (sign == 1).all()


def test_text_is_lossless_and_suffices():
    rng = np.random.default_rng(3)
    lists = [draw(rng, n) for n in (0, 1, 2, 40, 3000)]
    lists.append(np.concatenate([lists[4][:2000], draw(rng, 900)]))
    s = sets(*lists)
    texts = [s.text(k) for k in range(6)]
    t = fp.Sketches.parse(texts)
    for name in ("size", "count", "key", "check"):
        assert (getattr(s, name) == getattr(t, name)).all()
    assert [t.text(k) for k in range(6)] == texts
    at, digests = t.lists()
    for k, x in enumerate(lists):
        assert (digests[at[k] : at[k + 1]] == np.unique(x)).all()
    for i in range(6):
        for j in range(6):
            x, y = (set(lists[k].tolist()) for k in (i, j))
            assert fp.likeness(texts[i], texts[j]) == (len(x & y) / len(x | y) if x | y else 1.0)
    for bad in ("", "AA", "!!!!", texts[3][:-4], "ÿ"):
        with pytest.raises(ValueError):
            fp.Sketches.parse([bad])


def test_many_paragraphs_keep_whole_counts():
    rng = np.random.default_rng(4)
    x = draw(rng, 400_000)
    s = sets(x)
    t = fp.Sketches.parse([s.text(0)])
    assert t.digests()[0] == len(x) and (t.count == s.count).all() and (t.lists()[1] == x).all()
    # More in a cell than a byte holds.
    small = s.folded(np.zeros(1, int), np.array([512]))
    assert small.count.max() > 255 and (fp.Sketches.parse([small.text(0)]).count == small.count).all()
    # A difference of a few of them needs few cells.
    y = np.sort(np.concatenate([x[3:], draw(rng, 4)]))
    b = sets(y)
    one = np.zeros(1, int)
    pair, got, sign, tries = fp.differences(s, one, b, one)
    assert len(got) == 7 and tries[0] == 1


def test_paragraphs_depend_on_their_text_alone():
    texts = [b"one line\nanother line of words that goes on and on\n\nx", b"", b"a" * 9000, b"b " * 9000, "é日本 x\n".encode(), b"\n", b"tail"]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    at, d = fp.paragraphs(data, offs)
    for k, t in enumerate(texts):
        one = fp.paragraphs(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1]
        assert (d[at[k] : at[k + 1]] == one).all() and (len(one) > 0) == (len(t) > 0)


def digests(text):
    b = text.encode()
    return set(fp.paragraphs(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[1].tolist())


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]
        like = lambda x, y: 1.0 if not (x | y) else len(x & y) / len(x | y)
        a, e, b = (digests(x) for x in (t, edited, nxt))
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), like(a, e), like(a, b))
    return out


@pytest.mark.parametrize("ranges", [1, 7])
def test_neighbours(spark, sf_dir, ranges):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-5, None), (-4, ""), (-3, "é日本 x"), (-2, "word " * 20_000), (99_999, "top\nline")], "doc_id long, text string")
    rows = [tuple(r) for r in docs.unionByName(extra).collect()]
    got = fp.neighbour_fingerprints(docs.unionByName(extra).repartition(5), ranges=ranges).collect()
    assert len(got) == len(rows)
    want, seen, text = brute(rows), defaultdict(set), dict(rows)
    below = {i: j for i, j in zip(sorted(want, reverse=True), [*sorted(want, reverse=True)[1:], max(want)])}
    mine = {r.doc_id: r.fingerprint for r in got}
    for r in got:
        n, sha, near, nxt = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (n, sha, near, nxt)
        # The likenesses follow from the strings that are returned.
        assert fp.likeness(r.fingerprint, r.edited_fingerprint) == near and fp.likeness(r.fingerprint, mine[below[r.doc_id]]) == nxt
        seen[text[r.doc_id] or ""].add(r.fingerprint)
    assert all(len(x) == 1 for x in seen.values()) and len({min(x) for x in seen.values()}) > 0.95 * len(seen)
    assert np.mean([r.near_edited for r in got]) > 0.3 > np.mean([r.near_next for r in got])


def test_registered_query(spark, sf_dir):
    from wavemill.llm import queries

    got = queries.op4_document_fingerprints(spark, sf_dir).collect()
    want = brute([tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()])
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got} == want


def test_operators_on_columns(spark):
    rows = [(1, "first line\nsecond line", "x"), (2, "first line\nthird line\nfourth", "y"), (3, None, "z")]
    docs = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string"))
    assert docs.columns == ["doc_id", "text", "fingerprint"]
    mine = {r.doc_id: r.fingerprint for r in docs.collect()}
    pairs = spark.createDataFrame([(mine[1], mine[2]), (mine[1], mine[3]), (mine[1], None), ("junk", mine[1])], "a string, b string")
    got = fp.compare_fingerprints(pairs, "a", "b").collect()
    left, right = digests(rows[0][1]), digests(rows[1][1])
    signed = lambda x: sorted(np.array(sorted(x), np.uint64).view(np.int64).tolist())
    assert sorted(got[0].only_left) == signed(left - right) and sorted(got[0].only_right) == signed(right - left)
    assert got[0].likeness == len(left & right) / len(left | right) and got[1].likeness == 0 and got[1].only_right == []
    assert got[2].likeness is None and got[3].only_left is None


def test_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, tie int, range int")
    assert fp.neighbour_fingerprints(make([])).collect() == []
    one = fp.neighbour_fingerprints(make([(1, "abcdef", 1, 1)])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one[0].near_next == 1.0
    twins = fp.neighbour_fingerprints(make([(1, "same", 1, 1), (1, "same", 1, 1), (2, "x", 2, 2), (None, "n", 3, 3), (None, None, 4, 4)]), ranges=3).collect()
    assert len(twins) == 5 and len({r.fingerprint for r in twins if r.doc_id == 1}) == 1
    nulls = fp.neighbour_fingerprints(make([(None, "n", 3, 3), (None, "m", 4, 4)])).collect()
    assert len(nulls) == 2
