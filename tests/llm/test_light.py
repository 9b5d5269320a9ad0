"""Sharding, mixing, URL filters, media."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import media, mixing, sharding, urlfilter
from wavemill.llm.queries import URL_RULES

ODD = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "é ü"), (4, "x " * 20_000), (5, " \t\n")]


# ---------------------------------------------------------------- sharding


def test_matrix_rows_have_exact_margins():
    counts = [5, 0, 17, 300, 1, 42, 9]
    before = np.concatenate([[0], np.cumsum(counts)])
    sizes = sharding.shard_sizes(sum(counts), 4)
    rows = np.stack([sharding.matrix_row(p, before, sizes, 7) for p in range(len(counts))])
    assert rows.sum(1).tolist() == counts and rows.sum(0).tolist() == sizes.tolist() and rows.min() >= 0


def test_large_populations_keep_margins():
    room = np.array([3_000_000_000, 5, 2_000_000_000])
    got = sharding.split_room(room, 1_700_000_000, sharding.generator(1, 2))
    assert got.sum() == 1_700_000_000 and (got <= room).all() and abs(got[0] / 1.02e9 - 1) < 1e-3


def law(good, bad, draws):
    """Exact probabilities of the counts that can occur."""
    from fractions import Fraction
    from math import comb, prod

    falls = lambda n, k: prod(range(n - k + 1, n + 1))
    low, high = max(0, draws - bad), min(good, draws)
    return {x: float(Fraction(comb(draws, x) * falls(good, x) * falls(bad, draws - x), falls(good + bad, draws))) for x in range(low, high + 1)}


@pytest.mark.parametrize("good, bad, draws", [(30, 50, 25), (3, 4, 6), (3_000_000_000, 2_000_000_000, 12), (10**12, 3 * 10**9, 40), (5, 1_500_000_000, 400_000_000)])
def test_exact_draws_have_the_law(good, bad, draws):
    rng, n = np.random.default_rng(8), 1500
    got = Counter(sharding.exact_hypergeometric(rng, good, bad, draws) for _ in range(n))
    if draws < 1000:
        p = law(good, bad, draws)
    else:  # five good ones: each is drawn or not
        p = {x: v for x, v in law(draws, good + bad - draws, good).items()}
    assert set(got) <= set(p)
    cells = [(got[x], n * q) for x, q in p.items() if n * q >= 5]
    cells.append((n - sum(c for c, _ in cells), n - sum(e for _, e in cells)))
    chi = sum((c - e) ** 2 / e for c, e in cells if e > 1e-6)
    assert chi < len(cells) + 5 * (2 * len(cells)) ** 0.5


def test_draws_just_above_the_limit_agree_with_those_below():
    rng = np.random.default_rng(3)
    good, bad, draws, n = 400_000_000, 600_000_001, 250_000_000, 200
    total = good + bad
    mean, var = draws * good / total, draws * (good / total) * (bad / total) * (total - draws) / (total - 1)
    z = np.array([(sharding.hypergeometric(rng, good, bad, draws) - mean) / var**0.5 for _ in range(n)])
    assert abs(z.mean()) < 5 / n**0.5 and abs((z * z).mean() - 1) < 5 * (2 / n) ** 0.5
    assert abs(float(sharding.ln_factorial(2999)) - math.lgamma(3000)) < 1e-8 and abs(float(sharding.ln_factorial(10**6) - sharding.ln_factorial(10**6 - 1)) - math.log(10**6)) < 1e-14


def test_matrix_rows_cost_little():
    import time

    before, sizes = np.arange(16_001) * 40_000, sharding.shard_sizes(16_000 * 40_000, 16)
    began = time.process_time()
    for p in range(0, 16_000, 80):
        assert sharding.matrix_row(p, before, sizes, 1).sum() == 40_000
    assert (time.process_time() - began) * 80 < 30


def test_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long"))
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    got = sharding.shard_documents(docs.repartition(5), block_rows=7).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1


def test_shuffle_is_uniform(spark):
    docs = spark.range(0, 24, 1, 3).withColumnRenamed("id", "doc_id")
    seen = np.zeros((24, 24))
    for seed in range(40):
        for r in sharding.hypergeometric_shards(docs, shards=3, seed=seed, block_rows=4).collect():
            seen[r.doc_id, r.shard * 8 + r.slot] += 1
    chi = ((seen - 40 / 24) ** 2 / (40 / 24)).sum()
    assert abs(chi - 23 * 23) < 6 * (2 * 23 * 23) ** 0.5


def test_no_rows_to_shard(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_columns_with_the_names_of_results_are_replaced(spark):
    odd = spark.createDataFrame([(1, 9, 9, 9, 9, 9)], "doc_id long, shard int, slot int, wm_part int, wm_key int, wm_block int")
    got = sharding.hypergeometric_shards(odd, shards=2).collect()
    assert got[0].asDict() == {"doc_id": 1, "wm_part": 9, "wm_key": 9, "wm_block": 9, "shard": 0, "slot": 0}


def test_registered_sharding(spark, sf_dir):
    from wavemill.llm import queries

    got = queries.op6_sharding(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs)
    assert len({(r.shard, r.slot) for r in got}) == len(docs)


# ------------------------------------------------------------------ mixing


def levels(sizes, weights, most=3):
    """Targets by sharing the excess again until none is above."""
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        target = {s: most * sizes[s] if s in full else left * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(int(rng.paretovariate(1) * 10) % 900)), rng.choices(["a", "b", "é", None, "z"], [60, 3, 2, 10, 25])[0]) for i in range(4000)]
    rows += [(9000 + k, t, "odd") for k, (_, t) in enumerate(ODD)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, target int, rank int")
    got = mixing.mix_sources(df.repartition(4)).collect()
    assert sorted(map(str, mixing.mix_sources(df.repartition(3)).collect())) == sorted(map(str, got))
    n = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sizes = Counter()
    for i, _, s in rows:
        sizes[s] += n[i]
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = levels(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    taken, top = Counter(), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == n[r.doc_id] and r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        top[r.source] = max(top[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= top[s], s
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_mix_is_a_pareto_sample(spark):
    """Each row's copies by sorting ranks, source by source."""
    rng = random.Random(12)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 90))), rng.choices("abc", [70, 20, 10])[0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    u = {i: (int(hashlib.md5(f"9|{i}|{t}".encode()).hexdigest()[:13], 16) + 0.5) * 2.0**-52 for i, t, _ in rows}
    got = {r.doc_id: r for r in mixing.mix_sources(df.repartition(3)).collect()}
    size = {i: len((t or "").split()) for i, t, _ in rows}
    totals = Counter()
    for i, _, s in rows:
        totals[s] += size[i]
    target = levels(totals, dict(zip("abc", (5, 2, 1))))
    for s in "abc":
        own = [i for i, _, x in rows if x == s]
        odds = {i: 0.5 if size[i] < 32 else 1.0 for i in own}
        low, high = 0.0, 100.0  # the level at which min(3, level * odds) spends the target
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(size[i] * min(3.0, mid * odds[i]) for i in own) < target[s] else (low, mid)
        ratio = {i: min(3.0, high * odds[i]) for i in own}
        whole = {i: int(ratio[i] + 1e-9) for i in own}
        left = target[s] - sum(size[i] * whole[i] for i in own)
        part = {i: max(ratio[i] - whole[i], 0.0) for i in own}
        order = sorted((i for i in own if part[i] > 1e-12 and size[i]), key=lambda i: (u[i] / (1 - u[i])) / (part[i] / (1 - part[i])))
        spent, extra = 0, set()
        for i in order:
            if spent < left and spent + size[i] / 2 <= left:
                extra.add(i)
            spent += size[i]
        for i in own:
            assert got[i].copies == whole[i] + (i in extra), (s, i)


def test_odds_change_the_inclusion(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("a " * 50)).otherwise(F.lit("b " * 10)).alias("text"), F.when(F.col("id") < 3000, "x").otherwise("y").alias("source"))
    got = mixing.mix_sources(df, weights=(1, 3)).where("source = 'x'").groupBy("size").agg(F.avg("copies")).collect()
    rate = dict(map(tuple, got))
    assert abs(rate[10] / rate[50] - 0.5) < 0.06


# -------------------------------------------------------------------- URLs


def test_urls(spark):
    far = "http://far.example.org/" + "x/" * 5000
    urls = [far, "http://m.bad-site.example.org/a?b", "http://bad-site.example.org", "http://not-bad-site.example.org/", "http://a.example.net/en/1", "https://EXAMPLE.net/de/", "http://example.com/de/x?y#z", "http://x.org/fr/", "http://xorg/fr/", "http://spam.example.com/p/?utm_source=a&b=1#t", "https://www.spam.example.com/p?b=1", "nothing", None, "://", "http://", "http://h?q", "http://net", "a://b://c/d", "http://spam.example.com/p"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls + urls[:3])], "page_id long, url string, host string")
    listed = spark.createDataFrame([("spam.example.com/p?b=1",), ("spam.example.com/p?b=1",), ("bad-site.example.org",), (far[7:-1],), (None,), ("",)], "canonical string")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.filter_urls(pages, listed, URL_RULES).collect()}
    for k, u in enumerate(urls + urls[:3]):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(t, v) for t, v in URL_RULES if (host == (h := t.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + t.partition("/")[2])]
        rule, verdict = max(fit, key=lambda r: len(r[0]), default=(None, None))
        hit = k in (0, 1, 2, 9, 10) or k >= len(urls)
        assert got[k] == (host, path, rule, verdict or ("block" if hit else "allow"), hit), (k, u)
    none = urlfilter.filter_urls(pages, listed.limit(0), []).collect()
    assert {r.verdict for r in none} == {"allow"} and len(none) == len(urls) + 3
    assert urlfilter.filter_urls(pages.limit(0), listed, URL_RULES).collect() == []


def test_only_possible_hits_are_shuffled(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, F.lit("http://bad.example.com/x")).otherwise(F.concat(F.lit("http://good.example.org/"), F.col("id"))).alias("url"))
    listed = spark.createDataFrame([("bad.example.com",)], "canonical string")
    out = urlfilter.filter_urls(pages, listed, [])
    plan = out._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan")[0]
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines, moved = plan.splitlines(), 0
    for k, line in enumerate(lines):
        if "Exchange" in line and "canonical" in line:
            below = []
            for other in lines[k + 1 :]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            assert any("Filter" in x and "maybe#" in x and "NOT maybe#" not in x for x in below), "\n".join([line, *below])
            moved += 1
    assert moved and any("Filter" in x and "NOT maybe#" in x for x in lines)
    got = out.groupBy("listed").count().collect()
    assert {(r.listed, r["count"]) for r in got} == {(True, 1000), (False, 2000)}


def test_equally_long_rules_go_by_text(spark):
    pages = spark.createDataFrame([(1, "http://a.bc/d")], "page_id long, url string")
    got = urlfilter.filter_urls(pages, spark.createDataFrame([], "canonical string"), [("bc/d", "allow"), ("a.bc/", "block"), ("a.bc", "allow")]).first()
    assert (got.rule, got.verdict) == ("a.bc/", "block")
    same = urlfilter.filter_urls(pages, spark.createDataFrame([], "canonical string"), [("bc/d", "allow"), ("a.bc", "block")]).first()
    assert (same.rule, same.verdict) == ("a.bc", "block")


@pytest.mark.parametrize("name, table", [("op7_url_filters", "pages"), ("op8_media_columns", "documents"), ("op9_mixing", "documents")])
@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_against_sql(spark, name, table, scale):
    import os

    from wavemill.llm import queries

    duckdb, sf = pytest.importorskip("duckdb"), f"/root/testdata/{scale}"
    if not os.path.isdir(sf):
        pytest.skip("test tables are absent")
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    q = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in q.description]
    want = sorted(q.fetchall())
    assert sorted(map(tuple, queries.queries()[name](spark, sf).select(*names).collect())) == want and len(want) > 100


def test_bloom_has_no_false_negatives(spark):
    h = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = 16
    flags = urlfilter.bloom(h, bits)
    have = np.array([r.h for r in h.collect()]).view(np.uint64)
    other = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    assert urlfilter.in_bloom(flags, have, bits).all() and urlfilter.in_bloom(flags, other, bits).mean() < 0.05


# ------------------------------------------------------------------- media


def test_decoders():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (5, 7), dtype=np.uint8)
    assert (media.decode(b"P5 # c\n7 5\n255\n" + a.tobytes()) == a).all()
    assert (media.decode(media.encode_bmp(a)) == a[..., None]).all()
    c = rng.integers(0, 256, (3, 4, 3), dtype=np.uint8)
    assert (media.decode(b"P6\n4 3 255\n" + c.tobytes()) == c).all()
    assert (media.decode(b"P3\n4 3\n#x\n255\n" + " ".join(map(str, c.ravel())).encode()) == c).all()
    assert (media.decode(b"P2\n7 5\n255\n" + " ".join(map(str, a.ravel())).encode()) == a).all()
    assert (media.decode(b"P1\n3 2\n1 0 1\n010") == [[0, 255, 0], [255, 0, 255]]).all()
    assert (media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])) == [[0, 255, 0], [255, 0, 255]]).all()
    deep = rng.integers(0, 65536, (2, 3)).astype(">u2")
    got = media.decode(b"P5\n3 2\n65535\n" + deep.tobytes())
    assert got.dtype == np.uint16 and (got == deep).all()
    bmp = bytearray(media.encode_bmp(a))
    bmp[18:26] = b"\xff\xff\xff\x7f" * 2
    odd = [b"P5\n99999999999999999999 1\n255\n", b"P4\n4000000000 4000000000\n", b"P6\n4000000000 4000000000 255\nabc", b"P2\n1 1\n255\n99999999999999999999999", b"P2\n1 1\n255\n300", b"P5\n1 1\n9\n\x0a", b"P3\n1 1 255 1 2 -3", b"P5\n1_0 1\n255\n" + bytes(10), bytes(bmp)]
    for bad in (b"", b"P5\n3", b"P5\n3 3\n255\nxx", b"BM", b"GIF89a", b"P5\nx y\n1\n", *odd):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize_is_exact():
    a = np.random.default_rng(2).integers(0, 256, (10, 14))
    big = np.repeat(np.repeat(a, 8, 0), 9, 1)  # 80 x 126 divides into 8 x 9 cells
    want = big.reshape(8, 10, 9, 14).mean((1, 3))
    assert np.allclose(media.area_resize(a, 8, 9), want)


def test_npy_and_tiles():
    a = np.arange(30, dtype=np.uint8).reshape(5, 6)
    t = media.tiles(a, 4, fill=9)
    assert t.shape == (4, 4, 4) and (t[0] == a[:4, :4]).all() and t[3, 0, 0] == a[4, 4] and t[3, 1, 0] == 9
    assert (np.load(io.BytesIO(media.npy(t))) == t).all() and (media.read_npy(media.npy(t)) == t).all()
    assert media.tiles(np.zeros((3, 3, 3), np.uint16), 2).shape == (4, 2, 2, 3)


def test_media_columns(spark):
    good = b"P5\n2 2\n255\n\x00\x01\x02\x03"
    rows = [(1, good, 5), (2, None, 6), (3, b"P6\n4000000000 4000000000 255\n", 7), (1, good, 5)]
    got = media.media_columns(spark.createDataFrame(rows, "id long, media binary, ok int")).orderBy("id").collect()
    assert [r.ok for r in got] == [True, True, False, False] and got[0].tiles == got[1].tiles and got[2].tiles is None
    assert media.media_columns(spark.createDataFrame([], "id long, media binary")).collect() == []


def test_document_media(spark):
    rows = ODD + [(7, "y" * 576), (8, "z" * 577), (9, "日本" * 3000), (10, "a b")]
    got = media.document_media(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int")).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(tuple(r)[1:])
    for i, t in rows:
        b = (t or "").encode()
        full = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        want = (len(b), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert {x[:4] for x in by[i]} == {want}
        npy = media.npy(np.frombuffer(full, np.uint8).reshape(-1, 24, 24))
        assert {x[4:6] for x in by[i]} == {(len(npy), hashlib.sha256(npy).hexdigest())}
    assert {x[1:] for x in by[1]} == {x[1:] for x in by[10]}
