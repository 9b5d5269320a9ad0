"""Token counts and packing against the tokenizers' libraries."""

import random
import zlib

import numpy as np
import pytest

from wavemill.llm import packing, tokencount
from wavemill.llm.queries import PIECE_BPE, WORD_BPE, tokenizer

TEXTS = [
    None, "", " ", "  ", "\n", "\n\n a", "a", "Hello world", "  two  spaces   three ", "tab\there", "x" * 3000, " " * 50, "▁under▁▁score ",
    "<s> </s> <unk> <0x0A>", "<|endoftext|> a <|STARTOFTEXT|>", "naïve café Ünïcode ΣΊΣΥΦΟΣ ǅ İstanbul ß", "日本語のテキスト。中文 한국어 ไทย", "emoji 😀👩‍👩‍👧 x\u0301 e\u0301",
    "it's we'll 're 1234567890 3.14 -- !!! ...", "a\u00a0b\u3000c\u2003d\x1ce\x85f", "line one.\nline two!\r\nline three? yes.", "mixed\u0000control\u0007chars",
]


def noise(seed, n):
    rng = random.Random(seed)
    alphabet = "abcdeéth  .,\n▁ <>0x1é日Zz'!|%"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 200))) for _ in range(n)]


def test_counts_equal_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECE_BPE))
    count = tokencount.counter(tokenizer(PIECE_BPE)).count
    texts = [t or "" for t in TEXTS] + noise(1, 1500)
    assert [count(t) for t in texts] == [len(x) for x in sp.encode(texts)]


def test_chunks_compose(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECE_BPE))
    monkeypatch.setattr(tokencount, "CHUNK", 7)
    count = tokencount.Counter(tokencount.piece_scores(tokenizer(PIECE_BPE))).count
    texts = [t or "" for t in TEXTS if t is None or len(t) < 500] + noise(2, 300)
    assert [count(t) for t in texts] == [len(x) for x in sp.encode(texts)]


def test_composition_is_associative():
    c = tokencount.counter(tokenizer(PIECE_BPE))
    text = " the cat sat on\nthe abcdefghijklmnop mat  and so on "
    cuts = [0, 3, 9, 11, 16, 20, 33, 34, 41, len(text)]
    maps = [c.map(text[a:b]) for a, b in zip(cuts, cuts[1:])]
    left = maps[0]
    for m in maps[1:]:
        left = c.compose(left, m)
    right = maps[-1]
    for m in maps[-2::-1]:
        right = c.compose(m, right)
    assert left == right == c.scan(maps)[-1]


def test_compiled_part_may_be_dropped(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECE_BPE))
    monkeypatch.setattr(tokencount, "TRANSITIONS", 50)
    monkeypatch.setattr(tokencount, "WORDS", 10)
    count = tokencount.Counter(tokencount.piece_scores(tokenizer(PIECE_BPE))).count
    texts = noise(3, 100)
    assert [count(t) for t in texts] == [len(x) for x in sp.encode(texts)]


def test_count_tokens(spark, sf_dir):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECE_BPE))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1 - k, t) for k, t in enumerate(TEXTS)] + [(None, "a")]
    got = tokencount.count_tokens(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int"), tokenizer(PIECE_BPE), limit=3).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 3) for i, t in rows], key=str)
    assert tokencount.count_tokens(docs.limit(0), tokenizer(PIECE_BPE)).collect() == []


def test_long_texts_go_through_the_scan():
    """Above a chunk's size, at the size that is used."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECE_BPE))
    rng = random.Random(9)
    words = ["the", "cat", "naïve", "日本語", "\n", "  ", "x" * 40, "▁", "12.5"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (9000, 25_000)] + ["a" * (2 * tokencount.CHUNK + 5), "\n" * (tokencount.CHUNK + 1)]
    assert all(len(t) > tokencount.CHUNK for t in texts)
    count = tokencount.counter(tokenizer(PIECE_BPE)).count
    assert [count(t) for t in texts] == [len(x) for x in sp.encode(texts)]


def library_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer(WORD_BPE))
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_word_encoder_equals_the_library(monkeypatch):
    texts = [t or "" for t in TEXTS] + noise(4, 500) + ["Ⅷ K Å ẞ.", "e\u0301.", "\u0301.", "don't. can't, it's."]
    want = [np.array(x, "<u4").tobytes() for x in library_ids(texts)]
    encode, _ = packing._word_encoder(tokenizer(WORD_BPE), 1)
    assert encode([t.encode() for t in texts]) == want and encode([t.encode() for t in texts]) == want
    monkeypatch.setattr(packing, "WORDS", 5)
    encode, _ = packing._word_encoder(tokenizer(WORD_BPE), 1)
    assert [encode([t.encode()])[0] for t in texts] == want


def test_merges_equal_the_library():
    rng = random.Random(6)
    vowels, rest = "aeiouéèöü", "bcdfghlmnprstvwzßçñ日本"
    words = ["".join(rng.choice(vowels if k % 2 else rest) for k in range(rng.randrange(1, 30))) for _ in range(3000)] + ["aaaaaaaaaaaaaaaaaaa", "lllllll", "the", "a"]
    import json

    with open(tokenizer(WORD_BPE), encoding="utf-8") as f:
        got = packing.Merges(json.load(f)["model"]).encode([w.encode() for w in words])
    assert got == [np.array(x, "<u4").tobytes() for x in library_ids(words)]


def best_cost(at, pen, length, each):
    f = [0.0] + [float("inf")] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            n = at[j] - at[i]
            if n <= length:
                pad = 0 if n & (n - 1) == 0 else length - n
                f[j] = min(f[j], f[i] + pad + pen[j] + each)
    return f[-1]


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_optimal(seed):
    rng = np.random.default_rng(seed)
    at = np.concatenate([[0], np.cumsum(rng.integers(1, 17, 60))])
    pen = rng.integers(0, 8, 61).astype(float)
    cuts = packing.plan(at, pen, 32, 3)
    cost = 0.0
    for a, b in zip(cuts, cuts[1:]):
        n = at[b] - at[a]
        assert 0 < n <= 32
        cost += 3 + pen[b] + (0 if n & (n - 1) == 0 else 32 - n)
    assert (cuts[0], cuts[-1]) == (0, 60) and cost == best_cost(at, pen, 32, 3)


def check_pack(rows, got, length=2048):
    want = {}
    for (i, _), ids in zip(rows, library_ids([t or "" for _, t in rows])):
        want.setdefault(i, []).append([*ids, 1])
    seqs, docs = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
        docs.setdefault(r.doc_id, []).append(r)
        assert r.length > 0
    used = padded = 0
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length and all(p.sequence_length == at for p in pieces)
        used += at
        padded += at if at & (at - 1) == 0 else length
    assert set(docs) == set(want)
    for i, pieces in docs.items():
        if len(want[i]) == 1:
            ids, at = want[i][0], 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids)
                assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(ids)
        else:
            assert sum(p.length for p in pieces) == sum(map(len, want[i]))
    return padded / max(1, used) - 1


def test_pack_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = packing.pack_documents(docs, tokenizer(WORD_BPE)).collect()
    assert check_pack(rows, got) < 0.01
    small = packing.pack_documents(docs, tokenizer(WORD_BPE), block=9000).collect()
    assert check_pack(rows, small) < 0.02


def test_pack_edge_cases(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "null id"), (3, "again"), (3, "again"), (99, "word " * 30_000)]
    got = packing.pack_documents(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, start int").coalesce(2), tokenizer(WORD_BPE), block=4096, tokens=True).collect()
    check_pack(rows, got)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer(WORD_BPE)).collect() == []
