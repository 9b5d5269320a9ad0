"""The pipeline's stages, each on its predecessor's rows, against brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavemill.llm import language, mixing, quality
from wavemill.llm.common import cut

from .test_ngram_join import brute
from .test_tokens import check_pack


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "mix", "pack"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [(10_001, "12 345 !!", "en", "src1", 9), (10_002, None, None, None, 0), (10_003, "", "en", "src2", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    names, stages = docs.columns, dict(corpus_pipeline.STAGES)
    kept = lambda d: {r.doc_id: r.text for r in d.collect()}

    one = cut(stages["language"](spark, docs, sf_dir))
    assert one.columns == names and not {10_001, 10_002, 10_003} & set(kept(one))
    pred = language.predict_language(docs, language.fit_language(docs)).where("lang_pred <> 'und'").count()
    assert one.count() >= 0.97 * pred

    two = cut(stages["quality"](spark, one, sf_dir))
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    model = quality.fit_quality(one, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {r.doc_id for r in quality.grade_quality(one, model).where("tail_prob >= 0.5").collect()}
    assert two.columns == names and set(kept(two)) == want
    clean = [i for i in kept(one) if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
    assert sum(i in want for i in clean) >= 0.95 * len(clean)
    assert not [i for i in want if i in labels and labels[i].toxic == 1 and labels[i].quality == 0]

    three = cut(stages["near_duplicates"](spark, two, sf_dir))
    root = brute([(i, t) for i, t in kept(two).items()])
    assert three.columns == names and set(kept(three)) == {i for i, (_, r) in root.items() if i == r}

    four = cut(stages["mix"](spark, three, sf_dir))
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(three).where("copies > 0").collect()}
    assert four.columns == names and Counter(r.doc_id for r in four.collect()) == copies

    rows = [(r.doc_id, r.text) for r in four.collect()]
    assert check_pack(rows, stages["pack"](spark, four, sf_dir).collect()) < 0.05


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert got and all(r.length > 0 and r.offset >= 0 for r in got)


def test_empty_stages(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).collect() == [], name


def test_clashing_columns_and_long_texts(spark, sf_dir):
    """Columns with the names of any stage's own, null ids, repeats and a very long text
    pass through all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    one = docs.first()
    long = " ".join(f"{w}{k}" for k in range(3000) for w in one.text.split()[:12])
    odd = [(5001, long, one.lang, "src1", len(long)), (5002, one.text, one.lang, "src1", 1), (one.doc_id, one.text, one.lang, one.source, 1), (None, one.text, one.lang, None, 1), (5003, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for name in ("keep", "expected_grade", "tail_prob", "wm_keep", "wm_lang", "wm_score", "wm_text", "wm_letter", "wm_id", "wm_copies", "copies", "component_id", "cls", "rank", "size", "shard"):
        docs = docs.withColumn(name, F.lit("own"))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        assert docs.columns == names, name
        assert docs.where("keep <> 'own' or component_id <> 'own' or wm_copies <> 'own'").count() == 0
        assert docs.where("doc_id = 5003").count() == 0
    got = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert got.count() > 0 and set(got.columns) >= {"doc_id", "start", "length", "sequence_id"}


@pytest.mark.parametrize("name", ["near_duplicates", "mix"])
def test_null_ids_stay(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, "a text without an id of its own", "en", "x", 31), (1, "another text with an id of its own", "en", "x", 34)], docs.schema)
    got = dict(corpus_pipeline.STAGES)[name](spark, odd, sf_dir)
    assert {r.text for r in got.collect()} == {r.text for r in odd.collect()}
