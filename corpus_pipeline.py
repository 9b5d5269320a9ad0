"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), where docs are the rows that the stage
before it kept, and returns a DataFrame; all but the last return the columns of
documents. Between stages, rows are written to the shared folder and read again.

1. language: documents without a language (no letters) or whose language cannot be
   told go.
2. quality: toxic documents and documents of low quality go (those whose probability of
   the best grade is below one half).
3. near_duplicates: of each group of near-duplicate documents, the one with the
   smallest doc_id stays.
4. mix: sources are mixed to their target weights; a document that the mix takes k
   times has k rows, one that it does not take has none.
5. pack: the mix is packed into sequences of 2048 tokens.

Defined results: null, empty and letterless texts go in the first stage, so no stage
after it sees them; texts of any length are judged, joined and packed whole; ties go as
each operator says (the smallest doc_id of a group stays); rows of one id are one
document in stages 3 and 4; rows without an id stay there; stages keep all columns of
their input, whatever their names, and use free names for their own; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import language, mixing, ngram_join, packing, quality
from wavemill.llm.common import cut, free, table
from wavemill.llm.queries import WORD_BPE, tokenizer

#: A language's least share of the scores; an even share of four is 0.25.
LEAST_SHARE = 0.3


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit_language(docs)
    lang, score = free(docs, "wm_lang"), free(docs, "wm_score")
    out = language.predict_language(docs, model, lang_out=lang, score_out=score)
    return out.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SHARE)).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    grade, tail, keep = (free(docs, n) for n in ("wm_grade", "wm_tail", "wm_keep"))
    return quality.grade_quality(docs, model, new=(grade, tail, keep)).where(F.col(keep)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of one id are one document and go or stay together. Rows without an id
    stay."""
    groups = ngram_join.ngram_jaccard_join(docs)
    go = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(go, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an id are not sampled and stay once; rows of the same id are
    taken equally often."""
    own, n, k = (free(docs, x) for x in ("wm_id", "wm_copies", "wm_copy"))
    copies = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").alias(n)).where(F.col(n) > 0)
    out = docs.join(copies, F.col("doc_id") == F.col(own))
    out = out.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
    return out.unionByName(docs.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer(WORD_BPE))


STAGES = [("language", languages), ("quality", good_quality), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: Models, sampling and tokens cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
