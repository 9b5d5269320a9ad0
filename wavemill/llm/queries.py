"""The training-data queries: each applies its operator to its whole table.

Results without an entry in `oracle_sql` cannot be expressed in SQL: they hold a
model's predictions, tokens, sketches or draws of numpy's generators. Tests hold those
against brute force, exact round trips or held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, language, media, mixing, ngram_join, packing, quality, sharding, tokencount, urlfilter
from .common import table

#: Where the tokenizers' files are; a parameter of the operators.
WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"

#: (host and start of the path, verdict)
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: The list of the query: unwanted sites, under each of these endings.
UNWANTED, ENDINGS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"), ("com", "net", "org")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), counts=True)


OP1_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
    FROM t)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), k AS (
  SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links
FROM documents d JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) r ON r.a = d.doc_id
LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_language(docs)
    rows = docs.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "text")
    return language.predict_language(rows, model).drop("text")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.grade_quality(docs.select("doc_id", "text"), model).drop("text")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(f"{site}.example.{end}",) for site in UNWANTED for end in ENDINGS], "canonical string")
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), listed, URL_RULES)


OP7_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
    END AS rule,
    regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') AS listed
  FROM u
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
       listed
FROM r
"""


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8
), byte AS (
  SELECT CAST(i AS BIGINT) AS v, upper(substr('0123456789abcdef', i // 16 + 1, 1) || substr('0123456789abcdef', i % 16 + 1, 1)) AS h FROM range(256) r(i)
), d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, encode(coalesce(text, '')) AS body FROM documents
), s AS (
  SELECT *, CAST(greatest(1, ceil(n_bytes / 576.0)) AS BIGINT) AS k FROM d
), p AS (
  SELECT doc_id, n_bytes, k, body || unhex(repeat('FF', k * 576 - n_bytes)) AS payload,
         '{''descr'': ''|u1'', ''fortran_order'': False, ''shape'': (' || k || ', 24, 24), }' AS shape
  FROM s
), m AS (
  SELECT *, unhex('934E554D5059010076' || '00') || encode(rpad(shape, 117, ' ') || chr(10)) || payload AS media FROM p
), b AS (
  SELECT doc_id, k, unnest(range(k * 576)) AS i, unnest(regexp_extract_all(hex(payload), '..')) AS h FROM p
), v AS (
  SELECT doc_id, k, i, v FROM b JOIN byte ON byte.h = b.h
), cell AS (
  SELECT doc_id, i // 24 // (3 * k) AS y, x, round(sum(v * (least(i % 24 + 1, (x + 1) * 8 / 3) - greatest(i % 24, x * 8 / 3))) / any_value(8 * k), 6) AS a
  FROM v, range(9) r(x) WHERE i % 24 + 1 > x * 8 / 3 AND i % 24 < (x + 1) * 8 / 3 GROUP BY doc_id, k, i // 24 // (3 * k), x
), bright AS (
  SELECT doc_id, y, x, a > lag(a) OVER (PARTITION BY doc_id, y ORDER BY x) AS up FROM cell
), hash AS (
  SELECT doc_id, string_agg(lower(h), '' ORDER BY y) AS feature FROM (
    SELECT doc_id, y, CAST(sum(CASE WHEN up THEN CAST(pow(2, 8 - x) AS BIGINT) ELSE 0 END) AS BIGINT) AS v FROM bright WHERE x > 0 GROUP BY doc_id, y) JOIN byte USING (v) GROUP BY doc_id
), tail AS (
  SELECT doc_id, list_transform(range(32), lambda i: v[i + 1]) AS v FROM (SELECT doc_id, list(v ORDER BY i) AS v FROM v WHERE i >= k * 576 - 32 GROUP BY doc_id)
)
SELECT m.doc_id, n_bytes, k * 576 AS payload_bytes, sha256(payload) AS payload_sha256,
       xor(list_reduce(tail.v, lambda acc, x: xor(acc // 256, tab[xor(acc, x) % 256 + 1]), 4294967295), 4294967295) AS tail_crc32,
       CAST(octet_length(media) AS BIGINT) AS media_bytes, sha256(media) AS media_sha256, feature
FROM m JOIN hash USING (doc_id) JOIN tail USING (doc_id), crc
"""


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('9|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) * pow(2.0, -52) AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, list_extract([5.0::DOUBLE, 2, 1], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS w,
         CAST(coalesce(sum(size) FILTER (size >= 32), 0) AS DOUBLE) AS w1, CAST(coalesce(sum(size) FILTER (size < 32), 0) AS DOUBLE) AS w2
  FROM t GROUP BY source
), f AS ( -- were all sources with no greater ratio full, the level of the others
  SELECT a.source, a.w, a.source_size, 3.0::DOUBLE * a.source_size / a.w AS r,
         ((SELECT sum(source_size) FROM s) - 3 * coalesce(sum(b.source_size) FILTER (3.0::DOUBLE * b.source_size / b.w < 3.0::DOUBLE * a.source_size / a.w), 0))
           / ((SELECT sum(w) FROM s) - coalesce(sum(b.w) FILTER (3.0::DOUBLE * b.source_size / b.w < 3.0::DOUBLE * a.source_size / a.w), 0)) AS level
  FROM s a, s b GROUP BY ALL
), l AS (
  SELECT coalesce(min_by(level, r) FILTER (level <= r * (1 + 1e-12::DOUBLE)), max(r)) AS level FROM f
), g AS ( -- texts of 32 words or more have odds 1, shorter ones 1/2
  SELECT source, source_size, w1, w2, target, CASE WHEN w1 + w2 = 0 THEN 0 WHEN target / (w1 + 0.5::DOUBLE * w2) <= 3 * (1 + 1e-12::DOUBLE) THEN target / (w1 + 0.5::DOUBLE * w2)
           WHEN w2 = 0 THEN 3 ELSE (target - 3 * w1) / (0.5::DOUBLE * w2) END AS level
  FROM (SELECT s.*, least(3.0::DOUBLE * source_size, l.level * w) AS target FROM s, l)
), k AS (
  SELECT *, least(3.0::DOUBLE, level) AS a1, least(3.0::DOUBLE, level * 0.5::DOUBLE) AS a2 FROM g
), n AS (
  SELECT *, target - (floor(a1 + 1e-9::DOUBLE) * w1 + floor(a2 + 1e-9::DOUBLE) * w2) AS rest FROM k
), d AS (
  SELECT t.*, source_size, target, rest, CASE WHEN size >= 32 THEN a1 ELSE a2 END AS a FROM t JOIN n ON n.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, floor(a + 1e-9::DOUBLE) AS whole, greatest(a - floor(a + 1e-9::DOUBLE), 0) AS p FROM d
), o AS (
  SELECT *, CASE WHEN p > 1e-12::DOUBLE AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM p
), x AS (
  SELECT *, CASE WHEN rank IS NOT NULL AND coalesce(sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 <= rest THEN 1 ELSE 0 END AS extra FROM o
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + extra) AS BIGINT) AS taken, CAST(whole + extra AS INTEGER) AS copies, source FROM x
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer(PIECE_BPE))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_ngram_jaccard_join, op2_language_id, op3_quality_classifier, op4_document_fingerprints, op5_packing, op6_sharding, op7_url_filters, op8_media_columns, op9_mixing, op10_token_counts, pipeline)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op7_url_filters": OP7_SQL, "op8_media_columns": OP8_SQL, "op9_mixing": OP9_SQL}
