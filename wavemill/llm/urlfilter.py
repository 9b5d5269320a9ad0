"""URL filters: a blocked Bloom filter of listed canonical URLs passes possible
hits to an exact hash join that removes false positives.

The filter's blocks are one cache line (512 bits); a URL's hash picks a block and
eight bits in it. The list is dealt out by block, so that a task sees the URLs of its
own slice of the filter and builds only that; the size follows the list's count up to
`MAX_BITS` (32 MB, which is what is broadcast at most), past which more URLs count as
possible hits and the join does more work. At 12 bits an entry about 3 in 1,000 others
pass.

A list's entries are canonical URLs or bare sites (a canonical host alone), which stand
for all that is on the site and its subdomains: a URL is looked up by itself and by
each of its host's endings of two labels or more. Only rows with a possible hit take
part in the join; the URLs of these are made distinct first, so one that is very common
is one row there.

Rules are few and go first: a rule names a host and a start of the path, holds for
the host and its subdomains, and the longest one that fits decides (of equally long
ones, the first by text). Where none does, a listed URL is blocked and any other allowed.

Defined results: a null URL, or one without `://`, has empty host and path, fits no
rule and is allowed; URLs of any length are judged whole; repeated rows are judged like
others; repeated list entries count once, null and empty ones not at all; an empty list
blocks nothing; an empty table gives no rows; only the id and URL columns are read, so
others may have any names.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, pack, unpack

MAX_BITS = 28
BLOCK_BITS = 9
SLICE = 1 << 18

#: Query parameters that do not name content.
TRACKING = ("utm_[a-z]+", "ref", "gclid", "fbclid")


def lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    return lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without `www.`, path without a last `/`, query without tracking
    parameters; no scheme, no fragment. Empty where there is no `://`."""
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    path = F.regexp_replace(url_path(url), r"/$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, rf"(^|&)({'|'.join(TRACKING)})=[^&]*", "")
    query = F.regexp_replace(query, r"^&", "")
    return F.coalesce(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule's text (`host/path`), or null."""
    out = F.lit(None).cast("string")
    for text, _ in sorted(sorted(rules, reverse=True), key=lambda r: len(r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def _where(h: np.ndarray, bits: int) -> np.ndarray:
    """(rows, 8) bit places: a block by the high bits, eight places in it."""
    h = mix(h)
    block = (h >> U64(64 - bits + BLOCK_BITS)).astype(np.int64) << BLOCK_BITS
    g = mix(h + U64(0x632BE59BD9B4E019))
    return block[:, None] + np.stack([((g >> U64(7 * k)) & U64((1 << BLOCK_BITS) - 1)).astype(np.int64) for k in range(8)], 1)


def lookup_keys(url: Column) -> Column:
    """What a URL is looked up by: itself, and its host's endings."""
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.array_distinct(F.concat(F.array(canonical_url(url)), F.when(F.size(labels) > 1, ends).otherwise(F.array().cast("array<string>"))))


def bloom(hashes: DataFrame, bits: int) -> np.ndarray:
    """The filter's bytes. hashes: one long column. Each task gets the hashes of
    one slice."""
    whole = np.zeros((1 << bits) // 8, np.uint8)
    each = min(len(whole), SLICE)
    out_bits = each * 8

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            h = t.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((_where(h.view(U64), bits)[:, 0] // out_bits).astype(np.int32)), pa.array(h)], names=["slice", "h"])

    def build(key: tuple, t: pa.Table) -> pa.Table:
        flags = np.zeros(out_bits, bool)
        h = t.column("h").to_numpy().view(U64)
        for k in range(0, len(h), 1 << 17):
            flags[_where(h[k : k + (1 << 17)], bits).ravel() - key[0].as_py() * out_bits] = True
        blob = pack(np.packbits(flags, bitorder="little").tobytes())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})

    for r in hashes.mapInArrow(deal, "slice int, h long").groupBy("slice").applyInArrow(build, "slice int, blob binary").collect():
        whole[r["slice"] * each : (r["slice"] + 1) * each] = np.frombuffer(unpack(bytes(r.blob)), np.uint8)
    return whole


def in_bloom(flags: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    at = _where(h, bits)
    return ((flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, listed. `listed` has one
    column `canonical`; `rules` are (`host/path`, `allow` or `block`)."""
    spark = pages.sparkSession
    url = F.col(f"`{url_col}`").cast("string")
    names = listed.select(F.col("canonical").cast("string").alias("entry")).where("entry is not null and entry <> ''").distinct()
    count = names.count()
    bits = min(MAX_BITS, max(14, (12 * count).bit_length()))
    flags = spark.sparkContext.broadcast(bloom(names.select(F.xxhash64("entry").alias("h")), bits))
    keys = lookup_keys(url)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), canonical_url(url).alias("canonical"), F.transform(keys, lambda k: F.xxhash64(k)).alias("h"), keys.alias("keys"))
    kind = dict(rows.dtypes)["page_id"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            lists = t.column("h")
            own = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            hit = in_bloom(flags.value, lists.flatten().to_numpy().view(U64), bits)
            maybe = np.bincount(own, hit, len(lists)) > 0
            yield pa.RecordBatch.from_arrays([*t.columns[:4], t.column("keys"), pa.array(maybe)], names=[*t.schema.names[:4], "keys", "maybe"])

    probed = rows.mapInArrow(probe, f"page_id {kind}, host string, path string, canonical string, keys array<string>, maybe boolean")
    hits = probed.where("maybe")
    # The verdict follows from the canonical URL, so each is looked up once.
    sure = hits.select("canonical", "keys").distinct().select("canonical", F.explode("keys").alias("entry")).join(names, "entry").select("canonical").distinct().withColumn("listed", F.lit(True))
    judged = hits.join(sure, "canonical", "left").select("page_id", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed"))
    out = judged.unionByName(probed.where("not maybe").select("page_id", "host", "path", F.lit(False).alias("listed")))
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in r]) if rules else F.create_map(F.lit(""), F.lit(""))
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("rule").isNotNull(), F.element_at(verdicts, F.col("rule"))).when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")
