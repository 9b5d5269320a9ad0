"""Sharding by a hypergeometric communication matrix.

A uniform shuffle with exact shard sizes: draw how many rows of each source
partition go to each shard, permute every partition locally, exchange, and
permute every shard again.

The matrix is never held whole. Its rows follow from a tree over the source
partitions: at each node the shards' remaining room is split between the two
halves by one multivariate hypergeometric draw, seeded by the node; a task walks
from the root to its own partition's row, in shards x log(partitions) draws. Column
sums are exact by construction. Draws are exact at any size: numpy's up to its limit
of 10^9 rows, beyond it by rejection from a log-concave envelope, with ratios of
probabilities in 60 digits.

A shard may be larger than a task: its second permutation is an order by random
64-bit keys. Keys fall into even ranges of about `block_rows` rows, ranges are counted,
and each is ordered on its own and numbered from where the ranges before it end; so the
work is in proportion to the rows, whatever the number of partitions and shards.

Law `rows`: shard sizes differ by at most one. Texts do not move, only ids,
sizes and checksums. The source partitions and their permutations are written
down before counts are taken, so a lost executor changes nothing. Every run on the
same written partitions gives the same result; other partitions give another
uniform draw.

Defined results: null texts have size 1 and the checksum of no bytes; texts of any
length only give their size and checksum; null ids, ties and repeated rows are rows
like any other; an empty table gives no rows; columns of the input with the names of
the results are replaced.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, cut, free

BLOCK_ROWS = 50_000
#: numpy draws hypergeometric counts from populations below this.
NUMPY_LIMIT = 1_000_000_000
_DIGITS = Context(prec=60)


@functools.lru_cache(maxsize=1)
def _half_ln_tau() -> Decimal:
    """ln(2 pi) / 2, with pi by Machin's series."""
    one = 10**80

    def arctan_inverse(n: int) -> int:
        total = term = one // n
        k, sign = 1, -1
        while term:
            term //= n * n
            k += 2
            total += sign * (term // k)
            sign = -sign
        return total

    pi = 4 * (4 * arctan_inverse(5) - arctan_inverse(239))
    return _DIGITS.divide(_DIGITS.ln(_DIGITS.divide(Decimal(2 * pi), Decimal(one))), Decimal(2))


#: Numerators and denominators of Stirling's series, B(2k) / (2k (2k - 1)).
_STIRLING = ((1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188), (-691, 360360), (1, 156), (-3617, 122400))


def ln_factorial(n: int) -> Decimal:
    """ln(n!) to more than 40 digits."""
    c = _DIGITS
    if n < 3000:
        return c.ln(Decimal(math.factorial(n)))
    z = Decimal(n)
    out = c.add(c.subtract(c.multiply(c.add(z, Decimal("0.5")), c.ln(z)), z), _half_ln_tau())
    power, square = z, c.multiply(z, z)
    for a, b in _STIRLING:
        out = c.add(out, c.divide(Decimal(a), c.multiply(Decimal(b), power)))
        power = c.multiply(power, square)
    return out


def exact_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among `draws` of good + bad. With the mode's probability p, a
    log-concave law is nowhere above p min(1, exp(1 + p / 2 - p |x - mode|)) in the
    half-unit around x: candidates come from that envelope."""
    low, high = max(0, draws - bad), min(good, draws)
    if low >= high:
        return low
    mode = (draws + 1) * (good + 1) // (good + bad + 2)
    mode = min(max(mode, low), high)
    c = _DIGITS
    inverse = lambda x: functools.reduce(c.add, (ln_factorial(v) for v in (x, good - x, draws - x, bad - draws + x)))
    at_mode = inverse(mode)
    # C(good, x) C(bad, draws - x) / C(good + bad, draws)
    whole = functools.reduce(c.add, (ln_factorial(good), ln_factorial(bad), ln_factorial(draws), ln_factorial(good + bad - draws), -ln_factorial(good + bad)))
    p = float(c.exp(c.subtract(whole, at_mode))) * (1 - 1e-9)  # a little less keeps the envelope above
    w = 1 + p / 2
    while True:
        u, v, z, e = rng.random(), rng.random(), rng.random(), rng.exponential()
        y = v * w / p if u <= w / (1 + w) else (w + e) / p
        x = mode + (1 if z < 0.5 else -1) * round(y)
        if not low <= x <= high:
            continue
        top = min(0.0, w - p * y)
        if Decimal(-rng.exponential()) + Decimal(top) <= c.subtract(at_mode, inverse(x)):
            return x


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if good + bad >= NUMPY_LIMIT:
        return exact_hypergeometric(rng, good, bad, draws)
    return int(rng.hypergeometric(good, bad, draws)) if draws and good else 0


def generator(*seed: int) -> np.random.Generator:
    """Counter-based, so that each node and partition has a stream of its own."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence(seed)))


def split_room(room: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Multivariate hypergeometric: of `draws` rows, how many each shard takes."""
    if room.sum() < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(room, draws, method="marginals")
    out, rest = np.zeros_like(room), int(room.sum())
    for k, good in enumerate(room.tolist()):
        rest -= good
        out[k] = hypergeometric(rng, good, rest, draws)
        draws -= int(out[k])
    return out


def matrix_row(p: int, before: np.ndarray, room: np.ndarray, seed: int) -> np.ndarray:
    """Row p of the matrix: how many of partition p's rows each shard takes. before:
    rows in partitions ahead of each, and all."""
    lo, hi = 0, len(before) - 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split_room(room, int(before[mid] - before[lo]), generator(seed, lo, hi))
        if p < mid:
            room, hi = left, mid
        else:
            room, lo = room - left, mid
    return room


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def hypergeometric_shards(docs: DataFrame, *, shards: int = 16, seed: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every row of `docs` (any light columns) with its `shard` and `slot`."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")])
    names = docs.columns
    part, place, key = (free(docs, n) for n in ("wm_part", "wm_place", "wm_key"))
    block, first = free(docs, "wm_block"), free(docs, "wm_first")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            p = TaskContext.get().partitionId()
            t = t.append_column(part, pa.array(np.full(len(t), p, np.int64))).append_column(place, pa.array(generator(seed, 1, p).permutation(len(t))))
            yield from t.to_batches(max_chunksize=10_000)

    rows = cut(docs.mapInArrow(permute, f"{schema}`{part}` long, `{place}` long"))
    # One count per source partition: as many as the input has splits.
    counts = {r[0]: r[1] for r in rows.groupBy(part).count().collect()}
    ids = sorted(counts)
    before = np.concatenate([[0], np.cumsum([counts[p] for p in ids])]).astype(np.int64)
    room = shard_sizes(int(before[-1]), shards)
    blocks = max(1, -(-int(room.max()) // block_rows))
    plan = docs.sparkSession.sparkContext.broadcast((np.array(ids), before))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, before = plan.value
        edges: dict[int, np.ndarray] = {}
        keys: dict[int, np.ndarray] = {}
        for t in batches:
            own, at = t.column(part).to_numpy(), t.column(place).to_numpy()
            shard, random = np.empty(len(own), np.int32), np.empty(len(own), np.int64)
            for p in np.unique(own).tolist():
                if p not in edges:
                    k = int(np.searchsorted(ids, p))
                    edges[p] = np.cumsum(matrix_row(k, before, room, seed))
                    # A key for each place, whichever batch it comes in.
                    keys[p] = generator(seed, 2, p).integers(0, 1 << 64, int(before[k + 1] - before[k]), U64)
                mine = own == p
                shard[mine] = np.searchsorted(edges[p], at[mine], "right")
                random[mine] = keys[p][at[mine]].view(np.int64)
            high = (random.view(U64) >> U64(32)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(shard), pa.array(high * blocks >> 32), pa.array(random)], names=[*t.schema.names, "shard", block, key])

    dealt = rows.mapInArrow(deal, f"{schema}`{part}` long, `{place}` long, shard int, `{block}` long, `{key}` long")
    # Where each range of keys begins: a row per range.
    upto = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", block).count().select("shard", block, F.coalesce(F.sum("count").over(upto), F.lit(0)).alias(first))

    def settle(key_: tuple, t: pa.Table) -> pa.Table:
        # Unsigned order; equal keys, should they occur, by partition and place.
        o = np.lexsort((t.column(place).to_numpy(), t.column(part).to_numpy(), t.column(key).to_numpy().view(U64)))
        t = t.take(pa.array(o))
        slot = t.column(first)[0].as_py() + np.arange(len(t), dtype=np.int64)
        return t.select([*names, "shard"]).append_column("slot", pa.array(slot))

    return dealt.join(starts, ["shard", block]).groupBy("shard", block).applyInArrow(settle, f"{schema}shard int, slot long")


def shard_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    light = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = hypergeometric_shards(light, shards=shards, seed=seed, block_rows=block_rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
