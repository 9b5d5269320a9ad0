"""Shared pieces: scratch tables, Arrow batches, byte-level word hashing."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import clean, cut, scratch_dir

__all__ = ["clean", "cut", "scratch_dir"]

#: Rows in one Arrow batch between the JVM and Python. Texts run to hundreds of
#: kilobytes, so the default of 10,000 rows could hold gigabytes.
ARROW_ROWS = 512
#: Bytes of text that one vectorised step works on.
SLICE_BYTES = 512 << 10
#: Bytes of text whose words are hashed at a time; a longer word stands alone.
WORD_BYTES = 64 << 10

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; every reader goes through Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def free(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --------------------------------------------------------------------- texts


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    if not (wide or pa.types.is_string(column.type)):
        column, wide = column.cast(pa.large_string()), True
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes; a longer text stands alone."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for r in (_R, _R_INV):
        x = np.full(n, U64(r))
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


@functools.lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(WORD_BYTES + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of each text, A-Z
    lower-cased, and per text the offset of its first word."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(offs), np.int64)
    d = LOWER[data]
    full = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = full.copy()
    start[1:] &= ~full[:-1] | edge[1:n]
    stop = full.copy()
    stop[:-1] &= ~full[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    h = np.empty(len(s), U64)
    i = 0
    while i < len(s):  # as many whole words as fit
        j = max(i + 1, int(np.searchsorted(e, s[i] + WORD_BYTES, "right")))
        a, b = int(s[i]), int(e[j - 1])
        up, down = _kept_powers() if b - a <= WORD_BYTES else _powers(b - a + 1)
        sums = np.empty(b - a + 1, U64)
        sums[0] = 0
        x = d[a:b].astype(U64)
        x += U64(1)
        x *= up[: b - a]
        np.cumsum(x, out=sums[1:])
        h[i:j] = (sums[e[i:j] - a] - sums[s[i:j] - a]) * down[s[i:j] - a]
        i = j
    return mix(h ^ ((e - s).astype(U64) << U64(48))), np.searchsorted(s, offs).astype(np.int64)


def pack(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b)


def unpack(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)
