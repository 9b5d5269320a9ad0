"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized by
integral images, and written as NPY tiles with difference hashes.

`media_columns` takes a binary column and returns, per row, the NPY bytes of the
image's tiles, their count and a 64-bit difference hash. Images are cut into
square tiles; the last ones are filled with `fill`. Samples deeper than 8 bits
stay 16-bit in the tiles.

Defined results: null or undecodable media (short ones, headers that state more than
there is, samples above the stated maximum) give null tiles and hash, and `ok` false; images of any size are decoded (one image is one array in one task);
equal media give equal results; an empty table gives no rows; columns of the
input with names of the output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([^\s#]+)")


def decode_netpbm(b: bytes) -> np.ndarray:
    """P1 to P6: (rows, columns) or (rows, columns, 3); bits become 0 and 255."""
    kind = b[:2]
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a Netpbm image")
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(b, at)
        if not m:
            raise ValueError("short header")
        if not m[1].isdigit() or len(m[1]) > 10:
            raise ValueError("bad header")
        head.append(int(m[1]))
        at = m.end()
    w, h, top = (*head, 1)[:3]
    if w < 1 or h < 1 or not 0 < top < 65536:
        raise ValueError("bad header")
    deep = np.dtype(">u2" if top > 255 else np.uint8)
    planes = 3 if kind in (b"P3", b"P6") else 1
    # Before anything of the size that the header states is made.
    least = {b"P1": w * h, b"P4": h * ((w + 7) // 8), b"P5": w * h * deep.itemsize, b"P6": 3 * w * h * deep.itemsize}
    if len(b) - at < least.get(kind, 2 * w * h * planes - 1):
        raise ValueError("short image")
    if kind == b"P4":
        rows = np.frombuffer(b, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        a = np.where(np.unpackbits(rows, axis=1)[:, :w], 0, 255).astype(np.uint8)
    elif kind in (b"P5", b"P6"):
        a = np.frombuffer(b, deep, w * h * planes, at + 1)
    else:
        text = re.sub(rb"#[^\r\n]*", b"", b[at:])
        found = (re.findall(rb"[01]", text) if kind == b"P1" else text.split())[: w * h * planes]
        if len(found) < w * h * planes or any(not x.isdigit() or len(x) > 5 for x in found):
            raise ValueError("short image, or no samples")
        a = np.array([int(x) for x in found])
        if kind != b"P1" and a.max() > top:
            raise ValueError("a sample is above the maximum")
        a = np.where(a, 0, 255).astype(np.uint8) if kind == b"P1" else a.astype(deep)
    a = a.reshape((h, w, 3) if planes == 3 else (h, w))
    if kind in (b"P5", b"P6") and a.max() > top:
        raise ValueError("a sample is above the maximum")
    if top not in (1, 255, 65535) and kind not in (b"P1", b"P4"):
        full = 65535 if top > 255 else 255
        a = ((a.astype(np.uint32) * full + top // 2) // top).astype(deep)
    elif top == 1 and kind not in (b"P1", b"P4"):
        a = a * np.uint8(255)
    return a.astype(np.uint16) if deep.itemsize == 2 else a


def decode_bmp(b: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8 (palette), 24 or 32 bits: (rows, columns, 3)."""
    if b[:2] != b"BM" or len(b) < 30:
        raise ValueError("not a BMP image")
    u32 = lambda k: int.from_bytes(b[k : k + 4], "little")
    start, head = u32(10), u32(14)
    if head == 12:
        w, h, bits, comp = int.from_bytes(b[18:20], "little"), int.from_bytes(b[20:22], "little"), int.from_bytes(b[24:26], "little"), 0
    else:
        w, h = (int.from_bytes(b[k : k + 4], "little", signed=True) for k in (18, 22))
        bits, comp = int.from_bytes(b[28:30], "little"), u32(30)
    if comp not in (0, 3) or bits not in (1, 4, 8, 24, 32) or w < 1 or h == 0:
        raise ValueError("unsupported BMP image")
    step = (w * bits + 31) // 32 * 4
    if step * abs(h) > len(b) - start:
        raise ValueError("short image")
    rows = np.frombuffer(b, np.uint8, step * abs(h), start).reshape(abs(h), step)
    if bits >= 24:
        a = rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    else:
        index = {8: lambda: rows[:, :w], 4: lambda: np.stack([rows >> 4, rows & 15], 2).reshape(abs(h), -1)[:, :w], 1: lambda: np.unpackbits(rows, axis=1)[:, :w]}[bits]()
        cell = 3 if head == 12 else 4
        table = np.zeros((256, 3), np.uint8)
        n = max(0, min(1 << bits, (start - 14 - head) // cell))
        table[:n] = np.frombuffer(b, np.uint8, n * cell, 14 + head).reshape(n, cell)[:, 2::-1]
        a = table[index]
    return a[::-1] if h > 0 else a


def decode(b: bytes) -> np.ndarray:
    return decode_bmp(b) if b[:2] == b"BM" else decode_netpbm(b)


def encode_bmp(a: np.ndarray) -> bytes:
    """A grey image as an 8-bit BMP (bottom-up, grey palette)."""
    h, w = a.shape
    step = (w + 3) // 4 * 4
    rows = np.zeros((h, step), np.uint8)
    rows[:, :w] = a[::-1]
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    grey[:, 3] = 0
    n = 14 + 40 + 1024
    head = b"BM" + (n + rows.size).to_bytes(4, "little") + bytes(4) + n.to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (8).to_bytes(2, "little") + bytes(4) + rows.size.to_bytes(4, "little") + bytes(16)
    return head + info + grey.tobytes() + rows.tobytes()


def area_resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean over each target cell's exact area. The integral image is linear
    between whole coordinates, so cells may end inside a sample."""
    rows, cols = a.shape
    s = np.zeros((rows + 1, cols + 1))
    np.cumsum(a, axis=0, dtype=np.float64, out=s[1:, 1:])
    np.cumsum(s[1:, 1:], axis=1, out=s[1:, 1:])

    def at(edges: np.ndarray, x: np.ndarray, axis: int) -> np.ndarray:
        k = np.minimum(edges.astype(np.int64), x.shape[axis] - 2)
        f = edges - k
        f = f[:, None] if axis == 0 else f[None, :]
        return x.take(k, axis) * (1 - f) + x.take(k + 1, axis) * f

    s = at(np.arange(w + 1) * (cols / w), at(np.arange(h + 1) * (rows / h), s, 0), 1)
    return np.diff(np.diff(s, axis=0), axis=1) * (h * w / (rows * cols))


def grey(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else a[..., 0] * 0.299 + a[..., 1] * 0.587 + a[..., 2] * 0.114


def difference_hash(a: np.ndarray) -> str:
    """64 bits: of an 8 x 9 area resize, is a cell brighter than its left one."""
    x = np.round(area_resize(grey(a), 8, 9), 6)
    return np.packbits(x[:, 1:] > x[:, :-1]).tobytes().hex()


def tiles(a: np.ndarray, side: int, fill: int = 255) -> np.ndarray:
    """(tiles, side, side[, 3]) in reading order."""
    h, w = -(-a.shape[0] // side), -(-a.shape[1] // side)
    if (h * side, w * side) != a.shape[:2]:
        b = np.full((h * side, w * side, *a.shape[2:]), fill, a.dtype)
        b[: a.shape[0], : a.shape[1]] = a
        a = b
    a = a.reshape(h, side, w, side, *a.shape[2:]).swapaxes(1, 2)
    return np.ascontiguousarray(a).reshape(h * w, side, side, *a.shape[4:])


def npy(a: np.ndarray) -> bytes:
    """NPY 1.0 bytes of a C-ordered array."""
    head = f"{{'descr': '{a.dtype.str}', 'fortran_order': False, 'shape': {a.shape!r}, }}"
    head += " " * (-(10 + len(head) + 1) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + len(head).to_bytes(2, "little") + head.encode("latin-1") + a.tobytes()


_SHAPE = re.compile(r"\{'descr': '([^']+)', 'fortran_order': False, 'shape': \(([\d, ]*)\), \}\s*")


def read_npy(b: bytes) -> np.ndarray:
    if b[:8] != b"\x93NUMPY\x01\x00":
        raise ValueError("not NPY 1.0")
    n = int.from_bytes(b[8:10], "little")
    m = _SHAPE.fullmatch(b[10 : 10 + n].decode("latin-1"))
    if not m:
        raise ValueError("unsupported NPY header")
    return np.frombuffer(b, np.dtype(m[1]), offset=10 + n).reshape([int(x) for x in m[2].split(",") if x.strip()])


def media_columns(df: DataFrame, *, media_col: str = "media", side: int = 24) -> DataFrame:
    """`df` without the media and with `ok`, `tiles` (NPY bytes), `n_tiles` and
    `dhash`."""
    arrow_batches(df.sparkSession)
    new = {"ok": "boolean", "tiles": "binary", "n_tiles": "int", "dhash": "string"}
    keep = [f for f in df.schema if f.name != media_col and f.name.lower() not in new]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for k in range(0, len(t), 64):
                part = t.slice(k, 64)
                out: list[tuple] = []
                for x in part.column(len(names)):
                    try:
                        b = x.as_py()
                        a = decode(b)
                        cut = tiles(a, side)
                        out.append((True, npy(cut), len(cut), difference_hash(a)))
                    except (ValueError, TypeError, IndexError, OverflowError):
                        out.append((False, None, None, None))
                ok, data, n, hashes = zip(*out)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(ok), pa.array(data, pa.binary()), pa.array(n, pa.int32()), pa.array(hashes, pa.string())], names=[*names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"{k} {v}" for k, v in new.items())])
    return df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{media_col}`")).mapInArrow(run, schema)


def text_as_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", side: int = 24) -> DataFrame:
    """Each text's UTF-8 bytes, filled up with 255 to whole tiles, as a PGM image
    `side` wide: built by the JVM, lossless for any text (null: empty)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tile = side * side
    n = F.octet_length(text).cast("long")
    size = F.greatest(F.lit(1), F.ceil(n / tile)) * tile
    head = F.concat(F.lit(f"P5\n{side} "), (size / side).cast("long").cast("string"), F.lit("\n255\n"))
    media = F.concat(F.encode(head, "UTF-8"), F.encode(text, "UTF-8"), F.unhex(F.repeat(F.lit("FF"), (size - n).cast("int"))))
    return docs.select(F.col(id_col).alias("doc_id"), n.alias("n_bytes"), size.cast("long").alias("payload_bytes"), media.alias("media"))


def document_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", side: int = 24) -> DataFrame:
    """Per row the digests of the stored tiles and of what is read back."""
    import hashlib
    import zlib

    stored = media_columns(text_as_media(docs, id_col=id_col, text_col=text_col, side=side), side=side)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            sha, crc, size, own = [], [], [], []
            for x in t.column(3):
                b = x.as_buffer()
                back = read_npy(memoryview(b).tobytes()).tobytes()
                sha.append(hashlib.sha256(back).hexdigest())
                crc.append(zlib.crc32(back[-32:]))
                size.append(b.size)
                own.append(hashlib.sha256(b).hexdigest())
            ids, n, whole, _, dhash = t.columns
            yield pa.RecordBatch.from_arrays([ids, n, whole, pa.array(sha, pa.string()), pa.array(crc, pa.int64()), pa.array(size, pa.int64()), pa.array(own, pa.string()), dhash], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    return stored.select("doc_id", "n_bytes", "payload_bytes", "tiles", "dhash").mapInArrow(digests, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
