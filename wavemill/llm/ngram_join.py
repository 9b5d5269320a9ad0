"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional
and suffix filters, joined on prefix n-grams and verified once per pair.

A text's set is its distinct word shingles. Two texts link when their sets'
Jaccard similarity reaches the threshold; the result gives each row the
smallest doc_id that links reach and, if asked, the number of rows that it links
with.

How the work is laid out:

* Equal word sequences are one *class*; only classes are compared, so a group
  of thousands of copies costs as much as one text.
* A scan of the texts sends every class's shingles, sorted, packed as
  differences and cut into buckets of the shingle space. A bucket counts in how
  many classes each shingle occurs. A shingle of one class can link nothing and
  goes no further: only its number stays, as the set's size is known. Shingles of
  very many classes (lines that a good part of the texts hold) would fill a bucket: the
  first scan finds them window by window, and they skip the count, going to their
  classes with the number of times that they were found instead.
* What is shared returns to its class, again packed. There the set is put in
  rare-first order: first the shingles of this class alone, then by count and hash.
  Those of the prefix that are shared are posted; a class whose prefix is its own
  alone posts nothing and is done.
* In a bucket, each posting list ties classes that pass the length filter (and the
  positional one, for lists of two) to one of them: as many ties as entries.
  Components of these ties are *families*: only inside one can two classes link. A
  family of up to `BLOCK` shingles meets in one task, where its posting lists are
  made again: sets move once, however many shingles they share.
* Of a larger family, pairs and blocks meet list by list: lists of up to `LIST`
  classes give pairs, longer ones are cut into blocks of bounded size. No list is
  dropped. A pair that meets in several lists counts in that of its first common
  shingle, rare-first, alone.
* However sets meet, candidates are pairs with a common prefix shingle that pass
  the length filter, the positional filter at their first common shingle, and the
  suffix filter (parts of two sets between the same bounds hold at most the smaller
  part in common); each is verified once, with the shared shingles alone: looked up
  one by one, or as rows of a product where most of a family are candidates.
* Links are summed where they are found: a task returns for each class how many rows
  it links with there and one class that it is connected to, so a group of k near
  copies sends k rows, not its k^2 links. Copies count as often as they occur.

Sizes and the very common shingles reach the driver; the latter, 2^17 at most by the
limit that makes them common, are broadcast.

Defined results: null or wordless text has an empty set and links with nothing;
fewer words than `n` make one shingle of the whole sequence; texts of any length
have whole sets; repeated rows and equal texts link with each other; rows without
doc_id take part and have the smallest known doc_id of their component; an empty
table gives no rows; only the id and text columns are read, so others may have any
names. Classes are 96-bit and shingles 64-bit hashes: k distinct texts are wrongly
merged with probability about k^2 / 2^97, two sets of m shingles wrongly share one
with probability about m^2 / 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow_batches, cut, mix, pack, parts, slices, unpack, utf8, words

#: Longest posting list whose pairs are listed one by one.
LIST = 8
#: Shared shingles of all sets that meet in one task.
BLOCK = 1_000_000
#: Shingles that a task holds before it sends them on.
FLUSH = 1_000_000
#: Classes that a task remembers, so as not to send their copies.
SEEN = 200_000
#: Shingles in a bucket, about.
BUCKET = 3_000_000
#: A shingle is found often if so many classes of a window of so many shingles hold it;
#: it skips the count if it was found so often in all, or a 2^17th of all shingles.
WINDOW, OFTEN, COMMON = 1_000_000, 16, 750_000
#: Candidates, or cells of a table of common shingles, at a time.
TILE = 1_000_000
#: What meets: a whole family, a class and its candidates, one or two blocks of a list.
FAMILY, HUB, SPOKE, LEFT, RIGHT = range(5)
CLASS = "decimal(38,0)"


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, classes (low, high; 0, 0: no words), offsets, hashes): per text its
    class and distinct shingle hashes in ascending order."""
    data, offs = utf8(column)
    for a, b in slices(offs):
        w, at = words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        count = np.diff(at)
        row = np.repeat(np.arange(b - a), count)
        place = (np.arange(len(w)) - at[row]).astype(U64)
        some = count > 0
        low, high = np.zeros(b - a, U64), np.zeros(b - a, np.uint32)
        if some.any():
            k, first = count[some].astype(U64), at[:-1][some]
            low[some] = mix(np.add.reduceat(mix(w + place * U64(0xD6E8FEB86659FD93)), first) ^ k)
            high[some] = mix(np.add.reduceat(mix((w ^ U64(0x2545F4914F6CDD1D)) + place * U64(0xA0761D6478BD642F)), first) + k) >> U64(32)
        if len(w) >= n:
            h = np.zeros(len(w) - n + 1, U64)
            for k in range(n):
                h = (h ^ w[k : len(w) - n + 1 + k]) * U64(0x9FB21C651E98DF25)
                h ^= h >> U64(28)
            h = mix(h)
            inside = row[: len(h)] == row[n - 1 :]
            h, own = h[inside], row[: len(h)][inside]
        else:
            h, own = np.zeros(0, U64), np.zeros(0, np.int64)
        short = np.flatnonzero(some & (count < n))
        if len(short):
            h, own = np.concatenate([h, mix(low[short] + U64(n))]), np.concatenate([own, short])
            o = np.argsort(own, kind="stable")
            h, own = h[o], own[o]
        bound = np.searchsorted(own, np.arange(b - a + 1))
        sets = [np.unique(h[i:j]) for i, j in zip(bound[:-1].tolist(), bound[1:].tolist())]
        lens = np.array([0, *map(len, sets)], np.int64)
        yield a, low, high, np.cumsum(lens), (np.concatenate(sets) if sets else np.zeros(0, U64))


def least_overlap(x, y, num: int, den: int):
    """Least intersection of sets of x and y elements with Jaccard >= num/den."""
    return -(-num * (x + y) // (num + den))


# Classes: two columns in numpy, one decimal in Spark.


def _classes(low: np.ndarray, high: np.ndarray) -> pa.Array:
    raw = np.stack([low.astype(U64), high.astype(U64)], 1)
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw))])


def _split(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, U64), np.zeros(0, np.uint32)
    raw = np.frombuffer(column.buffers()[1], U64).reshape(-1, 2)[column.offset : column.offset + len(column)]
    return raw[:, 0].copy(), raw[:, 1].astype(np.uint32)


def _merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct classes in order, and the place of each given one among them."""
    o = np.lexsort((high, low))
    a, b = low[o], high[o]
    new = np.ones(len(o), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    code = np.empty(len(o), np.int64)
    code[o] = np.cumsum(new) - 1
    return a[new], b[new], code


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


# Packed tables of a few columns: those of 8 bytes are stored as differences; all
# first bytes of a column, then all second bytes, and so on.

_KINDS = {1: np.dtype(np.uint8), 2: np.dtype(np.uint16), 4: np.dtype(np.uint32), 8: np.dtype(U64)}


def pack_table(*columns: np.ndarray) -> bytes:
    out = [np.array([len(columns), *(x for c in columns for x in (c.dtype.itemsize, len(c)))], np.uint32).tobytes()]
    for c in columns:
        if c.dtype.itemsize == 8:
            c = np.diff(c, prepend=U64(0))
        out.append(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes())
    return pack(b"".join(out))


def unpack_table(b: bytes) -> list[np.ndarray]:
    b = unpack(b)
    k = int(np.frombuffer(b, np.uint32, 1)[0])
    head = np.frombuffer(b, np.uint32, 2 * k, 4).tolist()
    at, out = 4 + 8 * k, []
    for size, n in zip(head[0::2], head[1::2]):
        c = np.ascontiguousarray(np.frombuffer(b, np.uint8, n * size, at).reshape(size, n).T).view(_KINDS[size]).ravel()
        out.append(np.cumsum(c, dtype=U64) if size == 8 else c)
        at += n * size
    return out


def _named(code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of classes by number: the ones that occur, and each entry's place among them
    in as few bytes as they need."""
    used = np.zeros(len(low), bool)
    used[code] = True
    own = (np.cumsum(used) - 1)[code]
    return low[used], high[used], own.astype(np.uint16 if int(used.sum()) <= 1 << 16 else np.uint32)


def _together(blobs: Iterator, more: int) -> list[np.ndarray]:
    """Packed tables (hash, classes, class of each entry, ...) as one: distinct
    classes, then the columns."""
    tok, low, high, code = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    rest: list[list[np.ndarray]] = [[np.zeros(0, np.uint32)] for _ in range(more)]
    base = 0
    for blob in blobs:
        t, a, b, own, *others = unpack_table(blob.as_py())
        tok.append(t)
        low.append(a)
        high.append(b)
        code.append(own.astype(np.int64) + base)
        base += len(a)
        for r, x in zip(rest, others):
            r.append(x)
    a, b, place = _merged(np.concatenate(low), np.concatenate(high))
    return [a, b, np.concatenate(tok), place[np.concatenate(code)], *map(np.concatenate, rest)]


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hashes."""
    return (h >> U64(64 - (buckets - 1).bit_length())).astype(np.int32) if buckets > 1 else np.zeros(len(h), np.int32)


def _cuts(x: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal values."""
    if not len(x):
        return []
    edge = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]).tolist()
    return list(zip(edge[:-1], edge[1:]))


def _rows(key: str, blobs: dict[int, bytes]) -> pa.Table:
    return pa.table({key: pa.array(list(blobs), pa.int32()), "blob": pa.array(list(blobs.values()), pa.binary())})


# ---------------------------------------------------------------------- stages


def _light(n: int):
    """Per row: doc_id, class, size of its set. Per window: shingles that many of its
    classes hold, and how many do."""
    names = ["doc_id", "cls", "n_shingles", "tok", "hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def often() -> pa.RecordBatch:
            tok = np.sort(np.concatenate(held))
            edge = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            hits = np.diff(np.append(edge, len(tok)))
            many = hits >= OFTEN
            k = int(many.sum())
            return pa.record_batch([pa.nulls(k, pa.int64()), pa.nulls(k, pa.decimal128(38, 0)), pa.nulls(k, pa.int64()), _long(tok[edge[many]]), pa.array(hits[many], pa.int64())], names=names)

        for t in batches:
            ids = t.column(0)
            for a, low, high, at, h in shingle_sets(t.column(1), n):
                k, lens = len(low), np.diff(at)
                yield pa.record_batch([ids.slice(a, k), _classes(low, high), pa.array(lens), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
                fresh = np.zeros(k, bool)
                for i, c in enumerate(low.tolist()):
                    if c not in seen:
                        seen.add(c)
                        fresh[i] = True
                held.append(h[np.repeat(fresh, lens)])
                size += len(held[-1])
                if size >= WINDOW:
                    yield often()
                    seen, held, size = set(), [], 0
        if size:
            yield often()

    return run


def _scan(n: int, buckets: int, common):
    """Per task and bucket: the shingles of its classes, each class once. Common ones
    (ascending, with their counts) go to buckets -1, -2, ...: those of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, hits = common.value
        seen: set[int] = set()
        held: list[list[np.ndarray]] = [[], [], [], []]
        size = names = 0

        def flush() -> Iterator[pa.RecordBatch]:
            tok, code, low, high = map(np.concatenate, held)
            o = np.argsort(tok)
            tok, code = tok[o], code[o]
            if len(often):
                at = np.minimum(np.searchsorted(often, tok), len(often) - 1)
                skip = often[at] == tok
                part = _bucket_of(mix(low), buckets)[code[skip]]
                o = np.argsort(part, kind="stable")
                t, c, k, part = tok[skip][o], code[skip][o], hits[at[skip]][o], part[o]
                for i, j in _cuts(part):
                    blob = pack_table(t[i:j], *_named(c[i:j], low, high), k[i:j])
                    yield pa.record_batch([pa.array([-1 - int(part[i])], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "blob"])
                tok, code = tok[~skip], code[~skip]
            where = _bucket_of(tok, buckets)
            for i, j in _cuts(where):
                blob = pack_table(tok[i:j], *_named(code[i:j], low, high))
                yield pa.record_batch([pa.array([int(where[i])], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "blob"])

        for t in batches:
            for _, low, high, at, h in shingle_sets(t.column(0), n):
                fresh = np.zeros(len(low), bool)
                for k, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
                    c = b << 64 | a
                    if c and c not in seen:
                        fresh[k] = True
                        if len(seen) < SEEN:
                            seen.add(c)
                lens = np.diff(at)
                for own, x in zip(held, (h[np.repeat(fresh, lens)], np.repeat(np.arange(int(fresh.sum())) + names, lens[fresh]), low[fresh], high[fresh])):
                    own.append(x)
                size, names = size + len(held[0][-1]), names + len(held[2][-1])
                if size >= FLUSH:
                    yield from flush()
                    held, size, names = [[], [], [], []], 0, 0
        if size:
            yield from flush()

    return run


def _shared(classes: int):
    """Of a bucket, the shingles of two classes or more, dealt out by class."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:  # common shingles, on their way to their classes
            return pa.table({"part": pa.array([-1 - key[0].as_py()] * len(t), pa.int32()), "blob": t.column("blob")})
        low, high, tok, code = _together(t.column("blob"), 0)
        o = np.argsort(tok)
        tok = tok[o]
        twin = np.zeros(len(tok), bool)
        twin[1:] = tok[1:] == tok[:-1]
        twin[:-1] |= twin[1:]
        tok, code = tok[twin], code[o[twin]]
        o = np.lexsort((code, tok))
        tok, code = tok[o], code[o]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (code[1:] != code[:-1])
        tok, code = tok[new], code[new]
        edge = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([edge, [len(tok)]]))[: len(edge)]
        count = np.repeat(size, size).astype(np.uint32)
        two = count > 1
        tok, code, count = tok[two], code[two], count[two]
        part = _bucket_of(mix(low), classes)[code]
        o = np.argsort(part, kind="stable")
        tok, code, count, part = tok[o], code[o], count[o], part[o]
        return _rows("part", {int(part[i]): pack_table(tok[i:j], *_named(code[i:j], low, high), count[i:j]) for i, j in _cuts(part)})

    return run


def _prefixes(num: int, den: int, buckets: int):
    """Of a part of the classes: each class's shared shingles (rare-first) with the
    number of posted ones, and by bucket the postings of prefixes. Sizes come as rows
    of (cls, n, w), w being the number of its rows."""

    def run(key: tuple, shared: pa.Table, sizes: pa.Table) -> pa.Table:
        names = {"cls": pa.decimal128(38, 0), "low": pa.int64(), "n": pa.int64(), "w": pa.int64(), "posted": pa.int64(), "bucket": pa.int32(), "blob": pa.binary()}
        low, high, tok, cls, count = _together(shared.column("blob"), 1)
        known = _split(sizes.column("cls"))
        _, _, code = _merged(np.concatenate([known[0], low]), np.concatenate([known[1], high]))
        size, copies = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        size[code[: len(known[0])]], copies[code[: len(known[0])]] = sizes.column("n").to_numpy(), sizes.column("w").to_numpy()
        code = code[len(known[0]) :]
        # rare-first inside each class
        o = np.lexsort((tok, count, cls))
        tok, cls = tok[o], cls[o]
        new = np.ones(len(tok), bool)  # common ones come from every task that has a copy
        new[1:] = (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])
        tok, cls = tok[new], cls[new]
        edge = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])) if len(cls) else np.zeros(0, np.int64)
        shares = np.diff(np.concatenate([edge, [len(cls)]]))[: len(edge)].astype(np.int64)
        n, w = size[code[cls[edge]]], copies[code[cls[edge]]]
        alone = n - shares
        reach = n - -(-num * n // den) + 1  # length of the prefix
        place = np.arange(len(cls)) - np.repeat(edge, shares) + np.repeat(alone, shares)
        posted = place < np.repeat(reach, shares)
        some = alone < reach
        blobs = [tok[i : i + m].astype("<u8").tobytes() for i, m in zip(edge[some].tolist(), shares[some].tolist())]
        own = cls[edge][some]
        tables = [pa.table({"cls": _classes(low[own], high[own]), "low": _long(low[own]), "n": n[some], "w": w[some], "posted": np.minimum(reach - alone, shares)[some], "bucket": pa.nulls(len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})]
        p_tok, p_cls, p_place, p_n = tok[posted], cls[posted], place[posted].astype(np.uint32), np.repeat(n, shares)[posted].astype(np.uint32)
        o = np.argsort(p_tok, kind="stable")
        p_tok, p_cls, p_place, p_n = p_tok[o], p_cls[o], p_place[o], p_n[o]
        where = _bucket_of(p_tok, buckets)
        cuts = _cuts(where)
        blobs = [pack_table(p_tok[i:j], *_named(p_cls[i:j], low, high), p_place[i:j], p_n[i:j]) for i, j in cuts]
        k = len(blobs)
        tables.append(pa.table({**{c: pa.nulls(k, names[c]) for c in ("cls", "low", "n", "w", "posted")}, "bucket": pa.array([int(where[i]) for i, _ in cuts], pa.int32()), "blob": pa.array(blobs, pa.binary())}))
        return pa.concat_tables([x.cast(pa.schema(list(names.items()))) for x in tables])

    return run


def _lists(t: pa.Table) -> tuple[np.ndarray, ...]:
    """A bucket's posting lists, each in order of set size: classes (low, high), then
    (class, size, position) of the entries, first entry and length of each list."""
    low, high, tok, cls, pos, n = _together(t.column("blob"), 2)
    o = np.lexsort((cls, n, tok))
    tok, cls, n, pos = tok[o], cls[o], n[o].astype(np.int64), pos[o].astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, np.int64)
    return low, high, cls, n, pos, edge, np.diff(np.concatenate([edge, [len(tok)]]))[: len(edge)]


def _families(num: int, den: int):
    """Edges (a, b) that put any two classes that may link into one family: in each
    list, a run whose sizes pass the length filter is tied to its first class. As
    many edges as entries, at most. Half of a class's hash names it here: two classes
    of one name are in one family, which is no fault."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        low, _, cls, n, pos, edge, size = _lists(t)
        if not len(cls):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        first = np.zeros(len(cls), bool)
        first[edge] = True
        first[1:] |= n[:-1] * den < n[1:] * num
        two = edge[size == 2]
        first[two + 1] |= np.minimum(n[two] - pos[two], n[two + 1] - pos[two + 1]) < least_overlap(n[two], n[two + 1], num, den)
        hub = cls[np.flatnonzero(first)[np.cumsum(first) - 1]]
        pair = np.unique(hub[~first] * len(low) + cls[~first])
        return pa.table({"a": _long(low[pair // len(low)]), "b": _long(low[pair % len(low)])})

    return run


def _meet(num: int, den: int):
    """Of a bucket's postings, who meets whom where a family is too large for one
    task: (gid, cls, kind, at). A hub and its spokes are a class and those that it may
    link with; LEFT and RIGHT are a block, or two, of a longer list. `at` is the place
    of the list's shingle in a set (the hub's, for spokes)."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        low, high, cls, n, pos, edge, size = _lists(t)
        x, y, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(2, LIST + 1):
            start = edge[size == k]
            if not len(start):
                continue
            for i in range(k - 1):
                a = start + i
                for j in range(i + 1, k):
                    b = start + j  # not shorter than a
                    ok = (n[a] * den >= n[b] * num) & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= least_overlap(n[a], n[b], num, den))
                    c, d = cls[a[ok]], cls[b[ok]]
                    x.append(np.minimum(c, d))
                    y.append(np.maximum(c, d))
                    at.append(np.where(c < d, pos[a[ok]], pos[b[ok]]))
        x, y, at = map(np.concatenate, (x, y, at))
        o = np.lexsort((at, y, x))
        x, y, at = x[o], y[o], at[o]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        x, y, at = x[new], y[new], at[new]
        hub = np.unique(x)
        groups = [(low[x], high[x]), (low[hub], high[hub])]
        members, kinds, places = [y, hub], [np.full(len(x), SPOKE), np.full(len(hub), HUB)], [at, np.zeros(len(hub), np.int64)]
        best: dict[tuple[int, int], tuple] = {}
        for i, m in zip(edge[size > LIST].tolist(), size[size > LIST].tolist()):
            block = (np.cumsum(n[i : i + m]) - n[i]) // BLOCK
            runs = _cuts(block)
            for a in range(len(runs)):
                for b in range(a, len(runs)):
                    if a != b and n[i + runs[a][1] - 1] * den < n[i + runs[b][0]] * num:
                        continue
                    own = np.arange(i + runs[a][0], i + runs[a][1])
                    kind = np.full(len(own), LEFT)
                    if a != b:
                        own = np.concatenate([own, np.arange(i + runs[b][0], i + runs[b][1])])
                        kind = np.concatenate([kind, np.full(len(own) - len(kind), RIGHT)])
                    # Lists of the same members are one group, at their first shingle.
                    salt = kind.astype(U64) + U64(len(own))
                    g = int(np.add.reduce(mix(low[cls[own]] + mix(salt)))), int(np.add.reduce(mix(low[cls[own]] ^ mix(salt + U64(9)))) >> U64(32))
                    if g not in best or pos[own[0]] < pos[best[g][0][0]]:
                        best[g] = own, kind
        for g, (own, kind) in best.items():
            groups.append((np.full(len(own), g[0], U64), np.full(len(own), g[1], np.uint32)))
            members.append(cls[own])
            kinds.append(kind)
            places.append(pos[own])
        member = np.concatenate(members)
        gid = [np.concatenate(c) for c in zip(*groups)]
        return pa.table({"gid": _classes(*gid), "cls": _classes(low[member], high[member]), "kind": pa.array(np.concatenate(kinds), pa.int32()), "at": pa.array(np.concatenate(places), pa.int64())})

    return run


# ---------------------------------------------------------------- verification


class _Sets:
    """Sets that meet in one task, in order of size (n); of each, its shared shingles
    rare-first. Answers how much two of them have in common."""

    def __init__(self, n: np.ndarray, sets: list[np.ndarray]):
        self.n, self.m = n, len(sets)
        self.len = np.array([len(x) for x in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.len)])
        tok, row = np.concatenate(sets), np.repeat(np.arange(self.m), self.len)
        # Parts of each set between the same bounds, for the suffix filter.
        self.part = np.bincount(row * 16 + (tok >> U64(60)).astype(np.int64), minlength=16 * self.m).reshape(-1, 16).astype(np.int32)
        o = np.argsort(tok, kind="stable")
        name = np.cumsum(np.diff(tok[o], prepend=tok[o][:1]) != 0)
        self.code = np.empty(len(tok), np.int64)
        self.code[o] = name
        size = np.bincount(name)
        # What a good part of the sets hold is multiplied as a matrix, the rest is
        # looked up in lists: a row of the product costs this much.
        self.wide = 8 * size >= max(self.m, 32) if len(size) else np.zeros(0, bool)
        self.size = np.where(self.wide, 0, size)
        self.cost = np.concatenate([[0], np.cumsum(self.m * (1 + self.wide.sum() // 32) + np.bincount(row, weights=self.size[self.code], minlength=self.m).astype(np.int64))])
        self.order, self.row = o, row
        self.mark = np.zeros(len(size), bool)
        self.matrix: np.ndarray | None = None

    def may(self, x: np.ndarray, y: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The suffix filter."""
        out = np.empty(len(x), bool)
        for k in range(0, len(x), 1 << 17):
            s = slice(k, k + (1 << 17))
            out[s] = np.minimum(self.part[x[s]], self.part[y[s]]).sum(1) >= need[s]
        return out

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How much the pairs have in common; x ascends."""
        if not len(x):
            return np.zeros(0, np.int64)
        runs = _cuts(x)
        a, b = int(x[0]), int(x[-1]) + 1
        if self.len[y].sum() + 2000 * len(runs) > self.cost[b] - self.cost[a] and (b - a) * self.m <= 8 * TILE:
            return self._rows(a, b)[x - a, y]
        out = np.empty(len(x), np.int64)
        for i, j in runs:
            own = self.code[self.at[x[i]] : self.at[x[i] + 1]]
            self.mark[own] = True
            n = self.len[y[i:j]]
            stop = np.cumsum(n)
            hit = self.mark[self.code[np.arange(int(stop[-1])) + np.repeat(self.at[y[i:j]] - stop + n, n)]]
            upto = np.concatenate([[0], np.cumsum(hit)])
            out[i:j] = upto[stop] - upto[stop - n]
            self.mark[own] = False
        return out

    def _rows(self, a: int, b: int) -> np.ndarray:
        """(b - a, sets): what sets a to b have in common with each."""
        if self.matrix is None:
            self.matrix = np.zeros((self.m, int(self.wide.sum())), np.float32)
            mine = self.wide[self.code]
            self.matrix[self.row[mine], (np.cumsum(self.wide) - 1)[self.code[mine]]] = 1
            few = ~self.wide[self.code[self.order]]
            self.members, self.start = self.row[self.order][few], np.cumsum(self.size) - self.size
        out = (self.matrix[a:b] @ self.matrix.T).astype(np.int64)
        c = self.code[self.at[a] : self.at[b]]
        few = ~self.wide[c]
        row, c = np.repeat(np.arange(b - a), self.len[a:b])[few], c[few]
        if len(c):
            size = self.size[c]
            flat = np.repeat(self.start[c] - np.cumsum(size) + size, size) + np.arange(size.sum())
            out += np.bincount(np.repeat(row, size) * self.m + self.members[flat], minlength=out.size).reshape(out.shape)
        return out


Pairs = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _by_prefix(s: _Sets, posted: np.ndarray, num: int, den: int) -> Pairs:
    """(x, y, least overlap) of pairs with a common prefix shingle that pass the
    length filter, and the positional one at their first; x ascends."""
    m, n = s.m, s.n
    own = np.repeat(np.arange(m), posted)
    k = np.arange(len(own)) - np.repeat(np.cumsum(posted) - posted, posted)
    code, pos = s.code[s.at[own] + k], (n - s.len)[own] + k
    o = np.lexsort((own, code))
    row, place = own[o], pos[o]
    where = np.empty(len(o), np.int64)
    where[o] = np.arange(len(o))
    # Sets are in order of size, so partners that pass the length filter follow.
    stop = np.searchsorted(code[o] * (m + 1) + row, code * (m + 1) + np.searchsorted(n, n * den // num, "right")[own])
    count = np.maximum(stop - where - 1, 0)
    first = np.concatenate([[0], np.cumsum(posted)])
    upto = np.concatenate([[0], np.cumsum(count)])[first]
    for a, b in _cuts(upto[:-1] // TILE):
        i, j = first[a], first[b]
        c = count[i:j]
        total = int(c.sum())
        if not total:
            continue
        entry = np.repeat(np.arange(i, j), c)
        partner = np.arange(total) + np.repeat(where[i:j] + 1 - np.cumsum(c) + c, c)
        key = (own[entry] - a) * m + row[partner]
        if (b - a) * m <= 4 * total:
            met = np.full((b - a) * m, -1, np.int32)
            met[key[::-1]] = np.arange(total - 1, -1, -1)  # the last one written is the first
            key = np.flatnonzero(met >= 0)
            at = met[key]
        else:
            key, at = np.unique(key, return_index=True)
        x, y = key // m + a, key % m
        need = least_overlap(n[x], n[y], num, den)
        ok = np.minimum(n[x] - pos[entry[at]], n[y] - place[partner[at]]) >= need
        yield x[ok], y[ok], need[ok]


def _by_list(s: _Sets, at: np.ndarray, side: np.ndarray, num: int, den: int) -> Pairs:
    """The same of one posting list, whose shingle is at place `at` of each set; pairs
    across, if there are two sides."""
    m, n, across = s.m, s.n, side[0] != side[-1] or len(set(side.tolist())) > 1
    step = max(1, TILE // m)
    for a in range(0, m, step):
        b = min(m, a + step)
        need = least_overlap(n[a:b, None], n, num, den)
        ok = (np.arange(m) > np.arange(a, b)[:, None]) & (n[a:b, None] * den >= n * num)
        ok &= np.minimum((n - at)[a:b, None], n - at) >= need
        if across:
            ok &= side != side[a:b, None]
        x, y = np.nonzero(ok)
        yield x + a, y, need[ok]


def _links(s: _Sets, w: np.ndarray, pairs: Pairs, before: _Sets | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(links, label) of each set: links with how many rows, and the set that names
    its component. With `before`, only pairs without a common element there count."""
    links, label = np.zeros(s.m, np.int64), np.arange(s.m)
    for x, y, need in pairs:
        keep = s.may(x, y, need)
        x, y, need = x[keep], y[keep], need[keep]
        hit = s.common(x, y) >= need
        x, y = x[hit], y[hit]
        if before is not None:
            new = before.common(x, y) == 0
            x, y = x[new], y[new]
        np.add.at(links, x, w[y])
        np.add.at(links, y, w[x])
        while True:  # greater labels take the least that they meet
            a, b = label[x], label[y]
            new = a != b
            if not new.any():
                break
            x, y, a, b = x[new], y[new], a[new], b[new]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    return links, label


def _verify(num: int, den: int):
    """Rows come sorted by group; a group is a whole family, a hub with its spokes, or
    one or two blocks of a list. Returns (a, b, links): class a links with so many rows
    here and is connected to class b."""

    def group_links(rows: list[tuple]) -> list[tuple[int, int, int]]:
        if len(rows) < 2:
            return []
        rows = sorted(rows, key=lambda r: (r[4], r[1]))
        _, cls, kind, at, n, w, posted, blob = zip(*rows)
        at, n, w, posted, kind = (np.array(x) for x in (at, n, w, posted, kind))
        ranked = [np.frombuffer(b, "<u8").astype(U64) for b in blob]
        s = _Sets(n, ranked)
        if kind[0] in (HUB, SPOKE):
            out = []
            for hub in np.flatnonzero(kind == HUB).tolist():
                y = np.flatnonzero((kind == SPOKE) & (np.minimum(n, n[hub]) * den >= np.maximum(n, n[hub]) * num))
                x, need = np.full(len(y), hub), least_overlap(n[y], n[hub], num, den)
                keep = s.may(x, y, need)
                x, y, need = x[keep], y[keep], need[keep]
                for k in y[s.common(x, y) >= need].tolist():
                    first = np.isin(ranked[hub][: posted[hub]], ranked[k][: posted[k]]).argmax()
                    if n[hub] - len(ranked[hub]) + first == at[k]:
                        out += [(cls[hub], cls[k], int(w[k])), (cls[k], cls[hub], int(w[hub]))]
            return out
        if kind[0] == FAMILY:
            found, label = _links(s, w, _by_prefix(s, posted, num, den))
        else:
            alone = n - s.len
            found, label = _links(s, w, _by_list(s, at, kind, num, den), _Sets(n, [x[:k] for x, k in zip(ranked, (at - alone).tolist())]))
        return [(cls[x], cls[label[x]], int(found[x])) for x in np.flatnonzero(found).tolist()]

    def batch(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
        mask = (1 << 64) - 1
        ends = [_classes(np.array([r[k] & mask for r in out], U64), np.array([r[k] >> 64 for r in out], U64)) for k in (0, 1)]
        return pa.record_batch([*ends, pa.array([r[2] for r in out], pa.int64())], names=["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list = []
        whole = lambda c: [h << 64 | x for x, h in zip(*(v.tolist() for v in _split(c)))]
        for t in batches:
            out: list[tuple[int, int, int]] = []
            for row in zip(whole(t.column(0)), whole(t.column(1)), *(t.column(k).to_pylist() for k in range(2, 8))):
                if group and (group[0][0], KIN[group[0][2]]) != (row[0], KIN[row[2]]):
                    out += group_links(group)
                    group = []
                group.append(row)
            if out:
                yield batch(out)
        if group and (out := group_links(group)):
            yield batch(out)

    return run


#: Kinds that meet in one group.
KIN = {FAMILY: 0, HUB: 1, SPOKE: 1, LEFT: 2, RIGHT: 2}


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in `edges` (a, b): the smallest node that it
    reaches. Large-star and small-star steps in turn, each two aggregations; the
    edges stay a forest-like list, so no node gathers its component."""
    mark = lambda d: d.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = mark(e)
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        # large-star: greater neighbours go to the smallest neighbour
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: a node and its smaller neighbours go to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = cut(small)
        now = mark(new)
        if now == was:
            return new.select(F.col("a").alias("node"), F.col("b").alias("label"))
        e, was = new, now


def _power(x: float) -> int:
    return 1 << max(0, int(x)).bit_length()


def _common(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Very common shingles, ascending, and how often they were found. Each has at least
    a 2^17th of all shingles, so there are no more than 2^17."""
    total = scanned.agg(F.sum("n_shingles")).first()[0] or 0
    found = scanned.where("tok is not null").groupBy("tok").agg(F.sum("hits").alias("hits"))
    got = found.where(F.col("hits") >= max(COMMON, total >> 17)).collect()
    tok = np.array([r.tok for r in got], np.int64).view(U64)
    hits = np.minimum(np.array([r.hits for r in got], np.int64), 0xFFFFFFFF).astype(np.uint32)
    o = np.argsort(tok)
    return tok[o], hits[o]


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 3, den: int = 4, counts: bool = False) -> DataFrame:
    """Every row's (id, n_shingles, component_id) under links of Jaccard >=
    num/den between sets of n-word shingles; with `counts` also n_links, the number
    of other rows that it links with. See the module for nulls, ties and empty
    texts."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # A word and its space take at least two bytes, about six on average.
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(_power(parts(spark)), _power(total / 6 / BUCKET))
    scanned = cut(rows.mapInArrow(_light(n), f"doc_id long, cls {CLASS}, n_shingles long, tok long, hits long"))
    light = scanned.where("tok is null").select("doc_id", "cls", "n_shingles")
    common = spark.sparkContext.broadcast(_common(scanned))
    shared = rows.select("text").mapInArrow(_scan(n, buckets, common), "bucket int, blob binary").groupBy("bucket").applyInArrow(_shared(buckets), "part int, blob binary")
    sizes = light.where("cls <> 0").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.count("*").alias("w"))

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bucket_of(mix(_split(t.column(0))[0]), buckets)), *t.columns], names=["part", *t.schema.names])

    sizes = sizes.mapInArrow(parted, f"part int, cls {CLASS}, n long, w long")
    sets = cut(shared.groupBy("part").cogroup(sizes.groupBy("part")).applyInArrow(_prefixes(num, den, buckets), f"cls {CLASS}, low long, n long, w long, posted long, bucket int, blob binary"))
    post = sets.where("bucket is not null").select("bucket", "blob").groupBy("bucket")
    ties = post.applyInArrow(_families(num, den), "a long, b long").distinct()
    # A family's sets meet in one task if they fit there.
    family = components(ties).select(F.col("node").alias("low"), F.col("label").alias("gid"))
    family = family.unionByName(family.select(F.col("gid").alias("low"), "gid").distinct())
    own = sets.where("bucket is null").select("cls", "low", "n", "w", "posted", "blob")
    weight = family.join(own.select("low", F.length("blob").alias("bytes")), "low").groupBy("gid").agg(F.sum("bytes").alias("bytes"))
    large = cut(weight.where(F.col("bytes") > 8 * BLOCK).select("gid"))
    columns = ["gid", "cls", "kind", "at", "n", "w", "posted", "blob"]
    groups = family.join(large, "gid", "left_anti").join(own, "low").withColumns({"gid": F.col("gid").cast(CLASS), "kind": F.lit(FAMILY), "at": F.lit(0).cast("long")}).select(*columns)
    if not large.isEmpty():
        lists = post.applyInArrow(_meet(num, den), f"gid {CLASS}, cls {CLASS}, kind int, at long").groupBy("gid", "cls", "kind").agg(F.min("at").alias("at"))
        in_large = family.join(large, "gid", "left_semi").select("low")
        groups = groups.unionByName(lists.join(own.join(in_large, "low", "left_semi"), "cls").select(*columns))
    found = cut(groups.repartition(parts(spark), "gid").sortWithinPartitions("gid", "kind").mapInArrow(_verify(num, den), f"a {CLASS}, b {CLASS}, links long"))
    links = found.where("a <> b").select("a", "b").distinct()
    # Classes are connected by their hashes, as one may have no known doc_id.
    rep = light.where("cls <> 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("w"))
    rep = rep.join(components(links), F.col("cls") == F.col("node"), "left").select("cls", "w", "rep", F.coalesce("label", "cls").alias("label"))
    named = rep.join(rep.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("cls", "w", "component_id")
    degree = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    named = named.join(degree, "cls", "left").select(F.col("cls").alias("c"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    out = light.join(named, F.col("cls") == F.col("c"), "left")
    out = out.select(F.col("doc_id").alias(id_col), "n_shingles", F.when(F.col("cls") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out if counts else out.drop("n_links")
