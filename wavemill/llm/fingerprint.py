"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines; longer ones end early after a space at which a
hash of the eight bytes before it says so (about every eight words), so an edit
changes only the paragraphs that it touches. Their distinct 64-bit digests go to
three cells each, one in each third of the sketch; a cell holds a count, the XOR of
the digests and the XOR of their checksums.

A sketch's size is a power of two per third, about two cells a digest, and grows
until the sketch alone can be peeled: a fingerprint can always be turned back into
its digests. A cell's place is the low bits of a hash, so a sketch folds to any smaller
power of two by adding halves. Two fingerprints are compared by what they hold alone:
folded to a small common size they subtract cell by cell, and peeling recovers the
digests that only one has; on failure a larger size is tried, chosen by the share of
cells that are empty. If the difference is too large for the smaller of both sketches,
each is peeled on its own and the digests are subtracted. The likeness of two texts is
the Jaccard similarity of their digest sets.

`neighbour_fingerprints` holds each document against an edited version of itself
and against the next one in descending order of id. Texts move once, packed, to
ranges of ids of about equal bytes, one task each; a range also gets the first row of
the next one, so no range waits for another.

Defined results: null text is empty; two empty texts have likeness 1; texts of any
length have whole fingerprints (counts take as many bytes as they need); rows of the
same id are ordered by a hash of their text, rows without id come last; a single
row is its own next; an empty table gives no rows; only the id and text columns are
read, so others may have any names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, U64, arrow_batches, free, mix, parts, slices, unpack, utf8

#: Cells in a third of the smallest sketch, and of the first one that is subtracted.
LEAST, FIRST = 4, 16
#: Documents that are sketched at a time, at most.
TOGETHER = 256
_SALT = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], U64)
_POW = np.multiply.accumulate(np.full(1 << 12, U64(0x9E3779B97F4A7C15)))


def paragraphs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, digests): of each text the distinct digests of its paragraphs,
    ascending."""
    n = len(offs) - 1
    if not len(data):
        return np.zeros(n + 1, np.int64), np.zeros(0, U64)
    cut = data == 10
    space = np.flatnonzero(data[8:] == 32) + 8
    space = space[space - offs[np.searchsorted(offs, space, "right") - 1] >= 8]
    if len(space):
        eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[space - 8])
        cut[space[mix(eight.view(U64).ravel()) & U64(7) == 0]] = True
    cut[offs[1:][np.diff(offs) > 0] - 1] = True
    stop = np.flatnonzero(cut) + 1
    start = np.concatenate([[0], stop[:-1]])
    # A paragraph's digest: bytes times powers by their place in it.
    place = np.arange(len(data)) - np.repeat(start, stop - start)
    x = (data.astype(U64) + U64(1)) * _POW[place & 4095]
    far = place >= 4096
    if far.any():
        x[far] += mix((place[far] >> 12).astype(U64))
    digest = mix(np.add.reduceat(mix(x), start))
    own = np.searchsorted(offs, start, "right") - 1
    o = np.lexsort((digest, own))
    own, digest = own[o], digest[o]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (digest[1:] != digest[:-1])
    return np.searchsorted(own[new], np.arange(n + 1)).astype(np.int64), digest[new]


def _checksum(x: np.ndarray) -> np.ndarray:
    return (mix(x ^ U64(0x5BF03635)) >> U64(32)).astype(np.uint32)


def _power_of_two(x: np.ndarray) -> np.ndarray:
    """The least powers of two that are not below x (1 or more)."""
    return 1 << np.ceil(np.log2(x)).astype(np.int64)


def _flat(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owners, places) of runs of n places from start on."""
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(int(n.sum())) + (start - np.cumsum(n) + n)[own]


class Sketches:
    """Any number of sketches, their cells one after the other: sketch i has
    3 * size[i] cells from start[i] on."""

    def __init__(self, size: np.ndarray):
        self.size = np.asarray(size, np.int64)
        self.start = np.concatenate([[0], np.cumsum(3 * self.size)])
        cells = int(self.start[-1])
        self.count, self.key, self.check = np.zeros(cells, np.int64), np.zeros(cells, U64), np.zeros(cells, np.uint32)
        self._lists: tuple[np.ndarray, np.ndarray] | None = None

    def __len__(self) -> int:
        return len(self.size)

    @classmethod
    def build(cls, at: np.ndarray, digests: np.ndarray) -> Sketches:
        """A sketch for each set, large enough to be peeled."""
        n = np.diff(at)
        size = np.maximum(LEAST, _power_of_two(n / 2 + 2))
        todo = np.arange(len(n))
        while True:
            own, place = _flat(at[:-1][todo], n[todo])
            s = cls(size[todo])
            s.toggle(own, digests[place], np.ones(len(own), np.int64))
            held = s.copy()
            failed = ~held.peel()[3]
            if not failed.any():
                if len(todo) == len(n):
                    s._lists = at, digests
                    return s
                todo = np.arange(len(n))
            else:
                todo = todo[failed]
                size[todo] *= 2

    def copy(self) -> Sketches:
        out = Sketches.__new__(Sketches)
        out.size, out.start, out._lists = self.size, self.start, None
        out.count, out.key, out.check = self.count.copy(), self.key.copy(), self.check.copy()
        return out

    def places(self, own: np.ndarray, x: np.ndarray) -> np.ndarray:
        """(3, digests): a cell in each third."""
        size = self.size[own]
        h = mix(x + _SALT[:, None]).view(np.int64) & (size - 1)
        return h + self.start[own] + np.arange(3)[:, None] * size

    def toggle(self, own: np.ndarray, x: np.ndarray, sign: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Adds (sign 1) or takes away (-1) digests; returns their cells."""
        at = (self.places(own, x) if at is None else at).ravel()
        np.add.at(self.count, at, np.tile(sign, 3))
        np.bitwise_xor.at(self.key, at, np.tile(x, 3))
        np.bitwise_xor.at(self.check, at, np.tile(_checksum(x), 3))
        return at

    def digests(self) -> np.ndarray:
        """How many each sketch holds."""
        return np.add.reduceat(self.count, self.start[:-1]) // 3 if len(self) else np.zeros(0, np.int64)

    def folded(self, pick: np.ndarray, size: np.ndarray) -> Sketches:
        """The picked sketches at smaller sizes."""
        out = Sketches(size)
        n = 3 * self.size[pick]
        own, src = _flat(self.start[:-1][pick], n)
        third, inner = np.divmod(src - self.start[:-1][pick][own], self.size[pick][own])
        at = out.start[own] + third * out.size[own] + (inner & (out.size[own] - 1))
        np.add.at(out.count, at, self.count[src])
        np.bitwise_xor.at(out.key, at, self.key[src])
        np.bitwise_xor.at(out.check, at, self.check[src])
        return out

    def __sub__(self, other: Sketches) -> Sketches:
        out = self.copy()
        out.count -= other.count
        out.key ^= other.key
        out.check ^= other.check
        return out

    def empty_share(self) -> np.ndarray:
        zero = (self.count == 0) & (self.key == 0) & (self.check == 0)
        return np.add.reduceat(zero.astype(np.int64), self.start[:-1]) / (3 * self.size)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Takes out digests that stand alone in a cell until there are none:
        (owner, digest, sign) of each, and which sketches are empty then."""
        if not len(self):
            return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, bool)
        cell_own = np.repeat(np.arange(len(self)), 3 * self.size)
        got, found = [], np.zeros(len(self), np.int64)
        cand = np.flatnonzero(np.abs(self.count) == 1)
        while len(cand):
            x = self.key[cand]
            cand = cand[_checksum(x) == self.check[cand]]
            x, own = self.key[cand], cell_own[cand]
            o = np.lexsort((x, own))
            new = np.ones(len(o), bool)
            new[1:] = (x[o[1:]] != x[o[:-1]]) | (own[o[1:]] != own[o[:-1]])
            o = o[new]
            cand, x, own = cand[o], x[o], own[o]
            at = self.places(own, x)
            # A digest has its cells; none yields more digests than cells.
            good = (at == cand).any(0) & (found[own] < 3 * self.size[own])
            cand, x, own, at = cand[good], x[good], own[good], at[:, good]
            if not len(x):
                break
            sign = self.count[cand]
            got.append((own, x, sign))
            found += np.bincount(own, minlength=len(self))
            touched = self.toggle(own, x, -sign, at)
            cand = touched[np.abs(self.count[touched]) == 1]
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        own, x, sign = (np.concatenate(c) for c in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))
        return own, x, sign, ~np.logical_or.reduceat(left, self.start[:-1])

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, digests), ascending: each sketch peeled on its own."""
        if self._lists is None:
            own, x, _, ok = self.copy().peel()
            if not ok.all():
                raise ValueError("not a fingerprint: it cannot be peeled")
            o = np.lexsort((x, own))
            self._lists = np.searchsorted(own[o], np.arange(len(self) + 1)).astype(np.int64), x[o]
        return self._lists

    def text(self, i: int) -> str:
        """Lossless: two bytes of header (logarithm of the size, bytes of a count),
        counts, digests, checksums; in base64."""
        a, b = int(self.start[i]), int(self.start[i + 1])
        count = self.count[a:b]
        width = 1 if (top := int(count.max())) < 1 << 8 else 2 if top < 1 << 16 else 4
        head = bytes([int(self.size[i]).bit_length() - 1, width])
        return base64.b64encode(b"".join([head, count.astype(f"<u{width}").tobytes(), self.key[a:b].astype("<u8").tobytes(), self.check[a:b].astype("<u4").tobytes()])).decode()

    @classmethod
    def parse(cls, texts: list[str]) -> Sketches:
        blobs = []
        for t in texts:
            try:
                b = base64.b64decode(t, validate=True)
            except (binascii.Error, ValueError):
                raise ValueError("not a fingerprint") from None
            if len(b) < 2 or b[0] > 40 or b[1] not in (1, 2, 4) or len(b) != 2 + (3 << b[0]) * (b[1] + 12):
                raise ValueError("not a fingerprint")
            blobs.append(b)
        out = cls(np.array([1 << b[0] for b in blobs], np.int64))
        for i, b in enumerate(blobs):
            a, n, w = int(out.start[i]), 3 << b[0], b[1]
            out.count[a : a + n] = np.frombuffer(b, f"<u{w}", n, 2)
            out.key[a : a + n] = np.frombuffer(b, "<u8", n, 2 + w * n)
            out.check[a : a + n] = np.frombuffer(b, "<u4", n, 2 + (w + 8) * n)
        return out


def differences(a: Sketches, i: np.ndarray, b: Sketches, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of sketches, by what these hold alone: (pair, digest, sign) of each
    digest that only the left (1) or only the right (-1) has, and how often each
    pair was sketched."""
    top = np.minimum(a.size[i], b.size[j])
    size, tries = np.minimum(FIRST, top), np.zeros(len(i), np.int64)
    todo, apart, got = np.arange(len(i)), [], []
    while len(todo):
        s = a.folded(i[todo], size[todo]) - b.folded(j[todo], size[todo])
        tries[todo] += 1
        empty = s.empty_share()
        own, x, sign, ok = s.peel()
        hit = ok[own]
        got.append((todo[own[hit]], x[hit], sign[hit]))
        todo, empty = todo[~ok], empty[~ok]
        # A cell of d digests in thirds of T is empty with probability exp(-d / T).
        d = -size[todo] * np.log(np.maximum(empty, 1 / (6 * size[todo])))
        want = np.maximum(2 * size[todo], _power_of_two(np.maximum(d, 1) / 2 + 2))
        large = (size[todo] == top[todo]) | (want > 2 * top[todo])
        apart.append(todo[large])
        todo = todo[~large]
        size[todo] = np.minimum(want[~large], top[todo])
    k = np.concatenate(apart) if apart else np.zeros(0, np.int64)
    if len(k):
        tries[k] += 1
        sides = []
        for s, pick, sign in ((a, i[k], 1), (b, j[k], -1)):
            at, digests = s.lists()
            own, place = _flat(at[:-1][pick], np.diff(at)[pick])
            sides.append((own, digests[place], np.full(len(own), sign)))
        own, x, sign = (np.concatenate(c) for c in zip(*sides))
        o = np.lexsort((x, own))
        own, x, sign = own[o], x[o], sign[o]
        twin = np.zeros(len(own), bool)
        twin[1:] = (own[1:] == own[:-1]) & (x[1:] == x[:-1])
        twin[:-1] |= twin[1:]
        got.append((k[own[~twin]], x[~twin], sign[~twin]))
    pair, x, sign = (np.concatenate(c) for c in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))
    return pair, x, sign, tries


def likenesses(a: Sketches, i: np.ndarray, b: Sketches, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard similarity, sketches that it took) of pairs of sketches."""
    pair, _, _, tries = differences(a, i, b, j)
    total, apart = a.digests()[i] + b.digests()[j], np.bincount(pair, minlength=len(i))
    common = (total - apart) // 2
    return np.where(total == 0, 1.0, common / np.maximum(total - common, 1)), tries


def likeness(left: str, right: str) -> float:
    """Of two fingerprints."""
    one = np.zeros(1, np.int64)
    return float(likenesses(Sketches.parse([left]), one, Sketches.parse([right]), one)[0][0])


def _sketched(texts: list[bytes]) -> Sketches:
    return Sketches.build(*paragraphs(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])))


def fingerprints(docs: DataFrame, *, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """`docs` with the fingerprint of each text; a column of that name is replaced. No
    row moves."""
    arrow_batches(docs.sparkSession)
    keep = [f for f in docs.schema if f.name.lower() != out.lower()]
    names = [f.name for f in keep]
    extra = free(docs, "wm_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            data, offs = utf8(t.column(len(names)))
            for a, b in slices(offs):
                s = Sketches.build(*paragraphs(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]))
                part = t.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array([s.text(k) for k in range(len(s))], pa.string())], names=[*names, out])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{out}` string"])
    return docs.select(*[F.col(f"`{n}`") for n in names], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(extra)).mapInArrow(run, fields)


def compare_fingerprints(df: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right, likeness, only_left, only_right) of two columns of fingerprints:
    the digests that each side has alone. What is null or no fingerprint gives nulls."""
    arrow_batches(df.sparkSession)

    def read(t: str | None) -> Sketches | None:
        try:
            s = None if t is None else Sketches.parse([t])
            return s if s is None or s.lists() else None
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.zeros(1, np.int64)
        for t in batches:
            out: list[tuple] = []
            for x, y in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                a, b = read(x), read(y)
                if a is None or b is None:
                    out.append((None, None, None))
                    continue
                _, digest, sign, _ = differences(a, one, b, one)
                sides = [np.sort(digest[sign == k]).view(np.int64).tolist() for k in (1, -1)]
                out.append((float(likenesses(a, one, b, one)[0][0]), *sides))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(cols[0], pa.float64()), *(pa.array(c, pa.list_(pa.int64())) for c in cols[1:])], names=["left", "right", "likeness", "only_left", "only_right"])

    return df.select(F.col(left).cast("string").alias("left"), F.col(right).cast("string").alias("right")).mapInArrow(run, "left string, right string, likeness double, only_left array<long>, only_right array<long>")


def _bounds(rows: DataFrame, n: int) -> tuple[np.ndarray, int | None]:
    """Ids that exist, at which n ranges of about equal bytes begin, and the greatest
    id. Quantiles of the ids make finer bins, whose bytes are summed."""
    fine = 8 * n
    got = rows.agg(F.percentile_approx("doc_id", [k / fine for k in range(1, fine)], max(10_000, 4 * fine)).alias("q"), F.max("doc_id").alias("top")).first()
    q = np.array(sorted({x for x in got.q or [] if x != got.top}), np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(q) + 1)
        for t in batches:
            total += np.bincount(np.searchsorted(q, t.column(0).to_numpy(), "left"), t.column(1).to_numpy(), len(q) + 1)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["bin", "bytes"])

    light = rows.where("doc_id is not null").select("doc_id", (F.octet_length("text") + 200).cast("double").alias("bytes"))
    each = np.zeros(len(q) + 1)
    for r in light.mapInArrow(weigh, "bin long, bytes double").groupBy("bin").agg(F.sum("bytes").alias("bytes")).collect():
        each[r.bin] = r.bytes
    upto = np.cumsum(each)
    cut = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, n) / n)) if len(q) else np.zeros(0, np.int64)
    return q[cut[cut < len(q)]], got.top


def neighbour_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_paragraphs, sketches (how often the two pairs were
    sketched). The edited text's last third is the beginning of the next document."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bounds, top = _bounds(rows, ranges or parts(spark))
    last = len(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for t in batches:
            data, offs = utf8(t.column(1))
            data = data.tobytes()
            out: list[list] = [[], [], [], [], []]
            for k, i in enumerate(t.column(0).to_pylist()):
                raw = data[offs[k] : offs[k + 1]]
                b = press.compress(raw)
                tie = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
                r = last if i is None else last - int(np.searchsorted(bounds, i, "left"))
                # Range 0 begins with the greatest id, range k with bounds[last - k].
                places = [(r, 0)]
                if i is not None and r > 0 and bounds[last - r] == i:
                    places.append((r - 1, 1))
                if i == top:
                    places.append((last, 2))
                for q, after in places:
                    for o, v in zip(out, (q, after, i, tie, b)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], names=["range", "after", "doc_id", "tie", "blob"])

    def record(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        """pairs: (id, text, next text); one's next is mostly the one after it."""
        texts, nxt, edited = [], [], []
        for k, (_, own, beyond) in enumerate(pairs):
            texts.append(own.encode())
            cut = len(own) // 3
            edited.append((own[: len(own) - cut] + beyond[:cut]).encode())
            nxt.append(k + 1 if k + 1 < len(pairs) and pairs[k + 1][1] is beyond else None)
        n = len(pairs)
        for k, x in enumerate(nxt):
            if x is None:
                nxt[k] = len(texts)
                texts.append(pairs[k][2].encode())
        mine, theirs, every = _sketched(texts), _sketched(edited), np.arange(n)
        near, tries = likenesses(mine, every, theirs, every)
        beyond, more = likenesses(mine, every, mine, np.array(nxt, np.int64))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in pairs], pa.int64()),
                pa.array([len(p[1]) for p in pairs], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in edited], pa.string()),
                pa.array([mine.text(k) for k in range(n)], pa.string()),
                pa.array([theirs.text(k) for k in range(n)], pa.string()),
                pa.array(near),
                pa.array(beyond),
                pa.array(mine.digests()[:n]),
                pa.array(tries + more),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_paragraphs", "sketches"],
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, id, text) of the row that waits for its next
        first = None  # (range, text): what follows the last row of a table without ids
        pairs: list[tuple[int | None, str, str]] = []
        size = 0
        for t in batches:
            for r, after, i, blob in zip(*(t.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if after and (held is None or held[0] != r):
                    continue  # the next of nothing, or a second copy of it
                text = unpack(blob).decode()
                if held is not None:
                    pairs.append((held[1], held[2], text if held[0] == r else first[1]))
                    size += len(held[2])
                if first is None or first[0] != r:
                    first = (r, text)
                held = None if after else (r, i, text)
                if size >= SLICE_BYTES or len(pairs) >= TOGETHER:
                    yield record(pairs)
                    pairs, size = [], 0
        if held is not None:
            pairs.append((held[1], held[2], first[1]))
        if pairs:
            yield record(pairs)

    dealt = rows.mapInArrow(deal, "range int, after int, doc_id long, tie long, blob binary")
    order = [F.col("range"), F.col("after"), F.col("doc_id").desc_nulls_last(), F.col("tie")]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long, sketches long"
    return dealt.repartitionById(last + 1, F.col("range")).sortWithinPartitions(*order).mapInArrow(compare, schema)
