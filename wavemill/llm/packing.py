"""Packing token streams into sequences by order-preserving dynamic programming.

Documents keep their order inside a task's split of the input; their tokens form
one stream, cut into windows (sequences) of at most `length` tokens. Cuts fall
at document ends, at sentence ends, or, inside sentences longer than `grain`
tokens, at every `grain` tokens. The plan minimises padding plus a penalty for
each cut inside a document and a small one for each window:

    f(j) = penalty(j) + each + min( min over p_j - p_i <= length of f(i) + length - (p_j - p_i),
                             min over p_j - p_i a power of two of f(i) )

The first minimum is over a sliding window of f(i) + p_i and comes from a
monotone queue, so each candidate enters and leaves once; the second looks up
twelve places, for sequences that are a power of two long need no padding. The
stream is planned in blocks of about `block` tokens; only a split's last block
can end in a window that is not full. No row moves between tasks.

Defined results: null text is empty and packs its end token alone; texts of any
length are cut as often as needed; repeated rows and ties pack as rows of their
own; an empty table gives no rows; only the id and text columns are read, so others
may have any names. `sequence_id` is split * 2^32 + number.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, utf8

GRAIN = 256
BLOCK = 1 << 18
#: Penalties, in tokens of padding: a cut at a sentence's end, a cut inside a
#: sentence, and each sequence (so that few are short).
SENTENCE, INSIDE, EACH = 2, 64, 4
#: Distinct words that a worker remembers in each of two generations, about 40 MB each.
WORDS = 250_000


_ENCODERS: dict[tuple[str, int], tuple] = {}


def word_encoder(path: str, end_id: int):
    """One for all tasks of a worker, so that words stay known."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = _word_encoder(path, end_id)
    return _ENCODERS[path, end_id]


class Merges:
    """Byte-pair merges of many words at once. All words take their best merge in
    turn (least rank, then leftmost), one in each round."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        # Printable stand-ins of bytes, as byte-level tokenizers have them.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.inner = np.array([vocab[sign[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[sign[b] + "</w>"] for b in range(256)], np.int64)
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bits = max(4, (4 * len(key)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, len(key), np.int64)
        at, left, self.probes = self._place(key), np.arange(len(key)), 0
        while len(left):  # each takes the next free place after its own
            self.probes += 1
            free = self.keys[at[left]] < 0
            first = np.unique(at[left][free], return_index=True)[1]
            win = left[free][first]
            self.keys[at[win]], self.ranks[at[win]] = key[win], win
            left = np.setdiff1d(left, win)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        self.none = len(key)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = self._place(key)
        out = np.full(key.shape, self.none, np.int64)
        todo = np.flatnonzero((a >= 0).ravel() & (b >= 0).ravel())
        k, at, flat = key.ravel(), at.ravel(), out.ravel()
        for _ in range(self.probes):
            if not len(todo):
                break
            found = self.keys[at[todo]]
            hit = found == k[todo]
            flat[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(key.shape)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters, in groups of like length."""
        out: list[bytes] = [b""] * len(words)
        lens = np.array([len(w) for w in words])
        order = np.argsort(lens, kind="stable")
        a = 0
        while a < len(order):
            width = int(lens[order[a]]) + 3
            b = min(a + 20_000, int(np.searchsorted(lens[order], width, "right")))
            for k, ids in zip(order[a:b].tolist(), self._group([words[i] for i in order[a:b].tolist()])):
                out[k] = ids
            a = b
        return out

    def _group(self, words: list[bytes]) -> list[bytes]:
        n = np.array([len(w) for w in words])
        width = int(n.max())
        data = np.frombuffer(b"".join(words), np.uint8)
        t = np.full((len(words), width + 1), -1, np.int64)
        inside = np.arange(width + 1) < n[:, None]
        t[inside] = self.inner[data]
        ends = np.cumsum(n) - 1
        t[np.arange(len(n)), n - 1] = self.last[data[ends]]
        r = np.concatenate([self.rank(t[:, :-1], t[:, 1:]), np.full((len(words), 1), self.none)], 1)
        live, cols = np.arange(len(words)), np.arange(width + 1)
        lt, lr = t, r
        while True:
            best = lr.argmin(1)
            row = np.arange(len(live))
            rank = lr[row, best]
            go = rank < self.none
            if not go.all():
                t[live[~go]] = lt[~go]
                live, lt, lr, best, rank = live[go], lt[go], lr[go], best[go], rank[go]
                row = np.arange(len(live))
            if not len(live):
                break
            lt[row, best] = self.made[rank]
            src = np.minimum(cols + (cols > best[:, None]), width)
            lt = np.take_along_axis(lt, src, 1)
            lr = np.take_along_axis(lr, np.minimum(cols + (cols >= best[:, None]), width), 1)
            here = lt[row, best]
            lr[row, best] = self.rank(here, lt[row, np.minimum(best + 1, width)])
            before = best > 0
            lr[row[before], best[before] - 1] = self.rank(lt[row[before], best[before] - 1], here[before])
        keep = t >= 0
        flat = t[keep].astype("<u4").tobytes()
        stop = np.cumsum(keep.sum(1)) * 4
        return [flat[i:j] for i, j in zip([0, *stop[:-1].tolist()], stop.tolist())]


def _plain(word: bytes) -> bool:
    """Letters only, composed and lower-case: one word to the tokenizer, unchanged
    by its normalizer."""
    if len(word) > 40:
        return False
    if word.isalpha():
        return True
    s = word.decode()
    return s.isalpha() and s == s.lower() and unicodedata.is_normalized("NFC", s)


def _word_encoder(path: str, end_id: int):
    """(ids of texts as little-endian uint32 bytes, is a token a sentence end).

    White space always separates the tokenizer's words, so a text's ids are
    those of its parts between ASCII white space; each part is encoded once and
    remembered: words of letters by `Merges`, all else by the library. Lower-casing
    of A-Z is the tokenizer's own."""
    import json

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = False
    with open(path, encoding="utf-8") as f:
        merges = Merges(json.load(f)["model"])
    known: dict[bytes, bytes] = {}
    older: dict[bytes, bytes] = {}
    special = [t.content.lower().encode() for t in tok.get_added_tokens_decoder().values()]
    dots = {m: _ids(tok, [m.decode()])[0] for m in (b".", b",")}

    def learn(missing: set[bytes]) -> None:
        """Afterwards these parts are known."""
        words: set[bytes] = set()
        other, tails = [], []
        for p in missing:
            got = older.get(p)
            if got is not None:
                known[p] = got
                continue
            tail = p[-1:] in dots and len(p) > 1
            w = p[:-1] if tail else p
            if not _plain(w):
                other.append(p)
                continue
            if tail:
                tails.append(p)
                if w in known:
                    continue
                got = older.get(w)
                if got is not None:
                    known[w] = got
                    continue
            words.add(w)
        ask = list(words)
        known.update(zip(ask, merges.encode(ask)))
        known.update(zip(other, _ids(tok, [p.decode() for p in other])))
        for p in tails:
            known[p] = known[p[:-1]] + dots[p[-1:]]

    def encode(texts: list[bytes]) -> list[bytes]:
        """A full memory becomes the older one, from which the words that still occur
        are taken over."""
        nonlocal known, older
        found: list[tuple[list | None, list | None, list[int]]] = []
        missing: set[bytes] = set()
        get = known.get
        for data in texts:
            low = data.lower()
            # The library finds these before it splits words.
            if any(s in low for s in special):
                found.append((None, None, []))
                continue
            split = low.split()
            ids = list(map(get, split))
            gaps = [k for k, v in enumerate(ids) if v is None] if None in ids else []
            missing.update([split[k] for k in gaps])
            found.append((split, ids, gaps))
        learn(missing)
        out = []
        for data, (split, ids, gaps) in zip(texts, found):
            if ids is None:
                out.append(_ids(tok, [data.decode()])[0])
                continue
            for k in gaps:
                ids[k] = known[split[k]]
            out.append(b"".join(ids))
        if len(known) > WORDS:
            known, older = {}, known
        return out

    size = max(max(tok.get_vocab().values()), end_id) + 1
    ends = np.zeros(size, bool)
    for word, k in tok.get_vocab().items():
        ends[k] = word.removesuffix("</w>")[-1:] in (".", "!", "?")
    ends[end_id] = False
    return encode, ends


def _ids(tok, texts: list[str]) -> list[bytes]:
    return [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def plan(at: np.ndarray, penalty: np.ndarray, length: int, each: float = EACH) -> list[int]:
    """Indices of the chosen cuts among the candidates `at` (ascending, at[0] = 0,
    gaps of at most `length`); the first and last candidates are cuts."""
    p, pen = at.tolist(), penalty.tolist()
    n = len(p)
    f, back = [0.0] * n, [0] * n
    # Which candidates lie a power of two before each: found for all at once.
    later, earlier = [], []
    for w in [1 << k for k in range(length.bit_length()) if 1 << k <= length]:
        i = np.searchsorted(at, at - w)
        hit = at[i] == at - w
        later.append(np.flatnonzero(hit))
        earlier.append(i[hit])
    later = np.concatenate(later)
    o = np.argsort(later, kind="stable")
    before, first = np.concatenate(earlier)[o].tolist(), np.searchsorted(later[o], np.arange(n + 1)).tolist()
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        x = p[j]
        while p[queue[0][1]] < x - length:
            queue.popleft()
        cost, b = queue[0]
        best = cost + length - x
        for i in before[first[j] : first[j + 1]]:
            if f[i] < best:
                best, b = f[i], i
        f[j] = best = best + pen[j] + each
        back[j] = b
        key = best + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [n - 1], n - 1
    while j:
        j = back[j]
        out.append(j)
    return out[::-1]


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, block: int = BLOCK, grain: int = GRAIN, tokens: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, sequence_length; with `tokens`, also the piece's ids."""
    arrow_batches(docs.sparkSession)
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    id_type = pa.int64() if kind == "bigint" else None
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", *(["ids"] if tokens else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = word_encoder(tokenizer_path, end_id)
        last = np.array([end_id], "<u4").tobytes()
        first_id, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[object, bytes, int]] = []  # document, its ids here, those before
        size = 0

        def flush(final: bool) -> pa.RecordBatch | None:
            """Plan what is held; unless final, leave the last windows open."""
            nonlocal held, size, made
            flat = np.frombuffer(b"".join(h[1] for h in held), "<u4")
            lens = np.array([len(h[1]) // 4 for h in held])
            stop = np.cumsum(lens)
            # Penalty of a cut before each token and at the end; none but these: 255.
            mark = np.full(len(flat) + 1, 255, np.uint8)
            mark[1:][ends[flat]] = SENTENCE
            mark[stop] = np.minimum(mark[stop], INSIDE)  # where a document goes on
            ended = np.array([h[2] + len(h[1]) // 4 == h[3] for h in held])
            mark[stop[ended]] = mark[0] = mark[-1] = 0
            cuts = np.flatnonzero(mark < 255)
            gap = np.diff(cuts)
            wide = np.flatnonzero(gap > grain)
            more = [np.arange(cuts[k] + grain, cuts[k + 1], grain) for k in wide.tolist()]
            if more:
                mark[np.concatenate(more)] = INSIDE
            at = np.flatnonzero(mark < 255)
            chosen = at[plan(at, mark[at].astype(np.float64), length)]
            if not final:
                # The stream goes on: keep the tail for the next block.
                chosen = chosen[: max(2, np.searchsorted(chosen, chosen[-1] - 4 * length))]
            begin = stop - lens
            out: list[list] = [[] for _ in names]
            for a, b in zip(chosen[:-1].tolist(), chosen[1:].tolist()):
                d = int(np.searchsorted(stop, a, "right"))
                x = a
                while x < b:
                    y = min(b, int(stop[d]))
                    doc, ids, before, total = held[d]
                    s = x - int(begin[d])
                    piece = ids[4 * s : 4 * (s + y - x)]
                    row = [doc, before + s, y - x, zlib.crc32(piece), total, first_id + made, x - a, b - a]
                    for o, v in zip(out, [*row, np.frombuffer(piece, "<u4").astype(np.int32)] if tokens else row):
                        o.append(v)
                    x, d = y, d + 1
                made += 1
            done = int(chosen[-1])
            d = int(np.searchsorted(stop, done, "right"))
            rest = held[d:]
            if rest:
                doc, ids, before, total = rest[0]
                s = done - int(begin[d])
                rest[0] = (doc, ids[4 * s :], before + s, total)
            held, size = rest, int(stop[-1]) - done
            cols = [pa.array(out[0], id_type), *(pa.array(o, pa.int64()) for o in out[1:8])]
            if tokens:
                cols.append(pa.array(out[8], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(cols, names=names)

        for t in batches:
            data, offs = utf8(t.column(1))
            data = data.tobytes()
            every = encode([data[i:j] for i, j in zip(offs[:-1].tolist(), offs[1:].tolist())])
            for doc, ids in zip(t.column(0).to_pylist(), every):
                ids += last
                total = len(ids) // 4
                for s in range(0, total, block):
                    piece = ids[4 * s : 4 * (s + block)]
                    held.append((doc, piece, s, total))
                    size += len(piece) // 4
                    if size >= block:
                        yield flush(False)
        while held:
            yield flush(True)

    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long" + (", ids array<int>" if tokens else ""))
