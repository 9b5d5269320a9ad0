"""Token counts by a compiled finite-state transducer.

A byte-pair tokenizer that merges any two neighbours whose concatenation is a
piece, best score and then leftmost first, has a local rule: a sequence of pieces
is the encoding of its text exactly if every two neighbours in it are the encoding
of their own concatenation. So the encoding of a prefix is the encoding of a
shorter prefix and one more piece, and what the past still means for the future is
finite: the open paths in the tree of pieces, the piece that precedes each, and
the count at each relative to the last. That is a transducer's state. It is
compiled as it is met: a transition (state, character) is annotated with the
tokens that it emits, negative where a character merges earlier pieces. When the
compiled part outgrows `TRANSITIONS`, it is dropped and compiling begins anew.

No piece holds a space after something else, and some characters occur in no
longer piece: at both the state is reset. A chunk of text therefore maps states to
(state, count) in two parts: its head, up to the first reset, acts on the state;
the rest is constant. Such maps compose associatively; a text's chunks are
composed by a parallel prefix scan, and the words between resets, which are maps
from the reset state to itself, are remembered by text.

Counts equal those of the library, special strings in texts being ordinary text;
tests hold them against it. Null is the empty text, with 0 tokens; texts of any
length, ties and repeated rows are counted like others; an empty table gives no
rows; only the id and text columns are read, so others may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

#: Compiled transitions, and words, that a worker keeps.
TRANSITIONS, WORDS = 800_000, 500_000
#: Characters of a chunk.
CHUNK = 1 << 15
SPACE = "▁"
UNIT = re.compile(" *[^ ]+| +")

State = tuple[tuple[int, str | None, int], ...]
#: Nothing is open; the text begins here or might as well.
START: State = ((0, None, 0),)


class Transducer:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.child: dict[tuple[int, str], int] = {}
        self.inner: set[int] = set()
        self.piece: dict[int, str] = {}
        joined = {c for p in scores if len(p) > 1 for c in p}
        n = 0
        for p in [*scores, *(c for c in joined if c not in scores)]:
            if len(p) == 1 and p not in joined:
                continue
            node = 0
            for c in p:
                self.inner.add(node)
                nxt = self.child.get((node, c))
                if nxt is None:
                    n += 1
                    nxt = self.child[node, c] = n
                node = nxt
            self.piece[node] = p
        self.joined = joined
        if any(SPACE in p.lstrip(SPACE) for p in scores):
            raise ValueError("a piece holds a space after something else")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        #: Per state its row: by character the next state's row and the tokens emitted;
        #: under None the state itself.
        self.states: dict[State, dict] = {}
        self.compiled = 0

    def cost(self, piece: str) -> int:
        return 1 if piece in self.scores else len(piece.encode())

    def merge(self, text: str) -> list[str]:
        """The encoding of a short text by its definition, to compile with."""
        out = list(text)
        while True:
            best, at = None, -1
            for k in range(len(out) - 1):
                s = self.scores.get(out[k] + out[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return out
            out[at : at + 2] = [out[at] + out[at + 1]]

    def fits(self, left: str | None, piece: str) -> bool:
        if left is None:
            ok = self.whole.get(piece)
            if ok is None:
                ok = self.whole[piece] = self.merge(piece) == [piece]
            return ok
        ok = self.pairs.get((left, piece))
        if ok is None:
            if len(self.pairs) > TRANSITIONS:
                self.pairs.clear()
            ok = self.pairs[left, piece] = self.merge(left + piece) == [left, piece]
        return ok

    def compile(self, state: State, c: str) -> tuple[State, int]:
        if c not in self.joined:
            return START, self.cost(c)
        found, alive = None, []
        for node, left, count in state:
            if c == SPACE and node == 0 and left is not None and left[-1] != SPACE:
                left = None
            nxt = self.child.get((node, c))
            if nxt is None:
                continue
            piece = self.piece.get(nxt)
            if piece is not None and found is None and self.fits(left, piece):
                found = piece, count + self.cost(piece)
            if nxt in self.inner:
                alive.append((nxt, left, count))
        assert found is not None, "no encoding"
        piece, count = found
        return (*((node, left, k - count) for node, left, k in alive), (0, piece, 0)), count

    def row(self, state: State) -> dict:
        row = self.states.get(state)
        if row is None:
            row = self.states[state] = {None: state}
        return row

    def run(self, state: State, text: str) -> tuple[State, int]:
        total, row = 0, self.row(state)
        for c in text.replace(" ", SPACE):
            step = row.get(c)
            if step is None:
                if self.compiled > TRANSITIONS:
                    self.states, self.compiled = {}, 0
                    row = self.row(row[None])
                after, k = self.compile(row[None], c)
                step = row[c] = self.row(after), k
                self.compiled += 1
            row, k = step
            total += k
        return row[None], total


class Memo(dict):
    """Counts of words from reset to reset."""

    def __init__(self, fst: Transducer, before: str):
        self.fst, self.before = fst, before

    def __missing__(self, word: str) -> int:
        n = self.fst.run(START, self.before + word)[1] if word or self.before else 0
        if len(word) <= 64:
            if len(self) >= WORDS:
                self.clear()
            self[word] = n
        return n


#: (head, count after it, state after it); the state is None if all is head.
Map = tuple[str, int, State | None]


class Counter:
    def __init__(self, scores: dict[str, float]):
        self.fst = Transducer(scores)
        self.spaced, self.bare = Memo(self.fst, " "), Memo(self.fst, "")
        self.line = self.fst.cost("\n")
        self.lines = "\n" not in self.fst.joined

    def closed(self, text: str) -> int:
        """Tokens of a text between two resets."""
        if not self.lines:
            return self.fst.run(START, text)[1]
        lines = text.split("\n")
        total = (len(lines) - 1) * self.line
        spaced, bare = self.spaced.__getitem__, self.bare.__getitem__
        for s in lines:
            if "  " in s or s[-1:] == " ":
                for unit in UNIT.findall(s):
                    w = unit.lstrip(" ")
                    k = len(unit) - len(w)
                    total += bare(w) if k == 0 else spaced(w) if k == 1 and w else self.fst.run(START, unit)[1]
            else:
                w = s.split(" ")
                total += bare(w[0]) + sum(map(spaced, w[1:]))
        return total

    def map(self, chunk: str) -> Map:
        first = re.search(r"\n|(?<=[^ ]) ", chunk) if self.lines else None
        if first is None:
            return chunk, 0, None
        i = first.start()
        j = _last(chunk, i)
        state, open_count = self.fst.run(START, chunk[j:])
        return chunk[:i], self.closed(chunk[i:j]) + open_count, state

    def compose(self, a: Map, b: Map) -> Map:
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, n = self.fst.run(a[2], b[0])
        return (a[0], a[1] + n, state) if b[2] is None else (a[0], a[1] + n + b[1], b[2])

    def scan(self, maps: list[Map]) -> list[Map]:
        """Inclusive prefix scan: doubling strides, each level's compositions
        independent of one another."""
        step = 1
        while step < len(maps):
            maps = [self.compose(maps[k - step], m) if k >= step else m for k, m in enumerate(maps)]
            step *= 2
        return maps

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = " " + text.replace(SPACE, " ")
        if len(text) <= CHUNK and self.lines:
            return self.closed(text)
        head, n, state = self.scan([self.map(text[k : k + CHUNK]) for k in range(0, len(text), CHUNK)])[-1]
        return self.fst.run(START, head)[1] + n


def _last(chunk: str, first: int) -> int:
    """Where the last reset stands: a line end or a space after no space."""
    j = len(chunk) - 1
    while j > first and not (chunk[j] == "\n" or chunk[j] == " " and chunk[j - 1] != " "):
        j -= 1
    return j


def piece_scores(model_path: str) -> dict[str, float]:
    """The ordinary pieces of a SentencePiece BPE model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return {sp.id_to_piece(k): sp.get_score(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))}


_COUNTERS: dict[str, Counter] = {}


def counter(model_path: str) -> Counter:
    if model_path not in _COUNTERS:
        _COUNTERS[model_path] = Counter(piece_scores(model_path))
    return _COUNTERS[model_path]


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""
    arrow_batches(docs.sparkSession)
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).count
        for t in batches:
            n = [count(x.as_py() or "") for x in t.column(1)]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.coalesce(F.col("n_tokens") > limit, F.lit(False)))
