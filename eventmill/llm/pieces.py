"""SentencePiece encoding and decoding by streaming Viterbi.

Positions of the text are lattice nodes, pieces that match are edges. Only the last
``max_len`` nodes can still be left by an edge; their backpointer paths are followed
back, and as soon as all of them pass through one boundary the ids before it are
committed and forgotten, so the window does not grow with the text.

Unigram models maximise the sum of scores. In BPE models an edge may follow another only
if the merge order, applied to the two pieces side by side, gives back just these two.
Merges work on neighbours alone, so a path whose neighbours all agree is the merge
result, and every prefix has exactly one: the Viterbi path equals the merge procedure.

Where no piece of the model reaches over the edge of a word (or at least of a blank), all
paths converge there, and the ids of the stretches between are kept in a bounded table. Texts that hold the blank mark U+2581 itself encode it as bytes, so that
decoding gives back every text exactly. Ids of other texts are those of the library.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventmill.llm.worker_cache import kept

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
_MARK = "\udc81"  # stands for a blank mark of the text; no valid text holds a lone surrogate
NORMAL, UNKNOWN, BYTE, BPE = 1, 2, 6, 2
KNOWN_STRETCHES = 400_000
KNOWN_PAIRS = 300_000
UNKNOWN_PENALTY = 10.0
_NEVER = (float("inf"), 0)
#: Letters of the Latin, Greek and Cyrillic blocks, for cutting only.
_L = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0370-\u03ff\u0400-\u04ff"
#: Ways to cut a text, finest first: stretches of the text, and the pieces that stay inside one.
_CUTS = [
    (re.compile(f" *(?:[{_L}]+|[^ {_L}]+)| +"), re.compile(f"{BLANK}*(?:[{_L}]+|[^{BLANK}{_L}]+)?")),
    (re.compile(" +[^ ]*"), re.compile(f"{BLANK}*[^{BLANK}]*")),
]


class Vocabulary:
    """Pieces of a model: what the tasks need, in plain values."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool):
        self.bpe = bpe
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.max_len = max(map(len, self.ids), default=1)
        self.floor = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.cut = next((text for text, inside in _CUTS if all(map(inside.fullmatch, self.ids))), None)
        kinds = {NORMAL: lambda p: p.replace(BLANK, " ").encode(), BYTE: lambda p: bytes([int(p[1:-1], 16)])}
        self.text = [kinds.get(kind, lambda p: b"")(p) for p, _, kind in pieces]
        self._names = [p for p, _, _ in pieces]
        self.key = hashlib.sha256(repr((pieces, bpe)).encode()).hexdigest()
        self._histories: dict[str, tuple] = {}
        self._automaton = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_histories": {}, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            found = ahocorasick.Automaton()
            for piece, i in self.ids.items():
                found.add_word(piece, (len(piece), i))
            if self.ids:
                found.make_automaton()
            self._automaton = found
        return self._automaton

    def name(self, edge: int) -> str:
        """Text of an edge: a piece, or a character numbered after the pieces."""
        return self._names[edge] if edge < len(self._names) else chr(edge - len(self._names))

    def of(self, piece: str) -> list[int]:
        """Ids of a lattice edge: its piece, or a character's bytes."""
        if piece in self.ids:
            return [self.ids[piece]]
        raw = BLANK.encode() if piece == _MARK else piece.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if len(self.bytes) == 256 else [self.unknown]

    def history(self, piece: str) -> tuple[list[tuple[float, int, str, str]], bool]:
        """Merges inside ``piece`` alone, as (minus score, place, first symbol, last symbol) after
        each; whether they end in the piece itself. Best score first and then leftmost."""
        if (known := self._histories.get(piece)) is None:
            symbols, events = list(piece), []
            while True:
                pairs = [
                    (-self.score[a + b], i)
                    for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))
                    if a + b in self.score
                ]
                if not pairs:
                    break
                cost, i = min(pairs)
                place = sum(map(len, symbols[:i]))
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                events.append((cost, place, symbols[0], symbols[-1]))
            known = self._histories[piece] = events, len(symbols) == 1
        return known

    def agree(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left`` (empty: the start) on a BPE path: merging both
        texts side by side never joins symbols across the boundary."""
        after, whole = self.history(right)
        if not whole or not left:
            return whole
        before, _ = self.history(left)
        shift, last, first = len(left), left[-1], right[0]
        x = y = 0
        while True:
            cross = self.score.get(last + first)
            here = before[x][:2] if x < len(before) else _NEVER
            there = (after[y][0], after[y][1] + shift) if y < len(after) else _NEVER
            if cross is not None and (-cross, shift - len(last)) < min(here, there):
                return False
            if here is _NEVER and there is _NEVER:
                return True
            if here < there:
                last = before[x][3]
                x += 1
            else:
                first = after[y][2]
                y += 1


def load(path: str = MODEL) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (
        rules.add_dummy_prefix and rules.escape_whitespaces
    ):
        raise ValueError("only models that leave texts as they are can be decoded exactly")
    return Vocabulary([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type == BPE)


def stream(text: str, v: Vocabulary, pairs: dict[int, bool]) -> Iterator[list[int]]:
    """Commits of ids for ``text``, blanks already marked; ``pairs`` keeps what :meth:`agree` said.

    An automaton of all pieces gives the edges, end by end and the longest first. Edges are
    numbered by piece; a character that is no piece is numbered after them.
    """
    first, width = len(v.text), v.max_len
    sep = 0x110000 + first + 1
    start, at_start = 0, sep - 1
    score, back, edge = [0.0], [0], [at_start]  # of the nodes from ``start`` on
    size = len(text)

    def allowed(key: int, left: int, right: int) -> bool:
        if len(pairs) >= KNOWN_PAIRS:
            pairs.clear()
        pairs[key] = fits = v.agree("" if left == at_start else v.name(left), v.name(right))
        return fits

    def close(i: int) -> Iterator[list[int]]:
        """Node i has seen all its edges but that of a lone unknown character."""
        nonlocal start, score
        if not v.bpe or edge[i - start] < 0:
            c = text[i - 1]
            if c not in v.ids:
                if v.bpe:
                    score[i - start], back[i - start], edge[i - start] = 0.0, i - 1, first + ord(c)
                elif edge[i - start] < 0 or score[i - 1 - start] + v.floor > score[i - start]:
                    score[i - start] = score[i - 1 - start] + v.floor
                    back[i - start], edge[i - start] = i - 1, first + ord(c)
        if edge[i - start] < 0:
            raise ValueError(f"no path reaches position {i}")
        if i == size or i - start >= 4 * width:
            # nodes that a later piece can still start from
            live = {i} if i == size else set(range(max(start, i - width + 1), i + 1))
            while len(live) > 1:  # the rightmost steps back until all paths meet
                last = max(live)
                live.discard(last)
                live.add(back[last - start])
            boundary = at = live.pop()
            path = []
            while at > start:
                path.append(edge[at - start])
                at = back[at - start]
            if path:
                path.reverse()
                yield path if max(path) < first else [x for e in path for x in (v.of(v.name(e)) if e >= first else [e])]
                del score[: boundary - start], back[: boundary - start], edge[: boundary - start]
                score = [x - score[0] for x in score]
                start = boundary

    done = 0  # nodes closed so far
    for end, (length, piece) in v.automaton().iter(text):
        i = end + 1
        if i - 1 > done:
            for k in range(done + 1, i):
                if k - start >= len(edge):
                    score.append(0.0), back.append(k - 1), edge.append(-1)
                yield from close(k)
            done = i - 1
        if i - start >= len(edge):
            score.append(0.0), back.append(i - 1), edge.append(-1)
        if v.bpe:
            if edge[i - start] < 0:
                left = edge[i - length - start]
                key = left * sep + piece
                fits = pairs.get(key)
                if allowed(key, left, piece) if fits is None else fits:
                    back[i - start], edge[i - start] = i - length, piece
        else:
            total = score[i - length - start] + v.score[v.name(piece)]
            if edge[i - start] < 0 or total > score[i - start]:
                score[i - start], back[i - start], edge[i - start] = total, i - length, piece
    for k in range(done + 1, size + 1):
        if k - start >= len(edge):
            score.append(0.0), back.append(k - 1), edge.append(-1)
        yield from close(k)


class Encoder(dict):
    """Stretch of text -> its ids as int32 bytes, filled as stretches turn up."""

    def __init__(self, v: Vocabulary, known: int = KNOWN_STRETCHES):
        super().__init__()
        self.v, self.known, self.pairs = v, known, {}

    def __missing__(self, stretch: str) -> bytes:
        marked = stretch.replace(" ", BLANK)
        ids = array("i", [x for part in stream(marked, self.v, self.pairs) for x in part]).tobytes()
        if len(stretch) <= 64:
            if len(self) >= self.known:
                self.clear()
            self[stretch] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        whole = " " + (text.replace(BLANK, _MARK) if BLANK in text else text)
        if self.v.cut is None:
            return self.__missing__(whole)
        return b"".join([self[x] for x in self.v.cut.findall(whole)])


def decode(ids, v: Vocabulary) -> str:
    """The text of ``ids``; exact for what :class:`Encoder` gives with a byte-complete vocabulary."""
    table = v.text
    return b"".join([table[i] for i in ids]).decode("utf-8", "replace")[1:]


def encode_texts(
    docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", model: str = MODEL
) -> DataFrame:
    """Columns ``keep`` (doc_id) of each row, ids array<int>, n_ids long, round_trip boolean.

    NULL and empty texts have no ids. round_trip says that decoding the ids gave the text
    (NULL: the empty text). Repeated rows are rows of their own; other columns are not
    read. The driver reads the model file, tasks get its pieces by broadcast (the size of
    one vocabulary).
    """
    keep = ["doc_id"] if keep is None else keep
    vocabulary = load(model)
    shared, key = docs.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.key
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    held = [f"_k{i}" for i in range(len(keep))]
    schema = ", ".join(
        [f"{c} {rows.schema[c].dataType.simpleString()}" for c in held]
        + ["ids array<int>", "n_ids long", "round_trip boolean"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        encoder = kept(f"pieces {key}", lambda: Encoder(v))
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            coded = [encoder.encode(t) for t in texts]
            same = [decode(np.frombuffer(c, np.int32).tolist(), v) == (t or "") for c, t in zip(coded, texts, strict=True)]
            sizes = np.array([len(c) // 4 for c in coded], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(coded), np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in held]
                + [pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(sizes), pa.array(same, pa.bool_())],
                names=[*held, "ids", "n_ids", "round_trip"],
            )

    coded = rows.mapInArrow(run, schema)
    return coded.select(*[F.col(h).alias(c) for h, c in zip(held, keep, strict=True)], "ids", "n_ids", "round_trip")


def decode_ids(
    coded: DataFrame, keep: list[str] | None = None, ids_col: str = "ids", model: str = MODEL
) -> DataFrame:
    """Columns ``keep`` (doc_id) of each row and the text of its ids; NULL ids give the empty text."""
    keep = ["doc_id"] if keep is None else keep
    shared = coded.sparkSession.sparkContext.broadcast(load(model))
    rows = coded.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(ids_col).alias("_ids"))
    held = [f"_k{i}" for i in range(len(keep))]
    schema = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in held] + ["text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            texts = [decode(ids or [], v) for ids in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in held] + [pa.array(texts, pa.string())], names=[*held, "text"]
            )

    plain = rows.mapInArrow(run, schema)
    return plain.select(*[F.col(h).alias(c) for h, c in zip(held, keep, strict=True)], "text")
