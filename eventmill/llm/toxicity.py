"""Toxicity of texts that may hide their words: a noisy channel, decoded, and a score of what it restores.

Writers hide words by look-alike signs (leetspeak), by spacing letters out and by repeating
them. Tokens with such marks become a lattice over characters: a sign may stand for a letter
or for itself, a repeated character and a separator may be dropped. The Viterbi path under a
character language model, which is counted over the whole corpus, is the restored text.

Restored words are scored by their character n-grams, hashed into a fixed number of buckets.
A feature is an n-gram in at least one, two, ... distinct words of a text, as some texts are
toxic by a word and others by how often a stem comes up. Features that occur more often in
toxic texts than in others, at the low end of the error, enter a logistic regression.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.llm.sampling import sample_rows
from eventmill.llm.worker_cache import kept
from eventmill.session import stage

#: Character classes of the language model: 0 is what lies between words, then a to z, then any other letter or digit.
EDGE, OTHER, CLASSES = 0, 27, 28
ORDER = 4
#: Weight of the shorter context in every step of the model's interpolation.
SHRINK = 4.0
#: Log probabilities of the channel: a sign for a letter, a letter written again, a separator inside a word, a star for a letter.
SIGN, AGAIN, SPACED, STAR = -1.0, -3.5, -1.5, -3.0
#: What signs stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = " \t.-_*'"
_OUTER = ".,;:?\"'()[]{}<>-_~`/\\&%#^=«»“”„¿…"
_SPACED = re.compile(r"(?<!\S)[^\s.\-_*'](?:[ \t.\-_*'][^\s.\-_*']){2,}(?![^\s.,;:!?])")
_MARKED = re.compile(r"(.)\1|[0-9@$!|+(€£¡.\-_*'\s]", re.S)
#: Lengths of the n-grams of a word with its edges marked; whole words count as one more.
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 20
_ROLL, _MIX, _SHIFT = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15), np.uint64(44)
#: Labelled documents that are learned from, at most so many of each label.
SAMPLE = 4_000
SKETCHES = 4
LEVELS = 4
LEAST = 3  # toxic documents that hold a feature
#: Log odds of a feature less so many standard errors must be over 0.
ERRORS = 2.0
RIDGE = 0.3
KNOWN_WORDS = 600_000
HELD_CODES = 1 << 22  # features counted at a time
PIECE_CHARS = 1 << 20
FIT_PIECE = 1 << 18  # features the regression adds up at a time


def _class_table() -> np.ndarray:
    table = np.full(0x250, EDGE, np.uint8)
    for code in range(0x250):
        c = fold(chr(code))[:1]
        if "a" <= c <= "z":
            table[code] = ord(c) - 96
        elif c.isalnum():
            table[code] = OTHER
    return table


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    if _LATIN and max(text) < "\u0250":
        return text.translate(_LATIN)
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


_LATIN: dict[int, str] = {}
_LATIN = {code: fold(chr(code)) for code in range(0x250)}
_CLASS = _class_table()
_CLASS_OF = {chr(i): int(k) for i, k in enumerate(_CLASS)}


def class_of(c: str) -> int:
    known = _CLASS_OF.get(c)
    return known if known is not None else OTHER if c.isalnum() else EDGE


def gram_counts(text: str) -> np.ndarray:
    """Codes of the model's n-grams in ``text``; a context doesn't reach over the edge of a word."""
    codes = np.frombuffer(f"   {text} ".encode("utf-32-le", "replace"), np.uint32)
    c = np.where(codes < 0x250, _CLASS[np.minimum(codes, 0x24F)], OTHER).astype(np.int32)
    x = c[:-1]
    y = np.where(x[1:] == EDGE, 0, x[:-1])
    z = np.where(y[1:] == EDGE, 0, x[:-2])
    code = ((z * CLASSES + y[1:]) * CLASSES + x[2:]) * CLASSES + c[3:]
    return code[(c[3:] != EDGE) | (x[2:] != EDGE)]


class CharacterModel:
    """Log probabilities of the next class after the last three."""

    def __init__(self, counts: np.ndarray):
        grams = counts.reshape((CLASSES,) * ORDER).astype(np.float64)
        p = np.full(CLASSES, 1 / CLASSES)
        for n in range(1, ORDER + 1):
            seen = grams.sum(axis=tuple(range(ORDER - n)))
            p = (seen + SHRINK * p) / (seen.sum(-1, keepdims=True) + SHRINK)
        self.log = np.log(p).astype(np.float32).reshape(-1, CLASSES)  # lists are faster, but for tasks to make


def edges_of(raw: str, i: int) -> list[tuple[str, float]]:
    """What the character at ``i`` may stand for, with log probabilities; '' drops it, ' ' ends a word."""
    c = raw[i]
    if c in SEPARATORS:
        out = [(" ", 0.0), ("", SPACED)]
        if c == "*" and 0 < i < len(raw) - 1 and raw[i - 1].isalpha() and raw[i + 1].isalpha():
            out += [(chr(97 + k), STAR) for k in range(26)]
    else:
        out = [(c if c.isalnum() else " ", 0.0)] + [(x, SIGN) for x in SIGNS.get(c, "")]
    if i and c == raw[i - 1] and c not in SEPARATORS:
        out.append(("", AGAIN))
    return out


def restore(raw: str, log: list[list[float]]) -> str:
    """Most likely text behind ``raw`` (folded): one Viterbi pass; a state is the last three classes."""
    keep, front = CLASSES * CLASSES, {0: (0.0, None)}
    for i in range(len(raw)):
        after: dict[int, tuple] = {}
        for emitted, cost in edges_of(raw, i):
            k = class_of(emitted) if emitted else EDGE
            for state, (total, path) in front.items():
                if not emitted:
                    score, target, way = total + cost, state, path
                elif k == EDGE:
                    # an edge after an edge says nothing new
                    score = total + cost + (log[state][EDGE] if state else 0.0)
                    target, way = 0, (" ", path)
                else:
                    score = total + cost + log[state][k]
                    target, way = (state % keep) * CLASSES + k, (emitted, path)
                known = after.get(target)
                if known is None or score > known[0]:
                    after[target] = score, way
        front = after
    _, path = max(((t + (log[s][EDGE] if s else 0.0), p) for s, (t, p) in front.items()), key=lambda x: x[0])
    out = []
    while path is not None:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


def written_once(plain: str, letter: str, log: list[list[float]]) -> bool:
    """Whether the doubled ``letter`` of a word of letters is more likely one letter that was written again.

    The two spellings differ in the steps that see both letters; all others are the same.
    """
    at = plain.index(letter * 2)
    a, b = (class_of(plain[i]) if i >= 0 else EDGE for i in (at - 2, at - 1))
    d = class_of(letter)
    e, f = (class_of(plain[i]) if i < len(plain) else EDGE for i in (at + 2, at + 3))
    before = log[(a * CLASSES + b) * CLASSES + d]
    one, two = before[e], before[d] + log[(b * CLASSES + d) * CLASSES + d][e]
    if at + 2 < len(plain):
        one += log[(b * CLASSES + d) * CLASSES + e][f]
        two += log[(d * CLASSES + d) * CLASSES + e][f]
    return one + AGAIN > two


_TAIL = re.compile(r"[!$@*+|#%&=~]{2,}$")


def words_of(token: str, log: list[list[float]]) -> list[str]:
    """Restored words of a token or of letters spaced out."""
    plain = fold(token)
    if not plain.isalpha():
        plain = _TAIL.sub("", plain.strip(_OUTER)).rstrip("!")
        if not any(map(str.isalpha, plain)):
            return []
    marks = _MARKED.findall(plain)
    if not marks:
        return [plain]
    if len(marks) == 1 and marks[0] and plain.isalpha() and marks[0] * 3 not in plain:
        # the lattice of one doubled letter has two ways
        return [plain.replace(marks[0] * 2, marks[0]) if written_once(plain, marks[0], log) else plain]
    return restore(plain, log).split()


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return values[first], np.diff(np.append(first, len(values)))


class Lists:
    """Lists of numbers, told by their places and added at the end."""

    def __init__(self):
        self.values, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values = np.concatenate([self.values, values.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values of the lists at ``places``, one list after the other, and the lists' sizes."""
        start, sizes = self.ends[places], self.ends[places + 1] - self.ends[places]
        at = np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return self.values[at].astype(np.int64), sizes


class Grams:
    """N-grams of words with their edges marked, as buckets: one row of arrays per length of ``GRAMS``."""

    def __init__(self, words: list[str]):
        marked = [f"^{w}$" for w in words]
        self.sizes = np.array([len(w) for w in marked], np.int64)
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        left = np.repeat(self.starts + self.sizes, self.sizes) - np.arange(len(codes))  # characters to the word's end
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []  # bucket of each place, whether the n-gram fits
        rolled = codes.copy()
        for n in range(2, max(GRAMS) + 1):
            rolled[: -(n - 1)] = rolled[: -(n - 1)] * _ROLL + codes[n - 1 :] if len(codes) >= n else 0
            if n in GRAMS:
                self.rows.append((((rolled + np.uint64(n)) * _MIX) >> _SHIFT, left >= n))

    def of(self, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(word, bucket) of all n-grams, each once a word, sorted; with ``wanted`` (by bucket) only those."""
        word = np.repeat(np.arange(len(self.sizes)), self.sizes)
        keys = [np.zeros(0, np.int64)]
        for b, fits in self.rows:
            at = np.flatnonzero(fits if wanted is None else fits & wanted[b])
            keys.append(word[at] * BUCKETS + b[at].astype(np.int64))
        both = _runs(np.concatenate(keys))[0]
        return both // BUCKETS, both % BUCKETS


def tokens_of(text: str) -> set[str]:
    """Distinct tokens of a text and the stretches of three single characters and more in it."""
    tokens = text.lower().split()
    found, held, last = set(tokens), [], -1
    single = {t for t in found if len(t) < 3 and len(t.strip(_OUTER)) == 1}
    short = [i for i, t in enumerate(tokens) if t in single] if single else []
    for i in [*short, -2]:
        if i != last + 1:
            if len(held) > 2:
                found.add(" ".join(held))
            held = []
        if i >= 0:
            held.append(tokens[i])
        last = i
    return found


def restore_text(text: str | None, log: list[list[float]]) -> str:
    """The text with its hidden words restored; what holds no mark stays as it is."""

    def token(found: re.Match) -> str:
        raw = found[0]
        plain = fold(raw).strip(_OUTER)
        return " ".join(words_of(raw, log)) or raw if _MARKED.search(_TAIL.sub("", plain).rstrip("!")) else raw

    joined = _SPACED.sub(lambda m: " ".join(words_of(m[0], log)) or m[0], text or "")
    return re.sub(r"\S+", token, joined)


# --- the language model of the corpus ----------------------------------------------------
def character_model(docs: DataFrame, text_col: str = "text") -> CharacterModel:
    """Counted over all texts: tasks add up their own n-grams, of which there are at most
    ``CLASSES ** ORDER``; so many rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**ORDER, np.int64)
        for batch in batches:
            held, size = [], 0
            for text in [*batch.column("t").to_pylist(), None]:
                if text:
                    held.append(text)
                    size += len(text)
                if held and (text is None or size >= PIECE_CHARS):
                    total += np.bincount(gram_counts(" ".join(held)), minlength=len(total))
                    held, size = [], 0
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["gram", "n"])

    texts = docs.select(F.col(text_col).alias("t"))
    found = texts.mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CLASSES**ORDER, np.int64)
    counts[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return CharacterModel(counts)


def restored(docs: DataFrame, model: CharacterModel | Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` (doc_id) of each row and its restored text; NULL gives the empty text."""
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    held = [f"_k{i}" for i in range(len(keep))]
    shared = docs.sparkSession.sparkContext.broadcast(model.log)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = shared.value.tolist()
        for batch in batches:
            texts = [restore_text(t, log) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in held], pa.array(texts, pa.string())], names=[*held, "text"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in held]
    out = rows.mapInArrow(run, ", ".join([*kinds, "text string"]))
    return out.select(*[F.col(h).alias(c) for h, c in zip(held, keep, strict=True)], "text")


# --- training ------------------------------------------------------------------------------
def sketch(text: str) -> list[int]:
    """Least hashes of the text's runs of three tokens, under several hash functions: near copies
    share most of them, other texts none."""
    words = text.split()
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = np.array([crc32(r.encode("utf-8", "surrogatepass")) for r in runs], np.uint64)
    return [int((((h + np.uint64(k)) * _MIX) >> np.uint64(1)).min()) for k in range(SKETCHES)]


def features(text: str, log: list[list[float]], wanted: np.ndarray | None = None) -> np.ndarray:
    """Codes bucket * LEVELS + level (0: in one distinct word or more) of a text's n-grams."""
    words = {w for token in tokens_of(text) for w in words_of(token, log)}
    if not words:
        return np.zeros(0, np.int64)
    bucket, count = np.unique(Grams(sorted(words)).of(wanted)[1], return_counts=True)
    return np.concatenate([bucket[count > k] * LEVELS + k for k in range(LEVELS)])


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Of features from the numbers of documents that hold them, at the low end of the error."""
    a, b = toxic + 0.5, clean + 0.5
    return np.log(a / (n_toxic + 1)) - np.log(b / (n_clean + 1)) - ERRORS * np.sqrt(1 / a + 1 / b)


def fit_logistic(lengths: np.ndarray, column: np.ndarray, y: np.ndarray, size: int, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and constant of a ridge regression on sets of features, by L-BFGS.

    ``lengths`` are the sizes of the rows' sets, ``column`` the features of all rows one after the
    other. Sums run over pieces of these, so that they need no copies as long as ``column``.
    """
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    pieces = [slice(at, at + FIT_PIECE) for at in range(0, len(row), FIT_PIECE)]

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, z = v[:-1], np.zeros(len(lengths))
        for part in pieces:
            np.add.at(z, row[part], v[column[part]])
        z += v[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        error, slope = p - y, np.zeros(size)
        for part in pieces:
            np.add.at(slope, column[part], error[row[part]])
        slope += RIDGE * w
        return np.logaddexp(0, z).sum() - z @ y + RIDGE / 2 * (w @ w), np.append(slope, error.sum())

    v = np.append(np.zeros(size), np.log(max(y.sum(), 0.5) / max(len(y) - y.sum(), 0.5)))
    value, slope = loss(v)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, used = slope.copy(), []
        for s, g in reversed(past):
            used.append((s @ way) / (s @ g))
            way -= used[-1] * g
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(slope).max())
        for (s, g), a in zip(past, reversed(used), strict=True):
            way += s * (a - (g @ way) / (s @ g))
        step = 1.0
        while True:
            there = v - step * way
            new, at = loss(there)
            if new <= value - 1e-4 * step * (slope @ way) or step < 1e-6:
                break
            step /= 2
        done = value - new < 1e-7 * max(1.0, abs(value))
        if (there - v) @ (at - slope) > 0:
            past = [*past, (there - v, at - slope)][-10:]
        if new < value:
            v, value, slope = there, new, at
        if done:
            break
    return v[:-1], float(v[-1])


@dataclass
class Model:
    """What scoring needs; a few MB whatever the corpus."""

    log: np.ndarray
    place: np.ndarray  # bucket -> row of ``gain``, or -1
    gain: np.ndarray  # row, number of words that hold the n-gram -> sum of its levels' weights
    constant: float
    base: float  # score where nothing could be learned
    learned: bool
    key: str = field(default="")

    def __post_init__(self):
        held = [self.place.tobytes(), self.gain.tobytes(), self.log.tobytes(), repr(self.constant).encode()]
        self.key = hashlib.sha256(b"".join(held)).hexdigest()

    @classmethod
    def of(cls, log: np.ndarray, codes: np.ndarray, weights: np.ndarray, constant: float, base: float) -> Model:
        buckets = np.unique(codes // LEVELS)
        place = np.full(BUCKETS, -1, np.int32)
        place[buckets] = np.arange(len(buckets))
        gain = np.zeros((len(buckets), LEVELS + 1))
        gain[place[codes // LEVELS], codes % LEVELS + 1] = weights
        return cls(log, place, np.cumsum(gain, axis=1), constant, base, True)

    @classmethod
    def nothing(cls, log: np.ndarray, base: float) -> Model:
        return cls(log, np.full(BUCKETS, -1, np.int32), np.zeros((0, LEVELS + 1)), 0.0, base, False)


class Scorer:
    """Tokens met so far, with the words in them that hold features; bounded.

    Tokens that differ in the signs around them are restored once. Words and their features lie
    in arrays, which the texts of a block read together.
    """

    def __init__(self, model: Model):
        self.model, self.wanted, self.log = model, model.place >= 0, model.log.tolist()
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}  # token, or one without the signs around it -> place in ``inside``
        self.words: dict[str, int] = {}  # word that holds features -> place in ``rows``
        self.inside, self.rows = Lists(), Lists()
        self.inside.add(np.zeros(0, np.int32), np.zeros(1, np.int64))  # place 0: no such word

    def learn(self, tokens: set[str]) -> None:
        """The new ones among the tokens, all at once."""
        new = tokens.difference(self.known)
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.clear()
            new = tokens
        cores = [t.strip(_OUTER) for t in new]
        fresh = list(set(cores).difference(self.known))
        found = [words_of(c, self.log) for c in fresh]
        unmet = list(set(chain.from_iterable(found)).difference(self.words))
        word, bucket = Grams(unmet).of(self.wanted)
        sizes = np.bincount(word, minlength=len(unmet))
        telling = np.flatnonzero(sizes)
        self.words.update(zip([unmet[k] for k in telling.tolist()], range(len(self.rows), len(self.rows) + len(telling)), strict=True))
        self.rows.add(self.model.place[bucket], sizes[telling])
        places, lengths, at = [], [], len(self.inside)
        for c, words in zip(fresh, found, strict=True):
            own = [self.words[w] for w in words if w in self.words]
            self.known[c] = at + len(lengths) if own else 0
            if own:
                places += own
                lengths.append(len(own))
        self.inside.add(np.array(places, np.int32), np.array(lengths, np.int64))
        self.known.update(zip(new, [self.known[c] for c in cores], strict=True))

    def scores(self, texts: list[str | None]) -> Iterator[float]:
        """Of texts, about ``PIECE_CHARS`` at a time, whose new tokens are learned together."""
        held, size = [], 0
        for k, text in enumerate(texts):
            held.append(tokens_of(text) if text else set())
            size += len(text or "")
            if size >= PIECE_CHARS or k == len(texts) - 1:
                yield from self.block(held)
                held, size = [], 0

    def block(self, texts: list[set[str]]) -> list[float]:
        """Of texts by their tokens."""
        m = self.model
        if not m.learned:
            return [m.base] * len(texts)
        tokens = set().union(*texts)
        self.learn(tokens)
        places = {t: self.known[t] for t in tokens}  # most tokens of a block are in several of its texts
        sizes = [len(t) for t in texts]
        place = np.fromiter(map(places.__getitem__, chain.from_iterable(texts)), np.int64, sum(sizes))
        text = np.repeat(np.arange(len(texts)), sizes)[place > 0]
        word, sizes = self.inside.of(place[place > 0])
        n_words, n_rows = max(1, len(self.rows)), max(1, len(m.gain))
        text, word = np.divmod(_runs(np.repeat(text, sizes) * n_words + word)[0], n_words)
        row, sizes = self.rows.of(word)
        both, count = _runs(np.repeat(text, sizes) * n_rows + row)
        text, row = np.divmod(both, n_rows)
        gain = m.gain[row, np.minimum(count, LEVELS)]
        ends = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        z = [m.constant + float(gain[a:b].sum()) for a, b in pairwise(ends)]
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z]


def trained_on(doc_id: Column, folds: int = 5) -> Column:
    """Whether labels of a document may be learned from; a document without an id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) != 0, F.lit(True))


def _feature_counts(rows: DataFrame, log, wanted=None) -> DataFrame:
    """code, n: documents of ``rows`` that hold each feature. A task adds up millions at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, size = [], 0

        def flush() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

        mask, table = None if wanted is None else wanted.value, log.value.tolist()
        for batch in batches:
            for text in batch.column("t").to_pylist():
                codes.append(features(text, table, mask))
                size += len(codes[-1])
                if size >= HELD_CODES:
                    yield flush()
                    codes, size = [], 0
        yield flush()

    return rows.select("t").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE) -> Model:
    """The character model of all texts, and a regression on labelled ones.

    Labels of one document are one: toxic if any says 1. At most ``limit`` labelled documents
    of each label, drawn by a hash of the id, are read; of those that share a sketch value, near
    copies, one stays, so that words of a text that is often copied don't look toxic. The
    constant is moved to the share of toxic rows among all that may be learned from.
    """
    spark = docs.sparkSession
    language = character_model(docs, text_col)
    marks = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
    known = marks.agg(F.max((F.col("toxic") == 1).cast("int")).alias("_y")).filter(trained_on(F.col("_id")))
    totals = {r._y: r.n for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    nothing = Model.nothing(language.log, totals.get(1, 0) / max(1, sum(totals.values())))
    if len(totals) < 2:
        return nothing
    drawn = [r for y in (0, 1) for r in sample_rows(known.filter(F.col("_y") == y), F.xxhash64("_id", F.lit(13)), limit)]
    sample = spark.createDataFrame(drawn, known.schema)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(sample), "_id")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sketch(t) for t in batch.column("t").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("_y"), batch.column("t"), found], names=["_y", "t", "s"])

    every = texts.mapInArrow(sketched, "_y int, t string, s array<long>").withColumn("_r", F.monotonically_increasing_id())
    every = stage(every, "toxicity")
    seen: set[tuple] = set()
    picked: list[tuple[int, int]] = []
    for r in every.select("_r", "_y", "s").orderBy("s", "_r").collect():  # of the bounded sample
        own = {(r._y, k, x) for k, x in enumerate(r.s)}
        if not own & seen:
            picked.append((r._r, r._y))
        seen |= own
    sizes = [sum(y == k for _, y in picked) for k in (0, 1)]
    if not all(sizes):
        return nothing
    rows = every.join(F.broadcast(spark.createDataFrame(picked, "_r long, _y int").select("_r")), "_r", "left_semi")
    log = spark.sparkContext.broadcast(language.log)
    toxic = _feature_counts(rows.filter("_y = 1"), log).filter(F.col("n") >= LEAST).toArrow().sort_by("code")
    codes = toxic.column("code").to_numpy()
    wanted = np.zeros(BUCKETS, bool)
    wanted[codes // LEVELS] = True
    clean = _feature_counts(rows.filter("_y = 0"), log, spark.sparkContext.broadcast(wanted)).toArrow()
    found, n = clean.column("code").to_numpy(), clean.column("n").to_numpy()
    both, at, place = np.intersect1d(codes, found, assume_unique=True, return_indices=True)
    held = np.zeros(len(codes), np.int64)
    held[at] = n[place]
    codes = codes[log_odds(toxic.column("n").to_numpy(), held, sizes[1], sizes[0]) > 0]
    del toxic, clean, found, n, both, at, place, held
    telling = spark.sparkContext.broadcast(codes)

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_codes, table = telling.value, log.value.tolist()
        mask = np.zeros(BUCKETS, bool)
        mask[known_codes // LEVELS] = True
        for batch in batches:
            found = [features(t, table, mask) for t in batch.column("t").to_pylist()]
            places = [np.flatnonzero(np.isin(known_codes, c)).astype(np.int32) for c in found]
            yield pa.RecordBatch.from_arrays([batch.column("_r"), batch.column("_y"), pa.array(places, pa.list_(pa.int32()))], names=["_r", "_y", "f"])

    # of the bounded sample; in the driver's Python a feature takes four bytes
    fitted = rows.select("_r", "_y", "t").mapInArrow(active, "_r long, _y int, f array<int>").toArrow().sort_by("_r").combine_chunks()
    y, sets = fitted.column("_y").to_numpy().astype(np.float64), fitted.column("f").combine_chunks()
    weights, constant = fit_logistic(sets.value_lengths().to_numpy(), sets.flatten().to_numpy(), y, len(codes))
    constant += math.log(totals[1] / totals[0]) - math.log(sizes[1] / sizes[0])
    return Model.of(language.log, codes, weights, constant, nothing.base)


# --- scoring -------------------------------------------------------------------------------
def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every row.

    NULL and empty texts have the score of a text without any feature. Repeated rows are rows of
    their own; a row without an id isn't held out. Where labels of both kinds can't be
    learned from, every score is the share of toxic ones (0 without any).
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), model.key
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(f"toxicity {key}", lambda: Scorer(shared.value))
        for batch in batches:
            found = list(scorer.scores(batch.column("_text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", (~trained_on(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score_texts(docs, train(docs, labels, id_col, text_col), id_col, text_col)
