"""Language ID with a linear-chain conditional random field over the words of a text.

A word's features are its affixes, character n-grams, and its entry in the lexicon of
words seen in training; transitions between word labels are learned with them. Training
takes a bounded sample of labelled documents, drawn for each language of all labelled rows
and among distinct texts, cut into stretches and strung together across languages, so that
it sees switches. Forward-backward then gives every word of a
text, code-switched or not, a distribution over languages; the mean over its words is the
text's. Nothing but the text enters a prediction.

Forward-backward runs over all words of many texts at once: texts are cut into segments,
the transfer matrix of each segment is multiplied up step by step for all segments
together, segments are chained, and the messages inside them follow. This is exact.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventmill.llm.worker_cache import kept

UNKNOWN = "und"
SAMPLE_DOCS = 2000  # labelled documents that training may take, shared out evenly to the languages
LEAST_DOCS = 20  # of each language, however many there are
SAMPLE_CHARS = 1500  # characters of each, from a place its hash chooses
SEGMENT = 32
GROUP_WORDS = 300_000
KNOWN_WORDS = 350_000
_SPAN = 1 << 30
SURE = 0.7  # of the way from chance to certainty: the mean certainty of words a learned language has at least
ENOUGH = 20  # letters; shorter texts say too little to be told from all learned languages
HELD_MODULUS, HELD_REMAINDER = 4, 2


def letters(token: str) -> str:
    return token if token.isalpha() else "".join([c for c in token if c.isalpha()])


def features(w: str) -> list[str]:
    """Features of a word, given as its letters in lower case: lexicon entry, affixes, n-grams."""
    marked = f"<{w}>"
    pairs = map(str.__add__, marked, marked[1:])
    return ["w" + w, "p" + w[:4], "s" + w[-4:], *pairs, *[marked[i : i + 3] for i in range(len(w))]]


def _transfer(P: np.ndarray, A: np.ndarray, pi: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Posterior label distributions of all words; ``P`` emission factors, texts of ``sizes`` words."""
    n, k = P.shape
    per_text = -(-sizes // SEGMENT)
    segments = int(per_text.sum())
    text_of = np.repeat(np.arange(len(sizes)), per_text)
    first_seg = np.cumsum(per_text) - per_text
    nth = np.arange(segments) - first_seg[text_of]
    begin = (np.cumsum(sizes) - sizes)[text_of] + nth * SEGMENT
    length = np.minimum(SEGMENT, sizes[text_of] - nth * SEGMENT)
    at = begin[:, None] + np.arange(SEGMENT)
    live = np.arange(SEGMENT) < length[:, None]
    factor = np.where(live[..., None], P[np.where(live, at, 0)], 1.0)  # segment, step, label
    head = nth == 0
    opening = np.broadcast_to(pi, (k, k))

    # transfer matrix of each segment: row = label before it
    M = np.where(head[:, None, None], opening, A) * factor[:, 0][:, None, :]
    for t in range(1, SEGMENT):
        go = live[:, t]
        if not go.any():
            break
        step = (M.reshape(-1, k) @ A).reshape(-1, k, k) * factor[:, t][:, None, :]
        step /= step.sum((1, 2), keepdims=True)
        M = np.where(go[:, None, None], step, M)
    # chain the segments of each text, all texts together
    enter = np.full((segments, k), 1.0 / k)
    leave = np.ones((segments, k))
    by_place = np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[by_place], np.arange(1, int(per_text.max(initial=0)) + 1))
    groups = np.split(by_place, cuts)[: int(per_text.max(initial=0))]
    for group in groups[1:]:
        v = np.einsum("si,sij->sj", enter[group - 1], M[group - 1])
        enter[group] = v / v.sum(1, keepdims=True)
    for group in reversed(groups[1:]):
        v = np.einsum("sij,sj->si", M[group], leave[group])
        leave[group - 1] = v / v.sum(1, keepdims=True)
    # messages inside the segments
    alpha = np.empty((SEGMENT, segments, k))
    v = np.where(head[:, None], pi, enter @ A) * factor[:, 0]
    alpha[0] = v / v.sum(1, keepdims=True)
    for t in range(1, SEGMENT):
        v = (alpha[t - 1] @ A) * factor[:, t]
        alpha[t] = v / v.sum(1, keepdims=True)
    beta = np.empty((SEGMENT, segments, k))
    last = length - 1
    v = leave.copy()
    for t in range(SEGMENT - 1, -1, -1):
        if t < SEGMENT - 1:
            u = (factor[:, t + 1] * v) @ A.T
            v = np.where((t < last)[:, None], u / u.sum(1, keepdims=True), leave)
        beta[t] = v
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    out = np.empty((n, k))
    out[at[live]] = post.transpose(1, 0, 2)[live]
    return out


@dataclass
class Model:
    """Labels, feature weights and transitions (logarithms)."""

    labels: list[str]
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    trans: np.ndarray | None = None
    start: np.ndarray | None = None

    @property
    def key(self) -> str:
        raw = b"" if self.weights is None else self.weights.tobytes() + self.trans.tobytes()
        return hashlib.sha256(repr(self.labels).encode() + raw).hexdigest()

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log factors of words, one row each."""
        get = self.index.get
        rows, ends = [], []
        for w in words:
            rows += [i for f in features(w) if (i := get(f)) is not None]
            ends.append(len(rows))
        table = np.vstack([self.weights[np.array(rows, np.int64)], np.zeros((1, len(self.labels)))])
        starts = np.array([0, *ends[:-1]], np.int64)
        total = np.add.reduceat(table, starts, axis=0) if words else np.empty((0, len(self.labels)))
        total[np.array(ends) == starts] = 0
        return total

    def posteriors(self, E: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        P = np.exp(E - E.max(1, keepdims=True))
        A = np.exp(self.trans - self.trans.max())
        return _transfer(P + 1e-30, A, np.exp(self.start - self.start.max()), sizes)


def train(sample: list[tuple[str, str]], rounds: int = 6, seed: int = 11) -> Model:
    """Fit on (text, language) pairs by gradient ascent on the likelihood of mixed word sequences."""
    docs = [([w for t in text.split() if (w := letters(t).lower())], y) for text, y in sample]
    docs = [(w, y) for w, y in docs if w]
    model = Model(sorted({y for _, y in docs}))
    k = len(model.labels)
    if k < 2:
        return model
    seen = Counter(f for words, _ in docs for w in set(words) for f in features(w))
    model.index = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c > 1))}
    model.weights = np.zeros((len(model.index), k))
    model.trans, model.start = np.zeros((k, k)), np.zeros(k)
    rng = np.random.default_rng(seed)
    by_label = [[w for w, y in docs if y == label] for label in model.labels]
    rows_of: dict[str, np.ndarray] = {}

    def rows(word: str) -> np.ndarray:
        if word not in rows_of:
            found = [i for f in features(word) if (i := model.index.get(f)) is not None]
            rows_of[word] = np.array(found, np.int64)
        return rows_of[word]

    squares = [np.full_like(x, 1e-6) for x in (model.weights, model.trans, model.start)]
    sequences, length = 48, 48
    steps = rounds * max(4, min(40, sum(len(w) for w, _ in docs) // (sequences * length)))
    for _ in range(steps):
        words, truth = [], []
        for _ in range(sequences):
            need = length
            while need:
                y = int(rng.integers(k))
                source = by_label[y][int(rng.integers(len(by_label[y])))]
                at = int(rng.integers(len(source)))
                part = source[at : at + min(need, int(rng.integers(4, 25)))]
                words += part
                truth += [y] * len(part)
                need -= len(part)
        found = [rows(w) for w in words]
        flat, owner = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
        E = np.zeros((len(words), k))
        np.add.at(E, owner, model.weights[flat])
        sizes = np.full(sequences, length)
        post = model.posteriors(E, sizes)
        y = np.array(truth)
        gap = -post
        gap[np.arange(len(y)), y] += 1
        grads = [np.zeros_like(model.weights), np.zeros((k, k)), gap.reshape(sequences, length, k)[:, 0].sum(0)]
        np.add.at(grads[0], flat, gap[owner])
        # expected transitions from the messages of neighbours
        P = np.exp(E - E.max(1, keepdims=True)).reshape(sequences, length, k)
        A = np.exp(model.trans)
        a, b = np.empty_like(P), np.ones_like(P)
        a[:, 0] = P[:, 0] * np.exp(model.start)
        for t in range(length):
            if t:
                a[:, t] = (a[:, t - 1] @ A) * P[:, t]
            a[:, t] /= a[:, t].sum(1, keepdims=True)
        for t in range(length - 2, -1, -1):
            b[:, t] = (P[:, t + 1] * b[:, t + 1]) @ A.T
            b[:, t] /= b[:, t].sum(1, keepdims=True)
        pair = a[:, :-1, :, None] * A * (P * b)[:, 1:, None, :]
        grads[1] -= (pair / pair.sum((2, 3), keepdims=True)).sum((0, 1))
        pairs = y.reshape(sequences, length)
        np.add.at(grads[1], (pairs[:, :-1].ravel(), pairs[:, 1:].ravel()), 1)
        for x, g, s, pull in zip(
            (model.weights, model.trans, model.start), grads, squares, (1e-3, 1e-2, 1e-2), strict=True
        ):
            g = g - pull * x
            s += g * g
            x += 0.3 * g / np.sqrt(s)
    return model


class Tagger:
    """Log factors of words, kept between tasks of a Python worker in tables of bounded size."""

    def __init__(self, model: Model):
        self.model, self.k = model, len(model.labels)
        self.slot: dict[str, int] = {}  # token -> row of its word; -1 without letters
        self.row: dict[str, int] = {}  # word -> row
        self.factors = np.empty((KNOWN_WORDS, self.k), np.float32)

    def _learn(self, tokens: set[str]) -> None:
        words = {t: letters(t).lower() for t in tokens}
        new = list({w for w in words.values() if w and w not in self.row})
        for j in range(0, len(new), 20_000):
            part = new[j : j + 20_000]
            used = len(self.row)
            self.factors[used : used + len(part)] = self.model.emissions(part)
            self.row.update(zip(part, range(used, used + len(part)), strict=True))
        row = self.row
        self.slot.update((t, row[w] if w else -1) for t, w in words.items())

    def _emissions(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(positions of words among the tokens, their log factors)."""
        at = list(map(self.slot.get, tokens))
        if None in at:
            new = {t for t, i in zip(tokens, at, strict=True) if i is None}
            if len(self.slot) + len(new) > KNOWN_WORDS:
                self.slot.clear()
                self.row.clear()
                new = set(tokens)
            if len(new) > KNOWN_WORDS:  # one text with more words than the tables hold
                half = len(tokens) // 2
                (a, x), (b, y) = self._emissions(tokens[:half]), self._emissions(tokens[half:])
                return np.concatenate([a, b + half]), np.concatenate([x, y])
            self._learn(new)
            at = list(map(self.slot.get, tokens))
        index = np.array(at, np.int64)
        keep = np.flatnonzero(index >= 0)
        return keep, self.factors[index[keep]].astype(np.float64)

    def tag(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, places of its words among its tokens, their posterior distributions) of texts with words, in groups of bounded size."""
        group, held = [], 0
        for i, text in enumerate(texts):
            tokens = (text or "").split()
            group.append((i, tokens))
            held += len(tokens)
            if held >= GROUP_WORDS:
                yield from self._tag_group(group)
                group, held = [], 0
        yield from self._tag_group(group)

    def _tag_group(self, group: list[tuple[int, list[str]]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        tokens = [t for _, ts in group for t in ts]
        if not tokens:
            return
        keep, E = self._emissions(tokens)
        owner = np.repeat(np.arange(len(group)), [len(ts) for _, ts in group])[keep]
        sizes = np.bincount(owner, minlength=len(group))
        full = np.flatnonzero(sizes)
        if not len(full):
            return
        post = self.model.posteriors(E, sizes[full])
        ends = np.cumsum(sizes[full])
        firsts = np.cumsum([0] + [len(ts) for _, ts in group])
        for j, end in zip(full, ends, strict=True):
            span = slice(end - sizes[j], end)
            yield group[j][0], keep[span] - firsts[j], post[span]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def labelled_sample(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_limit: int = SAMPLE_DOCS
) -> list[tuple[str, str]]:
    """(text, language) pairs of documents that aren't held out, the same number for each language.

    Languages are counted over all rows whose text has letters. Each gets its share of
    ``docs_limit`` distinct texts, ``LEAST_DOCS`` at least, chosen by hash, or all it has.
    """
    row = docs.select(
        F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("y")
    )
    learn = row.filter("y is not null").filter(F.col("t").rlike(r"\p{L}")).filter(~is_held_out(F.col("i")))
    learn = learn.withColumn("h", F.xxhash64("t")).withColumn("drawn", F.pmod("h", F.lit(_SPAN)))
    texts = {r.y: r.n for r in learn.groupBy("y").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not texts:
        return []
    quota = max(LEAST_DOCS, docs_limit // len(texts))
    spark = docs.sparkSession
    shares = [(y, int(min(1.0, (1.5 * quota + 20) / max(1, n)) * _SPAN) + 1) for y, n in texts.items()]
    near = learn.join(F.broadcast(spark.createDataFrame(shares, "y string, below long")), "y").filter("drawn < below")
    # one row of each text, whatever its copies
    one = near.groupBy("y", "drawn", "h").agg(F.min(F.xxhash64("i", "t")).alias("r")).collect()
    chosen, taken = [], Counter()
    for r in sorted(one):
        if taken[r.y] < quota:
            taken[r.y] += 1
            chosen.append((r.y, r.h, r.r))
    wanted = F.broadcast(spark.createDataFrame(chosen, "y string, h long, r long"))
    room = F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(0)) + 1
    part = F.substring(F.col("t"), (F.pmod("h", room) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    lettered = F.substring(F.regexp_replace("t", r"^\P{L}+", ""), 1, SAMPLE_CHARS)
    rows = near.withColumn("r", F.xxhash64("i", "t")).join(wanted, ["y", "h", "r"]).dropDuplicates(["y", "h"])
    rows = rows.select(F.when(part.rlike(r"\p{L}"), part).otherwise(lettered).alias("t"), "y", "drawn", "h")
    return [(r.t, r.y) for r in sorted(rows.collect(), key=lambda r: (r.drawn, r.h, r.y))]


def is_held_out(doc_id) -> F.Column:
    """crc32(doc_id as text) mod 4 is 2; a NULL id counts as empty text."""
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return crc % HELD_MODULUS == HELD_REMAINDER


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of a table; a table without labelled rows gives one without languages."""
    return train(labelled_sample(docs, id_col, text_col, lang_col))


def _certainty(text: str, post: np.ndarray) -> float:
    """Mean over the words of their largest posterior; 1 for texts that say too little."""
    if len(post) < ENOUGH and sum(c.isalpha() for c in text) < ENOUGH:
        return 1.0
    return float(post.max(1).mean())


def predict(
    docs: DataFrame,
    model: Model,
    keep: list[str] | None = None,
    text_col: str = "text",
    runs: bool = False,
    certainty: bool = False,
) -> DataFrame:
    """Columns ``keep`` (doc_id) of each row, lang_pred, score, and with ``runs`` the label runs.

    lang_pred is the language with the largest mean posterior over the text's words, score
    that mean; NULL texts and texts without letters are ``und`` with score 0. With one
    language learned all others are it, with score 1; with none, ``und``. A run is (lang,
    first token, tokens) over the white-space tokens with letters. ``certainty`` adds the
    mean over the words of their largest posterior: low where no learned language fits, high
    in texts that switch between learned ones; NULL without letters, 1 where there is nothing
    to tell apart. Repeated rows are rows of their own; other columns are not read.
    """
    keep = ["doc_id"] if keep is None else keep
    held = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(h) for c, h in zip(keep, held, strict=True)], F.col(text_col).alias("_text"))
    shared, key = docs.sparkSession.sparkContext.broadcast(model), model.key
    names = [*held, "lang_pred", "score"] + ["runs"] * runs + ["certainty"] * certainty
    schema = ", ".join(
        [f"{h} {rows.schema[h].dataType.simpleString()}" for h in held]
        + ["lang_pred string", "score double"]
        + ["runs array<struct<lang:string,first:long,tokens:long>>"] * runs
        + ["certainty double"] * certainty
    )
    run_type = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.labels)
        tagger = kept(f"language {key}", lambda: Tagger(model)) if k > 1 else None
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            spans: list[list[dict]] = [[] for _ in texts]
            certain = [1.0 if has_letter(t) else None for t in texts] if certainty else []
            if k == 1:
                sure = [has_letter(t) for t in texts]
                pred = [model.labels[0] if s else UNKNOWN for s in sure]
                score = [float(s) for s in sure]
            for i, at, post in tagger.tag(texts) if tagger else ():
                mean = post.mean(0)
                best = int(mean.argmax())
                pred[i], score[i] = model.labels[best], min(1.0, float(mean[best]))
                if certainty:
                    certain[i] = _certainty(texts[i], post)
                if runs:
                    y = post.argmax(1)
                    cuts = np.flatnonzero(np.diff(y)) + 1
                    for part in np.split(np.arange(len(y)), cuts):
                        first, last = int(at[part[0]]), int(at[part[-1]])
                        spans[i].append({"lang": model.labels[y[part[0]]], "first": first, "tokens": last - first + 1})
            added = [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            added += [pa.array(spans, run_type)] * runs
            added += [pa.array(certain, pa.float64())] * certainty
            yield pa.RecordBatch.from_arrays([*[batch.column(h) for h in held], *added], names=names)

    told = rows.mapInArrow(run, schema)
    return told.select(*[F.col(h).alias(c) for h, c in zip(held, keep, strict=True)], *names[len(held) :])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    told = predict(docs, fit(docs, id_col, text_col, lang_col), [id_col], text_col)
    return told.select(
        F.col(id_col).alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score"
    )


def drop_unidentified(
    docs: DataFrame, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``docs`` without texts in none of the learned languages, without letters, or with a score below ``least``.

    In a text of a learned language, or of several, words are certain of theirs; where none
    fits they stay near chance. A text goes if the mean certainty of its words is less than
    ``SURE`` of the way from chance to 1. Texts of fewer than ``ENOUGH`` letters stay, and all
    texts with letters where fewer than two languages are learned.
    """
    model = fit(docs, id_col, text_col, lang_col)
    chance = 1 / max(2, len(model.labels))
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(p) for c, p in place.items()])
    told = predict(plain, model, list(place.values()), place[text_col], certainty=True)
    kept = told.filter((F.col("certainty") >= chance + SURE * (1 - chance)) & (F.col("score") >= least))
    return kept.select(*[F.col(p).alias(c) for c, p in place.items()])
