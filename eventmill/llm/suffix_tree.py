"""Language-model scores from a probabilistic suffix tree over words.

A state is a context of one to ``DEPTH`` words. Contexts with ``LEAST`` training tokens after
them are candidates, whatever the size of the corpus. A candidate is kept if its next-word
distribution diverges from that of its longest kept suffix: leaving each token out in turn,
the state must predict the tokens after it better than the suffix does by ``GAIN`` nats or
more in all. A kept state lists the next words seen ``LEAST_NEXT`` times after it; these are
smoothed towards the suffix's distribution with the weight that predicts best, and the
rest of the mass is shared out as the suffix has it, so every distribution sums to one.
A token is scored by the longest kept suffix of the words before it.

The tree grows with the corpus and is nowhere whole. All contexts that end with one word form
a branch; branches are dealt to buckets, with the tokens that follow their word in any text,
counted, tested and met by these tokens there. What a bucket adds to a text's score goes back
by the text's number. Next words outside the dictionary come as a list, joined with their
own counts. A word with more than a bucket's share of tokens gets several buckets, told apart
by the word before it, and such a pair of words several ones by the word before the pair; the
lists of the word and the pair, counted over all of them, go to each. Tokens cross the
network with the three words before them, about 13 bytes each, in ``ROUNDS`` rounds.

Words of ``HEAD_SHARE`` of the training tokens or more, at most 1 / HEAD_SHARE, are broadcast
and numbered by rank; other words go by a hash of 62 bits, their counts are joined.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.llm.shingles import words
from eventmill.session import stage, stage_clean

DEPTH = 3
HEAD_SHARE = 1e-6
LEAST = 4  # tokens after a state
LEAST_NEXT = 2  # times a listed word
GAIN = 10.0
WEIGHTS = (1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0)
FLUSH = 3_000_000
BLOCK = 750_000  # tokens dealt to buckets at once
BUCKET = 500_000  # tokens of a bucket, about; a context with twice as many gets several
ROUNDS = 2  # tokens cross the network in, each round's files removed after it
TAIL = 1 << 62  # numbers of words outside the dictionary start here
END = b""  # no word is empty


def is_held_out(doc_id):
    """crc32(doc_id as text) mod 7 is 2; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in the sorted ``keys``, -1 where missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Tree:
    """Dictionary, candidate contexts of each depth, and the kept states; of all words or of a bucket's branches."""

    total: int  # training tokens
    kinds: int  # distinct training tokens
    head: Sequence
    counts: np.ndarray  # of the head's words
    contexts: list[np.ndarray] = field(default_factory=list)  # per depth: sorted keys
    suffix: list[np.ndarray] = field(default_factory=list)  # per depth: place of the context without its first word
    first: list[int] = field(default_factory=list)  # per depth: number of its first state
    state: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # longest kept suffix of a context, or -1
    parent: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # the next shorter kept state
    rest: np.ndarray = field(default_factory=lambda: np.empty(0))  # log factor of words a state doesn't list
    to_root: np.ndarray = field(default_factory=lambda: np.empty(0))  # sum of these up to the root
    listed: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # sorted keys (state, word)
    logp: np.ndarray = field(default_factory=lambda: np.empty(0))

    def __post_init__(self):
        self.root = np.log((self.counts + 1) / (self.total + self.kinds + 1))
        self.ids = None

    @property
    def width(self) -> int:
        return len(self.head)

    def dictionary(self) -> dict[bytes, int]:
        if self.ids is None:
            self.ids = {w: i for i, w in enumerate(self.head)}
        return self.ids

    def __getstate__(self):
        return {**self.__dict__, "ids": None}

    def encode(self, texts: list[list[bytes]]) -> np.ndarray:
        """Dictionary places of all tokens, an end after each text; -1 for other words."""
        get = self.dictionary().get
        total = sum(map(len, texts)) + len(texts)
        return np.fromiter((get(w, -1) for t in texts for w in (*t, END)), np.int64, total)

    def places(self, ids: np.ndarray, depth: int) -> list[np.ndarray]:
        """Per depth, for each token the place of the context that ends with it, or -1."""
        out: list[np.ndarray] = []
        for d in range(min(depth, len(self.contexts))):
            before = np.zeros(len(ids), np.int64)
            if d:
                before[0], before[1:] = -1, out[d - 1][:-1]
            at = np.full(len(ids), -1)
            live = np.flatnonzero((before >= 0) & (ids >= 0))
            at[live] = _find(self.contexts[d], before[live] * self.width + ids[live])
            out.append(at)
        return out

    def states(self, ids: np.ndarray) -> np.ndarray:
        """For each token the longest kept state before it, -1 for none."""
        best = np.full(len(ids), -1)
        for d, at in enumerate(self.places(ids, len(self.contexts))):
            seen = np.flatnonzero(at >= 0)
            kept = self.state[self.first[d] + at[seen]]
            best[seen] = np.where(kept >= 0, kept, best[seen])
        out = np.full(len(ids), -1)
        out[1:] = best[:-1]
        return out

    def log_prob(self, state: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural logarithms of the head words ``ids`` after ``state``."""
        out, state = np.zeros(len(ids)), state.copy()
        open_ = np.arange(len(ids))
        while len(open_):
            at_root = state[open_] < 0
            done = open_[at_root]
            out[done] += self.root[ids[done]]
            open_ = open_[~at_root]
            at = _find(self.listed, state[open_] * self.width + ids[open_])
            hit = at >= 0
            out[open_[hit]] += self.logp[at[hit]]
            open_ = open_[~hit]
            out[open_] += self.rest[state[open_]]
            state[open_] = self.parent[state[open_]]
        return out

    def suffixes(self, keys: np.ndarray) -> np.ndarray:
        """Places, one depth less, of the contexts ``keys`` (shorter context, word) without their first words."""
        d = len(self.contexts)
        if d == 0:
            return np.full(len(keys), -1)
        shorter = self.suffix[d - 1][keys // self.width] if d > 1 else np.zeros(len(keys), np.int64)
        return _find(self.contexts[d - 1], shorter * self.width + keys % self.width)

    def grow(
        self, keys: np.ndarray, suffix: np.ndarray, totals: np.ndarray, entries: np.ndarray, counts: np.ndarray
    ) -> None:
        """Add a depth: contexts with sorted ``keys``, their suffixes and totals; listed (context, word) keys and counts."""
        d, n = len(self.contexts), len(keys)
        first = len(self.state)
        above = self.state[self.first[d - 1] + suffix] if d else np.full(n, -1)
        owner, nxt = entries // self.width, entries % self.width
        q = np.exp(self.log_prob(above[owner], nxt))  # as the suffix has it
        listed, q_listed = (np.bincount(owner, x, n) for x in (counts, q))
        left, q_left = totals - listed, np.maximum(1 - q_listed, 1e-12)
        best, weight = np.full(n, -np.inf), np.ones(n)
        for mu in WEIGHTS:
            each = counts * (np.log((counts - 1 + mu * q) / (totals[owner] - 1 + mu)) - np.log(q))
            other = np.log(np.maximum(left - 1, 0) + mu * q_left) - np.log(totals - 1 + mu) - np.log(q_left)
            gain = np.bincount(owner, each, n) + np.where(left > 0, left * other, 0)
            weight = np.where(gain > best, mu, weight)
            best = np.maximum(best, gain)
        keep = best > GAIN
        mass = totals + weight
        p = (counts + weight[owner] * q) / mass[owner]
        rest = np.log((left + weight * q_left) / mass) - np.log(q_left)
        self.contexts.append(keys)
        self.suffix.append(suffix)
        self.first.append(first)
        self.state = np.concatenate([self.state, np.where(keep, first + np.arange(n), above)])
        self.parent = np.concatenate([self.parent, above])
        self.rest = np.concatenate([self.rest, rest])
        up = np.where(above >= 0, self.to_root[above] if first else 0.0, 0.0)
        self.to_root = np.concatenate([self.to_root, rest + up])
        kept = keep[owner]
        all_keys = np.concatenate([self.listed, (first + owner[kept]) * self.width + nxt[kept]])
        order = np.argsort(all_keys)
        self.listed, self.logp = all_keys[order], np.concatenate([self.logp, np.log(p[kept])])[order]


def _sum_rows(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(keys), return_counts=True) if keys else (np.empty(0, np.int64),) * 2


def _texts(column) -> list[list[bytes]]:
    return [words(t.as_py()) for t in column]


def _vocabulary(training: DataFrame) -> DataFrame:
    """word, c of every distinct token of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"]
            )

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                seen.update(words(text.as_py()))
                if len(seen) > FLUSH // 5:
                    yield rows(seen)
                    seen = Counter()
            seen[END] += batch.num_rows
        yield rows(seen)

    return training.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _successors(training: DataFrame, shared, depth: int) -> DataFrame:
    """key (context, dictionary word after it), c over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value

        def rows(keys: list[np.ndarray]) -> pa.RecordBatch:
            key, c = _sum_rows(keys)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(c.astype(np.int64))], names=["key", "c"])

        keys, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids = tree.encode(_texts(batch.column("text")[at : at + 1000]))
                before = tree.places(ids, depth)[depth - 1][:-1]
                live = np.flatnonzero((before >= 0) & (ids[1:] >= 0))
                keys.append(before[live] * tree.width + ids[1:][live])
                held += len(live)
                if held > FLUSH:
                    yield rows(keys)
                    keys, held = [], 0
        yield rows(keys)

    return training.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def fit(
    training: DataFrame,
    depth: int = DEPTH,
    head_share: float = HEAD_SHARE,
    state_share: float = 0.0,
    next_share: float = 0.0,
) -> tuple[Tree, DataFrame]:
    """The tree of the column ``text`` and the table (word, c) of all training tokens.

    The tree is gathered whole, over words of the dictionary, and must fit the driver: ``score_corpus``
    takes the dictionary from here (depth 0) and its states by buckets. Shares leave out contexts and
    next words with less than that share of the training tokens.
    """
    vocabulary = stage_clean(_vocabulary(training), "lm-words")
    row = vocabulary.filter("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, kinds = row.n or 0, row.v
    head = vocabulary.filter((F.col("c") >= max(1, head_share * total)) & (F.length("word") > 0))
    table = head.orderBy(F.col("c").desc(), "word").toArrow()  # at most 1 / head_share rows
    ends = vocabulary.filter(F.length("word") == 0).agg(F.max("c")).first()[0] or 0
    names = [*table.column("word").to_pylist(), END]
    tree = Tree(total, kinds, names, np.append(table.column("c").to_numpy(), ends).astype(np.int64))
    least, least_next = max(LEAST, state_share * total), max(LEAST_NEXT, next_share * total)
    place = np.arange(len(names) - 1)
    keys, totals = place[tree.counts[:-1] >= least], tree.counts[:-1][tree.counts[:-1] >= least]
    for d in range(1, depth + 1):
        if not len(keys):
            break
        # the contexts must be known to the tasks that count what follows them
        probe = Tree(tree.total, tree.kinds, tree.head, tree.counts, [*tree.contexts, keys])
        shared = training.sparkSession.sparkContext.broadcast(probe)
        found = _successors(training, shared, d).filter(F.col("c") >= least_next).toArrow()
        entries, c = found.column("key").to_numpy(), found.column("c").to_numpy()
        order = np.argsort(entries)
        entries, c = entries[order], c[order]
        tree.grow(keys, tree.suffixes(keys), totals.astype(np.float64), entries, c.astype(np.float64))
        longer = (c >= least) & (entries % tree.width != tree.width - 1)
        keys, totals = entries[longer], c[longer]
    return tree, vocabulary


def _number(word: bytes) -> int:
    """Of a word outside the dictionary."""
    return TAIL | int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") >> 2


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > FLUSH // 10:
            self.clear()
        self[word] = number = _number(word)
        return number


def _mix(a, b) -> np.ndarray:
    """63-bit hashes of pairs of integers."""
    x = np.asarray(a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64)
    for factor in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


def _pack(columns: np.ndarray) -> bytes:
    """Rows of integers by their bytes' places, since most high bytes are zero."""
    planes = np.ascontiguousarray(columns.reshape(-1).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, columns: int, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * columns * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).reshape(columns, size)


@dataclass
class Buckets:
    """Where the branches of the tree go."""

    number: int
    words: np.ndarray  # with several buckets, sorted
    parts: np.ndarray  # of each by the word before it
    pairs: np.ndarray  # with several buckets: sorted hashes (word, word before)
    start: np.ndarray  # first part of each after those of its word
    extent: np.ndarray  # parts of each by the word before the pair
    all_parts: np.ndarray  # of each word with those of its pairs

    def of(self, c1: np.ndarray, part) -> np.ndarray:
        return _mix(c1, part) % self.number

    def of_tokens(self, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray) -> np.ndarray:
        """Buckets of the tokens after the words c3 c2 c1."""
        part = np.zeros(len(c1), np.int64)
        at = _find(self.words, c1)
        wide = np.flatnonzero(at >= 0)
        part[wide] = _mix(c2[wide], 1) % self.parts[at[wide]]
        pair = _find(self.pairs, _mix(c1[wide], c2[wide]))
        wide, pair = wide[pair >= 0], pair[pair >= 0]
        part[wide] = self.start[pair] + _mix(c3[wide], 2) % self.extent[pair]
        return self.of(c1, part)

    def of_lists(self, c1: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and buckets, one for each bucket of the word c1 or, where c2 is given, of the pair c2 c1."""
        at, pair = _find(self.words, c1), _find(self.pairs, _mix(c1, c2))
        first, size = np.zeros(len(c1), np.int64), np.ones(len(c1), np.int64)
        size[at >= 0] = self.all_parts[at[at >= 0]]
        long = c2 >= 0
        first[long], size[long] = self.start[pair[long]], self.extent[pair[long]]
        rows = np.repeat(np.arange(len(c1)), size)
        part = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size) + first[rows]
        # parts may share a bucket
        return np.divmod(np.unique(rows * self.number + self.of(c1[rows], part)), self.number)


def _deal(bucket: np.ndarray, columns: np.ndarray, is_list: bool) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], columns[:, order]
    ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket)) if len(bucket) else np.empty(0, np.int64)
    starts = np.append(0, ends[:-1]).astype(np.int64)[: len(ends)]
    packed = [_pack(np.ascontiguousarray(columns[:, a:b])) for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[starts]), pa.array([is_list] * len(ends), pa.bool_()), pa.array(ends - starts)]
        + [pa.array(packed, pa.binary())],
        names=["bucket", "is_list", "size", "packed"],
    )


_DEALT = "bucket long, is_list boolean, size long, packed binary"


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """c1, c2, c3 (-1 before the text), the token itself, 2 * text + in training, of all tokens but first ones."""
    for batch in batches:
        for row, n, texts, tokens in zip(*(batch.column(c).to_pylist() for c in _BLOCK), strict=True):
            sizes, train = _unpack(texts, 2, n)
            ids = _unpack(tokens, 1, int(sizes.sum()))[0]
            place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            owner = np.repeat((row + np.arange(n)) * 2 + train, sizes)
            before = [np.where(place >= d, np.roll(ids, d), -1) for d in range(1, DEPTH + 1)]
            later = place > 0
            yield np.stack([*before, ids, owner])[:, later]


_BLOCK = ("row", "n_tokens", "texts", "tokens")


def _by_bucket(batches: Iterator[pa.RecordBatch], lists: int, tokens: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lists and tokens, of that many columns, of each bucket."""

    def whole(held: dict[bool, list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        none = {True: np.empty((lists, 0), np.int64), False: np.empty((tokens, 0), np.int64)}
        return tuple(np.concatenate([none[x], *held[x]], axis=1) for x in (True, False))

    last, held = None, {True: [], False: []}
    for batch in batches:
        for to, is_list, n, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if to != last and last is not None:
                yield whole(held)
                held = {True: [], False: []}
            last = to
            held[is_list].append(_unpack(packed, lists if is_list else tokens, n))
    if last is not None:
        yield whole(held)


def _count(rows: np.ndarray) -> np.ndarray:
    """Distinct c1, c2, w and the sum of the fourth column, c."""
    key = _mix(_mix(rows[0], rows[1]), rows[2])
    order = np.argsort(key)
    new = np.flatnonzero(np.diff(key[order], prepend=-1))
    c = np.add.reduceat(rows[3][order], new) if len(new) else rows[3]
    return np.stack([*rows[:3, order[new]], c])


def _followers(blocks: DataFrame, number: int, wide: np.ndarray, pairs: bool) -> DataFrame:
    """c1, c2, w, c: words at least LEAST_NEXT times after a context in training.

    The contexts are ``pairs`` of words c2 c1 whose hash is in ``wide``, or single words c1, c2 -1: those
    in ``wide`` with all words after them, others with words outside the dictionary.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(wide)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[np.ndarray]) -> pa.RecordBatch:
            found = _count(np.concatenate([np.empty((4, 0), np.int64), *held], axis=1))
            return _deal(_mix(found[0], found[2]) % number, found, False)

        held, size = [], 0
        for c1, c2, _, w, owner in _read_blocks(batches):
            live = _find(shared.value, _mix(c1, c2) if pairs else c1) >= 0
            live = (live if pairs else live | (w >= TAIL)) & (owner % 2 == 1)
            c2 = c2 if pairs else np.full(len(c1), -1)
            held.append(_count(np.stack([c1, c2, w, np.ones_like(w)])[:, live]))
            size += held[-1].shape[1]
            if size > BLOCK:
                yield rows(held)
                held, size = [], 0
        yield rows(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _by_bucket(batches, 0, 4):
            found = _count(found)
            found = found[:, found[3] >= LEAST_NEXT]
            yield pa.RecordBatch.from_arrays([*map(pa.array, found)], names=["c1", "c2", "w", "c"])

    dealt = blocks.select(*_BLOCK).mapInArrow(deal, _DEALT).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(add, "c1 long, c2 long, w long, c long")


def _runs(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that occur ``least`` times or more, sorted, and how often."""
    keys = np.sort(keys)
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    c = np.diff(np.append(new, len(keys)))
    return keys[new[c >= least]], c[c >= least]


def _branches(dictionary: Tree, lists: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of a bucket's ``tokens`` and what their states add to the natural logarithms of the words' own shares.

    ``lists``: c1, c2, w, c, tokens after the context if it was counted over all buckets, else 0, count of w.
    ``tokens``: rows of ``_read_blocks``.
    """
    l1, l2, lw, lc, l_total, l_count = lists
    c1, c2, c3, w, owner = tokens
    others, at = np.unique(lw[lw >= TAIL], return_index=True)
    counts = np.concatenate([dictionary.counts, l_count[lw >= TAIL][at]])
    tree = Tree(dictionary.total, dictionary.kinds, range(len(counts)), counts)
    width = tree.width

    def local(word: np.ndarray) -> np.ndarray:
        out, other = word.copy(), np.flatnonzero(word >= TAIL)
        place = _find(others, word[other])
        out[other] = np.where(place >= 0, dictionary.width + place, -1)
        return out

    w, lw, train = local(w), local(lw), owner % 2 == 1
    at, state = np.zeros(len(w), np.int64), np.full(len(w), -1)
    list_at = np.zeros(len(lw), np.int64)
    for d, before in enumerate((c1, c2, c3)):
        live = np.flatnonzero((at >= 0) & (before >= 0))
        key = _mix(at[live], before[live])
        # lists counted over all buckets stand for the bucket's own counts
        whole = np.flatnonzero((l_total > 0) & ((l2 < 0) if d == 0 else (l2 >= 0)) & (d < 2))
        whole_key = _mix(list_at[whole], (l1 if d == 0 else l2)[whole])
        wide, first = np.unique(whole_key, return_index=True)
        found, c = _runs(key[train[live]], LEAST)
        own = _find(wide, found) < 0
        keys, totals = np.append(found[own], wide), np.append(c[own], l_total[whole[first]])
        order = np.argsort(keys)
        keys, totals = keys[order], totals[order]
        deeper = np.full(len(at), -1)
        deeper[live] = _find(keys, key)
        live = np.flatnonzero(deeper >= 0)
        suffix, counted = np.full(len(keys), -1), np.ones(len(keys), bool)
        if d:
            suffix[deeper[live]] = at[live]
            suffix[_find(keys, whole_key)] = list_at[whole]
        counted[_find(keys, wide)] = False
        seen = live[train[live] & (w[live] >= 0)]
        if d == 0:  # words outside the dictionary are all in the lists
            seen = seen[w[seen] < dictionary.width]
        seen = seen[counted[deeper[seen]]]
        entries, c = _runs(deeper[seen] * width + w[seen], LEAST_NEXT)
        listed, listed_at = whole, _find(keys, whole_key)
        if d == 0:
            list_at = _find(keys, _mix(list_at, l1))
            listed = np.flatnonzero((l2 < 0) & (list_at >= 0))
            listed_at = list_at[listed]
        entries, c = np.append(entries, listed_at * width + lw[listed]), np.append(c, lc[listed])
        order = np.argsort(entries)
        tree.grow(keys, suffix, totals.astype(np.float64), entries[order], c[order].astype(np.float64))
        at = deeper
        state[live] = tree.state[tree.first[d] + at[live]]
    gain = np.zeros(len(w))
    hit = np.flatnonzero((state >= 0) & (w >= 0))
    gain[hit] = tree.log_prob(state[hit], w[hit]) - tree.root[w[hit]]
    other = np.flatnonzero((state >= 0) & (w < 0))
    gain[other] = tree.to_root[state[other]]
    return _add_up(owner >> 1, gain)


def _add_up(row: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, at = np.unique(row, return_inverse=True)
    return rows, np.bincount(at, gain, len(rows))


def _context_gains(blocks: DataFrame, tree: Tree, vocabulary: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """row, gain: what the contexts in training texts add to the texts' log scores by single words."""
    spark, width = blocks.sparkSession, tree.width

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([_number(w) for w in batch.column("word").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, batch.column("c")], names=["w", "w_count"])

    tail = vocabulary.filter((F.col("c") >= LEAST_NEXT) & (F.length("word") > 0)).mapInArrow(number, "w long, w_count long")
    tokens = blocks.agg(F.sum("n_all")).first()[0] or 0
    share = tokens / max(1, tree.total)  # training and other tokens per training token
    most = 2 * bucket
    n_buckets = max(1, tokens // bucket)
    words = np.flatnonzero(tree.counts[:-1] * share > most)
    singles = _followers(blocks, n_buckets, words, False).join(tail, "w", "left")
    shared_counts = spark.sparkContext.broadcast((tree.counts, words))
    columns = ("c1", "c2", "w", "c", "c_total", "w_count")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words = shared_counts.value
        for batch in batches:
            c1, c2, w, c, n = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("c1", "c2", "w", "c", "w_count"))
            total = np.where(_find(words, c1) >= 0, counts[np.minimum(c1, width - 1)], 0)
            n = np.where(w < width, counts[np.minimum(w, width - 1)], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (c1, c2, w, c, total, n))], names=list(columns))

    schema = ", ".join(f"{c} long" for c in columns)
    singles = stage_clean(singles.mapInArrow(fill, schema), "lm-next")
    places, lists = _place(blocks, tree, singles, words, n_buckets, most / share if share else most)
    shared = spark.sparkContext.broadcast(places)
    dictionary = spark.sparkContext.broadcast(Tree(tree.total, tree.kinds, range(width), tree.counts))

    def deal(turn: int, is_list: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def arrays() -> Iterator[np.ndarray]:
                if not is_list:
                    yield from _read_blocks(batches)
                    return
                for batch in batches:
                    yield np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in columns])

            def rows(held: list[np.ndarray]) -> pa.RecordBatch:
                to, found = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
                return _deal(to, found, is_list)

            held, size = [], 0
            for found in arrays():
                if is_list:
                    at, to = shared.value.of_lists(found[0], found[1])
                    at, to = at[to % ROUNDS == turn], to[to % ROUNDS == turn]
                else:
                    to = shared.value.of_tokens(*found[:DEPTH])
                    at = np.flatnonzero(to % ROUNDS == turn)
                    to = to[at]
                held.append((to, found[:, at]))
                size += len(to)
                if size > BLOCK:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)

        source = lists.select(*columns) if is_list else blocks.select(*_BLOCK)
        return source.mapInArrow(run, _DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            row, gain = _add_up(*(np.concatenate(x) for x in zip(*found, strict=True)))
            return _deal(row >> 11, np.stack([row, gain.view(np.int64)]), False)

        out, size = [], 0
        for lists, tokens in _by_bucket(batches, len(columns), DEPTH + 2):
            out.append(_branches(dictionary.value, lists, tokens))
            size += len(out[-1][0])
            if size > FLUSH:
                yield rows(out)
                out, size = [], 0
        if out:
            yield rows(out)

    def add_up(part: pa.Table) -> pa.Table:
        packed = zip(part.column("packed").to_pylist(), part.column("size").to_pylist(), strict=True)
        row, gain = np.concatenate([_unpack(x, 2, n) for x, n in packed], axis=1)
        return pa.table(dict(zip(("row", "gain"), _add_up(row, gain.view(np.float64)), strict=True)))

    gains = None
    for turn in range(ROUNDS):
        dealt = deal(turn, True).union(deal(turn, False)).repartition("bucket").sortWithinPartitions("bucket")
        found = stage_clean(dealt.mapInArrow(run, _DEALT), "lm-gains")
        gains = found if gains is None else gains.union(found)
    # one bucket here is 2,048 texts
    return gains.groupBy("bucket").applyInArrow(add_up, "row long, gain double")


def _place(
    blocks: DataFrame, tree: Tree, singles: DataFrame, words: np.ndarray, number: int, most: float
) -> tuple[Buckets, DataFrame]:
    """The buckets and the lists of words and of pairs of words with more than ``most`` training tokens."""
    # a pair this frequent has frequent words, and there are no more than total / most; w is a context's last word
    wide = singles.filter((F.col("c") > most) & (F.col("w") < tree.width - 1)).select("w", "c1", "c").toArrow()
    c1, c2, c = (wide.column(x).to_numpy() for x in ("w", "c1", "c"))
    hashes = _mix(c1, c2)
    order = np.argsort(hashes)
    c1, c2, c, hashes = (x[order] for x in (c1, c2, c, hashes))
    parts, extent = ((2 * x / most).astype(np.int64) + 1 for x in (tree.counts[words], c))
    start, all_parts = np.zeros(len(c1), np.int64), parts.copy()
    for i, at in enumerate(_find(words, c1)):
        start[i], all_parts[at] = all_parts[at], all_parts[at] + extent[i]
    places = Buckets(number, words, parts, hashes, start, extent, all_parts)
    if not len(c1):
        return places, singles
    totals = blocks.sparkSession.createDataFrame(
        [tuple(map(int, x)) for x in zip(c1, c2, c, strict=True)], "c1 long, c2 long, c_total long"
    )
    after = _followers(blocks, number, hashes, True).join(F.broadcast(totals), ["c1", "c2"])
    # what follows the pair twice follows its last word twice
    after = after.join(singles.select("c1", "w", "w_count"), ["c1", "w"])
    return places, singles.unionByName(after)


def score_texts(
    docs: DataFrame,
    tree: Tree,
    vocabulary: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    training: Column | None = None,
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row.

    NULL and empty texts are one end token. base_score is the add-one score of single
    tokens, score the tree's, both log10. Without training texts every probability is 1.
    Repeated rows are rows of their own; other columns are not read.
    Given ``training``, which rows the dictionary was learnt from, ``tree`` is of depth 0 and all
    contexts in those rows are met by buckets.
    """
    learn = training is not None
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (training if learn else F.lit(False)).alias("train")
    )
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"row long, doc_id {id_type}, n_tokens long, seen long, base double, best double, word binary, times long, "
        "texts binary, tokens binary, n_all long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        number = TaskContext.get().partitionId() << 33
        others = _Numbers()
        for batch in batches:
            types = {**_TYPES, "doc_id": batch.column("doc_id").type}

            def record(size: int, **columns) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in types.items()],  # noqa: B023
                    names=list(types),  # noqa: B023
                )

            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = _texts(part.column("text"))
                ids = tree.encode(texts)
                sizes = np.array([len(t) + 1 for t in texts], np.int64)
                firsts = np.cumsum(sizes) - sizes
                state = tree.states(ids)
                known = ids >= 0
                base, best = np.zeros(len(ids)), np.zeros(len(ids))
                base[known] = tree.root[ids[known]]
                best[known] = tree.log_prob(state[known], ids[known])
                deep = np.flatnonzero(~known & (state >= 0))
                best[deep] = tree.to_root[state[deep]]
                seen = np.zeros(len(ids), np.int64)
                seen[known] = tree.counts[ids[known]] > 0
                names = np.arange(number, number + len(texts))
                number += len(texts)
                sums = [np.add.reduceat(x, firsts) for x in (seen, base, best)]
                sums = dict(zip(("seen", "base", "best"), sums, strict=True))
                yield record(len(texts), row=names, doc_id=part.column("doc_id"), n_tokens=sizes, **sums)
                owners, tail, times, all_tail = [], [], [], []
                for name, first, text in zip(names, firsts, texts, strict=True):
                    found = [text[i] for i in np.flatnonzero(~known[first : first + len(text)])]
                    other = Counter(found)
                    owners += [name] * len(other)
                    tail += other.keys()
                    times += other.values()
                    all_tail += found
                yield record(len(tail), row=owners, word=tail, times=times)
                if learn:
                    ids[~known] = [others[w] for w in all_tail]
                    train = part.column("train").to_numpy(zero_copy_only=False).astype(np.int64)
                    block = {"texts": [_pack(np.stack([sizes, train]))], "tokens": [_pack(ids)]}
                    yield record(1, row=names[:1], n_tokens=[len(texts)], n_all=[len(ids)], **block)

    both = stage(rows.mapInArrow(run, schema), "lm-scored")
    # words outside the dictionary get their counts from the table
    tail = both.filter("word is not null").select("row", "word", "times").join(vocabulary, "word", "left")
    c = F.coalesce("c", F.lit(0))
    log_p = F.log((c + 1) / F.lit(float(tree.total + tree.kinds + 1)))
    tail = tail.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("tail_seen"), F.sum(F.col("times") * log_p).alias("tail")
    )
    whole = both.filter("seen is not null").select("row", "doc_id", "n_tokens", "seen", "base", "best")
    whole = whole.join(tail, "row", "left")
    if learn:
        whole = whole.join(_context_gains(both.filter("n_all is not null"), tree, vocabulary), "row", "left")
        whole = whole.withColumn("best", F.col("best") + F.coalesce("gain", F.lit(0.0)))
    extra = F.coalesce("tail", F.lit(0.0))
    return whole.select(
        "doc_id",
        "n_tokens",
        (F.col("seen") + F.coalesce("tail_seen", F.lit(0))).alias("n_known"),
        F.lit(int(tree.total)).cast("long").alias("train_tokens"),
        ((F.col("base") + extra) / float(np.log(10))).alias("base_score"),
        ((F.col("best") + extra) / float(np.log(10))).alias("score"),
    )


_TYPES = {
    "row": pa.int64(),
    "doc_id": None,
    "n_tokens": pa.int64(),
    "seen": pa.int64(),
    "base": pa.float64(),
    "best": pa.float64(),
    "word": pa.binary(),
    "times": pa.int64(),
    "texts": pa.binary(),
    "tokens": pa.binary(),
    "n_all": pa.int64(),
}


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows by the tree of those that aren't held out."""
    held = is_held_out(F.col(id_col))
    tree, vocabulary = fit(docs.filter(~held).select(F.col(text_col).alias("text")), depth=0)
    scored = score_texts(docs, tree, vocabulary, id_col, text_col, ~held)
    return scored.withColumn("held_out", is_held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
