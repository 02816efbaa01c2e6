"""Alignment of two tokenizers' tokens over the same text, by coalescing byte intervals.

All tokens of both sides are sorted by start (one lexsort over many texts, each at its own
offset); the running maximum of their ends tells where a group is over: at a start that has
reached it. Inside a group every pair of tokens that overlap is expanded. Pairs that end at
the same byte are links; how often two ids are linked in the whole corpus tells which id of
one vocabulary stands best for one of the other.

Of two linked tokens one's bytes end with the other's, so only pairs of a suffix relation
can occur. They are listed from the vocabularies alone, some hundred thousand whatever the
corpus, and that is what the counts sent to the driver and back are bounded by.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventmill.llm.worker_cache import kept
from eventmill.session import stage

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Bytes of text that are tokenised and aligned at a time; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin-1 stands for itself, the
    other bytes are numbered from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Fixed value: how a byte-level BPE of this family cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FAR = re.compile("[^\x00-\u024f]")  # beyond the Latin blocks engines may disagree on classes
_LONG = re.compile(r"\S{2000}|\s{2000}")


def byte_level(path: str) -> tuple[list[bytes], Callable[[list[str]], list[list[int]]]]:
    """Bytes of every id of a byte-level BPE, and its encoder; special tokens' strings are plain text.

    Where the ids of the file are in the order of its merges, Latin texts go through an engine
    that merges by rank and is several times as fast; tests hold its ids against the other's.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    alphabet = byte_alphabet()
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    decoded = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in names]
    by_rank = ranked(path, alphabet)

    def encode(texts: list[str]) -> list[list[int]]:
        quick = [by_rank is not None and not _FAR.search(t) and not _LONG.search(t) for t in texts]
        rest = iter(tokenizer.encode_batch_fast([t for t, q in zip(texts, quick, strict=True) if not q], add_special_tokens=False))
        return [by_rank.encode_ordinary(t) if q else next(rest).ids for t, q in zip(texts, quick, strict=True)]

    return decoded, encode


def ranked(path: str, alphabet: dict[str, int]):
    """The file's merges as ranks, or None if it is another kind of tokenizer."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, cut = file["model"], file.get("pre_tokenizer") or {}
    if file.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    if model.get("type") != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    single = sorted(i for t, i in model["vocab"].items() if len(t) == 1)
    if single != list(range(256)) or [model["vocab"].get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))):
        return None
    ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merges)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(path: str) -> tuple[list[bytes], Callable[[list[str]], list[list[int]]]]:
    """Bytes of every id of a piece model, and its encoder, which adds a space in front."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)

    def decoded(i: int) -> bytes:
        name = model.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace(BLANK, " ").encode()

    return [decoded(i) for i in range(model.get_piece_size())], lambda texts: model.encode(texts, num_threads=1)


@dataclass
class Vocabularies:
    a: list[bytes]
    b: list[bytes]
    encode_a: Callable[[list[str]], list[list[int]]]
    encode_b: Callable[[list[str]], list[list[int]]]

    def __post_init__(self):
        self.len_a, self.len_b = (np.array([len(t) for t in side], np.int64) for side in (self.a, self.b))
        self.pairs = linkable(self.a, self.b)
        self.names = [np.array([str(i).encode() + end for i in range(len(s))], object) for s in (self.a, self.b) for end in (b",", b"|", b";", b"")]


def load(a: str, b: str) -> Vocabularies:
    """Read once by each Python worker."""

    def build() -> Vocabularies:
        (bytes_a, encode_a), (bytes_b, encode_b) = byte_level(a), pieces(b)
        return Vocabularies(bytes_a, bytes_b, encode_a, encode_b)

    return kept(f"alignment {a} {b}", build)


def linkable(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted codes (id of a) * len(b) + (id of b) of all pairs of which one ends with the other."""

    def under(short: list[bytes], long: list[bytes]) -> Iterator[tuple[int, int]]:
        ids: dict[bytes, list[int]] = {}
        for i, t in enumerate(short):
            if t:
                ids.setdefault(t, []).append(i)
        for j, t in enumerate(long):
            for k in range(len(t)):
                for i in ids.get(t[k:], ()):
                    yield i, j

    codes = {i * len(b) + j for j, i in under(b, a)} | {i * len(b) + j for i, j in under(a, b)}
    return np.array(sorted(codes), np.int64)


def coalesce(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by start of the intervals, and the group of each in that order: a group is over where
    a start reaches the largest end so far."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= reach[:-1]
    return order, np.cumsum(breaks) - 1


def overlaps(start_a, end_a, start_b, end_b) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of overlapping intervals; each side is sorted and free of overlaps."""
    first = np.searchsorted(end_b, start_a, "right")
    count = np.searchsorted(start_b, end_a, "left") - first
    i = np.repeat(np.arange(len(start_a)), count)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


@dataclass
class Aligned:
    """Tokens of many texts: ids and their text per side, groups in text order, overlaps and links."""

    ids: tuple[np.ndarray, np.ndarray]
    text: tuple[np.ndarray, np.ndarray]
    order: np.ndarray  # of all tokens, those of a first, by start
    group: np.ndarray  # of the tokens in that order
    overlap: tuple[np.ndarray, np.ndarray]
    link: tuple[np.ndarray, np.ndarray]


def align(ids_a: list[list[int]], ids_b: list[list[int]], v: Vocabularies) -> Aligned:
    """Tokens of texts whose joined bytes are the same on both sides."""
    ids, text, start, end = [], [], [], []
    for side, lengths in ((ids_a, v.len_a), (ids_b, v.len_b)):
        flat = np.concatenate([np.asarray(x, np.int64) for x in side]) if side else np.zeros(0, np.int64)
        ids.append(flat)
        text.append(np.repeat(np.arange(len(side)), [len(x) for x in side]))
        end.append(np.cumsum(lengths[flat]))
        start.append(end[-1] - lengths[flat])
    order, group = coalesce(np.concatenate(start), np.concatenate(end))
    i, j = overlaps(start[0], end[0], start[1], end[1])
    same = end[0][i] == end[1][j]
    return Aligned(tuple(ids), tuple(text), order, group, (i, j), (i[same], j[same]))


def group_strings(x: Aligned, n: int, v: Vocabularies) -> list[bytes]:
    """``a1,a2|b1;a3|b2`` of each of ``n`` texts: ids in text order by group, a's before b's."""
    n_a = len(x.ids[0])
    side = (x.order >= n_a).astype(np.int64)
    again = np.lexsort((x.order, side, x.group))  # tokens of a side stand in text order
    token, side, group = x.order[again], side[again], x.group[again]
    ids, text = np.concatenate(x.ids)[token], np.concatenate(x.text)[token]
    ends = np.full(len(token), 3)
    ends[:-1] = np.where(text[1:] != text[:-1], 3, np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0)))
    parts = np.empty(len(token), object)
    for which in range(8):
        at = np.flatnonzero(side * 4 + ends == which)
        parts[at] = v.names[which][ids[at]]
    cut = np.searchsorted(text, np.arange(n + 1))
    return [b"".join(parts[cut[k] : cut[k + 1]].tolist()) for k in range(n)]


def pieces_of(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``PIECE_BYTES``."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= PIECE_BYTES:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def tokenise(texts: list[str | None], v: Vocabularies) -> tuple[list[list[int]], list[list[int]]]:
    """Ids on both sides; none for NULL and empty texts and where a side doesn't give the text back."""
    there = [k for k, t in enumerate(texts) if t]
    a, b = [[] for _ in texts], [[] for _ in texts]
    ids_a = v.encode_a([" " + texts[k] for k in there])
    ids_b = v.encode_b([texts[k] for k in there])
    for k, x, y in zip(there, ids_a, ids_b, strict=True):
        whole = (" " + texts[k]).encode()
        if b"".join([v.a[i] for i in x]) == whole == b"".join([v.b[i] for i in y]):
            a[k], b[k] = x, y
    return a, b


def align_texts(
    docs: DataFrame,
    keep: list[str] | None = None,
    text_col: str = "text",
    a: str = TOKENIZER_A,
    b: str = TOKENIZER_B,
) -> DataFrame:
    """Columns ``keep`` (doc_id) of each row and its alignment: ``groups``, an array of structs
    (a, b) of ids, and ``overlaps``, an array of structs (a, b) of positions of tokens that
    share a byte. NULL and empty texts, and those that a side can't give back, have none."""
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    held = [f"_k{i}" for i in range(len(keep))]
    fields = "groups array<struct<a: array<int>, b: array<int>>>, overlaps array<struct<a: int, b: int>>"
    schema = ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in held], fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(a, b)
        for batch in batches:
            every = batch.column("_text").to_pylist()
            for lo, hi in pieces_of(every):
                tokens = tokenise(every[lo:hi], v)
                groups, pairs = [], []
                for x, y in zip(*tokens, strict=True):
                    one = align([x], [y], v)
                    found: list[dict] = [{"a": [], "b": []} for _ in range(int(one.group[-1]) + 1 if len(one.group) else 0)]
                    for t, g in zip(one.order.tolist(), one.group.tolist(), strict=True):
                        found[g]["a" if t < len(x) else "b"].append(x[t] if t < len(x) else y[t - len(x)])
                    groups.append(found)
                    pairs.append([{"a": i, "b": j} for i, j in zip(*map(np.ndarray.tolist, one.overlap), strict=True)])
                kinds = [pa.list_(pa.struct([(s, pa.list_(pa.int32())) for s in "ab"])), pa.list_(pa.struct([(s, pa.int32()) for s in "ab"]))]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in held], pa.array(groups, kinds[0]), pa.array(pairs, kinds[1])],
                    names=[*held, "groups", "overlaps"],
                )

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(h).alias(c) for h, c in zip(held, keep, strict=True)], "groups", "overlaps")


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.astype(np.int32)))


def linked_texts(docs: DataFrame, text_col: str = "text", a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the links as ``pair`` (numbers of
    linkable pairs, each once) and ``n`` (how often)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<int>, n array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(a, b)
        for batch in batches:
            every = batch.column("_text").to_pylist()
            for lo, hi in pieces_of(every):
                size = hi - lo
                x = align(*tokenise(every[lo:hi], v), v)
                n_a, n_b = (np.bincount(t, minlength=size) for t in x.text)
                owner = np.concatenate(x.text)[x.order]
                new = np.ones(len(x.group), bool)
                new[1:] = x.group[1:] != x.group[:-1]
                n_groups = np.bincount(owner[new], minlength=size)
                code = x.ids[0][x.link[0]] * len(v.b) + x.ids[1][x.link[1]]
                pair = np.searchsorted(v.pairs, code)
                of = x.text[0][x.link[0]]
                n_links = np.bincount(of, minlength=size)
                once, n = np.unique(of * len(v.pairs) + pair, return_counts=True)
                ends = np.cumsum(np.bincount(once // len(v.pairs), minlength=size)) if len(once) else np.zeros(size, np.int64)
                digests = [hashlib.sha256(s).hexdigest() if s else "" for s in group_strings(x, size, v)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, size)]
                    + [pa.array(c.astype(np.int64)) for c in (n_a, n_b, n_groups, n_links)]
                    + [pa.array(digests, pa.string()), _lists(ends, once % len(v.pairs)), _lists(ends, n)],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "n"],
                )

    return rows.mapInArrow(run, schema)


def pair_counts(links: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """pair, n: how often each linkable pair is linked in the corpus. A task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(load(a, b).pairs), np.int64)
        for batch in batches:
            np.add.at(total, batch.column("pair").flatten().to_numpy(), batch.column("n").flatten().to_numpy())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["pair", "n"])

    return links.select("pair", "n").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def cross_alignment(docs: DataFrame, text_col: str = "text", a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """One row per document: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose
    count in the corpus is the highest of their b id, ties included), count_sum (of the links'
    counts) and groups_sha256.

    NULL and empty texts, and texts that a tokenizer doesn't give back byte by byte, have zeros
    and an empty digest. Repeated rows are rows of their own and count so; other columns
    aren't read. Texts are tokenised once, their links are staged. Tokenizers are read from
    their files by each Python worker.
    """
    spark = docs.sparkSession
    links = stage(linked_texts(docs, text_col, a, b), "links")
    v = load(a, b)
    found = pair_counts(links, a, b).toPandas()  # no more rows than linkable pairs
    counts = np.zeros(len(v.pairs), np.int64)
    counts[found["pair"].to_numpy()] = found["n"].to_numpy()
    most = np.zeros(len(v.b), np.int64)
    np.maximum.at(most, v.pairs % len(v.b), counts)
    shared = spark.sparkContext.broadcast((counts, counts == most[v.pairs % len(v.b)]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = shared.value
        for batch in batches:
            pairs, size = batch.column("pair"), batch.num_rows
            row = np.repeat(np.arange(size), pairs.value_lengths().to_numpy())
            pair, n = pairs.flatten().to_numpy(), batch.column("n").flatten().to_numpy().astype(np.int64)
            n_best, count_sum = np.zeros(size, np.int64), np.zeros(size, np.int64)
            np.add.at(n_best, row, np.where(best[pair], n, 0))
            np.add.at(count_sum, row, n * count[pair])
            made = {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names=names)

    kinds = [f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names]
    return links.mapInArrow(run, ", ".join(kinds))
