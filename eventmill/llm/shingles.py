"""Word tokens and hashed word shingles of texts.

Words are hashed for many texts at once: a running sum of bytes times powers of an odd
number gives the polynomial of every word as a difference, brought to the word's own
start by the inverse power.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20  # bytes hashed at a time
_BASE = 0x9E3779B97F4A7C15
_MULTIPLY = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(29)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than blank and 09-0D, A-Z in lower case."""
    return _lower(text).split()


def _lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _tables(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < size:
        for k, factor in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, np.uint64(factor))
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MULTIPLY
    return h ^ (h >> np.uint64(32))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of lower-case bytes."""
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _tables(max(CHUNK, len(data)) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return starts, _mix((total[ends] - total[starts]) * inverse[starts])


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of about CHUNK bytes that end before white space."""
    at = 0
    while len(data) - at > CHUNK:
        end = at + CHUNK
        while end < len(data) and not _IS_SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """64-bit hashes of the words of each text, in order."""
    group: list[bytes] = []
    held = 0

    def flush() -> Iterator[np.ndarray]:
        if not group:
            return
        sizes = np.array([len(g) + 1 for g in group])
        starts, h = _word_hashes(np.frombuffer(b"\n".join(group) + b"\n", np.uint8))
        cuts = np.searchsorted(starts, np.cumsum(sizes)[:-1])
        yield from np.split(h, cuts)
        group.clear()

    for text in texts:
        data = _lower(text)
        if held + len(data) > CHUNK:
            yield from flush()
            held = 0
        if len(data) > CHUNK:
            yield np.concatenate([_word_hashes(np.frombuffer(p, np.uint8))[1] for p in _pieces(data)])
        else:
            group.append(data)
            held += len(data) + 1
    yield from flush()


def shingle_sets(texts: list[str | None], size: int = 5) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct shingles; of a shorter text, its whole word sequence; of none, empty."""
    for h in word_hashes(texts):
        if not len(h):
            yield h
            continue
        width = min(size, len(h))
        n = len(h) - width + 1
        out = np.full(n, np.uint64(width))
        for k in range(width):
            out = (out ^ (out >> _SHIFT)) * _MULTIPLY + h[k : n + k]
        yield np.unique(_mix(out))


def set_key(shingles: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
