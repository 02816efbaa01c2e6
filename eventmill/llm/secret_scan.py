"""Secret scans: patterns, and a character convolutional network over every candidate.

One pass over the texts finds the spans of three patterns and every candidate: a run of
token characters with a digit, cut into tiles with the characters around them. Candidates
inside pattern spans are labelled findings, all others labelled negatives. A bounded
sample of both trains the network. It then scores every candidate over all its tiles; the
histogram of these scores over the whole table calibrates them and sets the threshold: the
highest that keeps the demanded share of all findings. Candidates above it that no pattern
found are added; pattern spans always stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventmill.llm.sampling import sample_rows
from eventmill.session import stage

# The pattern kinds in the order of the report, their least lengths.
KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_DIGIT = re.compile(r"[0-9]")

BEFORE, TILE, AFTER, STEP = 24, 48, 8, 24
WIDTH = BEFORE + TILE + AFTER
SAMPLE = 2000  # labelled rows of each class that training may take
RECALL = 0.99
BINS, FAR = 256, 64.0  # bins of a unit of the network's output, and where they end
CLASSES = 98
_TILE = pa.list_(pa.binary())
_FOUND = "base array<struct<kind:string,start:long,end:long>>, candidates array<struct<start:long,end:long,label:int,tiles:array<binary>>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern spans in code points, by start and then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if any(len(w) >= 32 for w in text.split()):
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidate_spans(text: str) -> list[tuple[int, int]]:
    """Runs of 12 token characters or more with a digit among them."""
    if not any(len(w) >= 12 for w in text.split()):
        return []
    return [m.span() for m in _RUN.finditer(text) if _DIGIT.search(m[0])]


def tiles(text: str, start: int, end: int) -> list[bytes]:
    """Character classes of overlapping tiles that cover the whole candidate, with context.

    A class is 1..95 for printable ASCII, 96 for white space, 97 for others, 0 beyond the
    text; 128 is added inside the candidate.
    """
    out = []
    for at in range(start, max(start + 1, end - (TILE - STEP)), STEP):
        codes = bytearray(WIDTH)
        for k, i in enumerate(range(at - BEFORE, at + TILE + AFTER)):
            if 0 <= i < len(text):
                c = ord(text[i])
                kind = c - 31 if 32 <= c < 127 else 96 if text[i].isspace() else 97
                codes[k] = kind + (128 if start <= i < end else 0)
        out.append(bytes(codes))
    return out


@dataclass
class Network:
    """Embedding, one convolution, largest response of each filter, logistic output."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    cut: float = 0.0  # the threshold as an output of the network

    def _windows(self, codes: np.ndarray) -> np.ndarray:
        inside = (codes >= 128).astype(np.float32)[..., None]
        x = np.concatenate([self.weights["embed"][codes & 127], inside], axis=2)
        k = self.weights["conv"].shape[0] // x.shape[2]
        return np.concatenate([x[:, i : x.shape[1] - k + 1 + i] for i in range(k)], axis=2)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        h = np.maximum(self._windows(codes) @ self.weights["conv"] + self.weights["bias"], 0).max(1)
        return h @ self.weights["out"] + self.weights["out_bias"]

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return self.calibrated(self.logits(codes))

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * logits + self.shift)))

    def best(self, candidates: list[list[bytes]]) -> np.ndarray:
        """Largest output over all tiles of each candidate."""
        if not candidates:
            return np.empty(0)
        ends = np.cumsum([len(c) for c in candidates])
        flat = np.frombuffer(b"".join(t for c in candidates for t in c), np.uint8).reshape(-1, WIDTH)
        out = np.concatenate([self.logits(flat[k : k + 2000]) for k in range(0, len(flat), 2000)]).astype(np.float64)
        return np.maximum.reduceat(out, np.concatenate([[0], ends[:-1]]))

    def settle(self, logit: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> None:
        """Platt scaling and threshold from ``n`` candidates of each output and label.

        Newton steps with a weak pull to the identity; the cut is the largest of the outputs
        that leaves at most ``1 - recall`` of the findings below it.
        """
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * logit + b)))
            g = np.array([(n * (p - y) * logit).sum() + 0.1 * (a - 1), (n * (p - y)).sum() + 0.1 * b])
            s = n * p * (1 - p)
            hess = np.array([[(s * logit**2).sum() + 0.1, (s * logit).sum()], [(s * logit).sum(), s.sum() + 0.1]])
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, g), -1, 1)
        self.scale, self.shift = float(max(a, 1e-3)), float(b)
        order = np.argsort(logit[y == 1], kind="stable")
        found, of = logit[y == 1][order], n[y == 1][order]
        below = np.cumsum(of) - of
        self.cut = float(found[below <= np.floor((1 - recall) * of.sum())].max())
        self.threshold = float(self.calibrated(np.float64(self.cut)))


def _gradients(net: Network, codes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    w = net.weights
    windows = net._windows(codes)
    z = windows @ w["conv"] + w["bias"]
    at = z.argmax(1)
    rows, cols = np.arange(len(y))[:, None], np.arange(z.shape[2])[None]
    top = z[rows, at, cols]
    h = np.maximum(top, 0)
    d = (1 / (1 + np.exp(-(h @ w["out"] + w["out_bias"]))) - y) / len(y)
    dh = d[:, None] * w["out"] * (top > 0)
    picked = windows[rows, at]  # row, filter, inputs
    grads = {
        "out": h.T @ d,
        "out_bias": np.array([d.sum()]),
        "bias": dh.sum(0),
        "conv": np.einsum("rf,rfi->if", dh, picked),
        "embed": np.zeros_like(w["embed"]),
    }
    dim = w["embed"].shape[1]
    back = np.einsum("rf,if->rfi", dh, w["conv"]).reshape(len(y), z.shape[2], -1, dim + 1)[..., :dim]
    place = at[:, :, None] + np.arange(back.shape[2])
    np.add.at(grads["embed"], codes[rows[:, :, None], place] & 127, back)
    return grads


def train(
    codes: np.ndarray, labels: np.ndarray, recall: float = RECALL, steps: int = 240, batch: int = 96, seed: int = 7
) -> Network:
    """Fit on three quarters of the tiles, calibrate and choose the threshold on the rest."""
    rng = np.random.default_rng(seed)
    dim, span, filters = 8, 5, 16
    net = Network(
        {
            "embed": rng.normal(0, 0.3, (CLASSES, dim)).astype(np.float32),
            "conv": rng.normal(0, 0.2, (span * (dim + 1), filters)).astype(np.float32),
            "bias": np.zeros(filters, np.float32),
            "out": rng.normal(0, 0.3, filters).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }
    )
    order = rng.permutation(len(labels))
    held, fit = order[: max(1, len(order) // 4)], order[max(1, len(order) // 4) :]
    fit = fit if len(set(labels[fit])) == 2 else order
    held = held if len(set(labels[held])) == 2 else order
    classes = [fit[labels[fit] == k] for k in (0, 1)]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    for t in range(1, steps + 1):
        pick = np.concatenate([rng.choice(c, batch // 2) for c in classes])
        for k, g in _gradients(net, codes[pick], labels[pick].astype(np.float32)).items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            net.weights[k] -= (0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    logit, y = net.logits(codes[held]).astype(np.float64), labels[held].astype(np.float64)
    net.settle(logit, y, np.ones(len(y)), recall)
    return net


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, candidates = [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text) if text else []
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                found = []
                for s, e in candidate_spans(text) if text else []:
                    label = int(any(a < e and s < b for _, a, b in spans))
                    found.append({"start": s, "end": e, "label": label, "tiles": tiles(text, s, e)})
                candidates.append(found)
            span = [("start", pa.int64()), ("end", pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(base, pa.list_(pa.struct([("kind", pa.string()), *span]))),
                    pa.array(candidates, pa.list_(pa.struct([*span, ("label", pa.int32()), ("tiles", _TILE)]))),
                ],
                names=["doc_id", "base", "candidates"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, {_FOUND}")


def labelled_tiles(scanned: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """At most ``sample`` candidates of each label, chosen by hash: codes of one tile each, and labels."""
    each = scanned.select("doc_id", F.explode("candidates").alias("c")).select(
        "c.label",
        F.element_at("c.tiles", 1).alias("tile"),
        F.xxhash64("doc_id", "c.start").alias("h"),
    )
    rows = [r for k in (0, 1) for r in sample_rows(each.filter(F.col("label") == k), F.col("h"), sample)]
    codes = np.frombuffer(b"".join(bytes(r.tile) for r in rows), np.uint8).reshape(-1, WIDTH)
    return codes, np.array([r.label for r in rows], np.int64)


def settle_over_all(scanned: DataFrame, net: Network, recall: float = RECALL) -> None:
    """Calibrate ``net`` and set its threshold by all candidates of the table, each over all its tiles."""
    shared = scanned.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        seen: Counter = Counter()
        for batch in batches:
            each = [c for found in batch.column("candidates").to_pylist() for c in found]
            for at in range(0, len(each), 500):
                part = each[at : at + 500]
                bins = np.floor(np.clip(net.best([c["tiles"] for c in part]), -FAR, FAR) * BINS).astype(np.int64)
                seen.update(zip([c["label"] for c in part], bins.tolist(), strict=True))
        label, at = [k[0] for k in seen], [k[1] for k in seen]
        columns = [pa.array(label, pa.int32()), pa.array(at, pa.int64()), pa.array(list(seen.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["label", "bin", "n"])

    bins = scanned.select("candidates").mapInArrow(run, "label int, bin long, n long")
    rows = sorted(bins.groupBy("label", "bin").agg(F.sum("n").alias("n")).collect())  # at most 4 * BINS * FAR rows
    y, at, n = (np.array([r[i] for r in rows], np.float64) for i in range(3))
    net.settle(at / BINS, y, n, recall)


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, recall: float = RECALL
) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end, score>>, by start and then kind.

    Code points, end exclusive; score is NULL for pattern spans. NULL and empty texts have
    no spans. Without findings or without other candidates there is nothing to learn from
    and the pattern spans are the result. Repeated rows are rows of their own; other
    columns are not read.
    """
    scanned = stage(_scan(docs, id_col, text_col), "secrets")
    codes, labels = labelled_tiles(scanned, sample)
    net = train(codes, labels, recall) if len(set(labels)) == 2 else None
    if net:
        settle_over_all(scanned, net, recall)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = scanned.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            base, candidates = batch.column("base").to_pylist(), batch.column("candidates").to_pylist()
            out = [[{**s, "score": None} for s in spans] for spans in base]
            new = [(i, c) for i, found in enumerate(candidates) for c in found if not c["label"]] if net else []
            for at in range(0, len(new), 500):
                part = new[at : at + 500]
                best = net.best([c["tiles"] for _, c in part])
                scores = net.calibrated(best)
                for (i, c), logit, score in zip(part, best.tolist(), scores.tolist(), strict=True):
                    if logit >= net.cut:
                        out[i].append({"kind": "model", "start": c["start"], "end": c["end"], "score": score})
            spans = [sorted(x, key=lambda s: (s["start"], KINDS.index(s["kind"]))) for x in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(spans, pa.list_(span))], names=["doc_id", "spans"]
            )

    schema = f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,score:double>>"
    return scanned.select("doc_id", "base", "candidates").mapInArrow(run, schema)


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts of the pattern kinds, base_sha256 and all spans as one string."""

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["kind"] != "model")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

