"""Benchmark decontamination with one Aho-Corasick automaton over the items' word windows.

A text becomes its words, lower case, between single blanks; so does every window of ten
item words. One pass of the automaton finds all windows with their places, overlapping
ones too, and words found are mapped back to code points of the original text. The
windows are broadcast; items beyond ``block_bytes`` of text go to further automata, each
of which adds to what the rows already carry, so no row is shuffled or joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
BLOCK_BYTES = 32 << 20
# The bytes of words, after lower-casing; all others become blanks.
_KEEP = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
RESULT = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_RESULT = pa.schema(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))]
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_KEEP).split()


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Each window of ``size`` words between blanks; of a shorter text, all of it; of none, none."""
    w = words(text)
    return [b" " + b" ".join(w[i : i + size]) + b" " for i in range(max(1, len(w) - size + 1))] if w else []


def automaton(items: list[tuple[str | None, str | None]], size: int = WINDOW):
    """Automaton whose values are (characters, words, item ids) of a window; None without windows."""
    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for window in windows(text, size):
            owners.setdefault(window, set()).update([item] if item is not None else [])
    if not owners:
        return None
    found = ahocorasick.Automaton()
    for window, ids in owners.items():
        found.add_word(window.decode("latin-1"), (len(window), window.count(b" ") - 1, tuple(ids)))
    found.make_automaton()
    return found


def scan(text: str | None, found) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, positions of the words inside any window, items found."""
    w = words(text)
    if not w or found is None:
        return len(w), np.empty(0, np.int64), set()
    line = b" " + b" ".join(w) + b" "
    hits = [(end, value) for end, value in found.iter(line.decode("latin-1"))]
    if not hits:
        return len(w), np.empty(0, np.int64), set()
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    first = np.searchsorted(blanks, [end - v[0] + 1 for end, v in hits])
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + [v[1] for _, v in hits], -1)
    return len(w), np.flatnonzero(np.cumsum(edge[:-1]) > 0), {i for _, v in hits for i in v[2]}


def original_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code points of the original text that runs of hit words cover, end exclusive."""
    places = [m.span() for m in _WORD.finditer(text)]
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1) if len(hit) else []
    return [(places[r[0]][0], places[r[-1]][1]) for r in runs]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size; the driver holds one block at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    block, held = [], 0
    for row in items.toLocalIterator():
        if block and held + len(row.t) > block_bytes:
            yield block
            block, held = [], 0
        block.append((row.i, row.t))
        held += len(row.t)
    yield block


def _pass(rows: DataFrame, shared, text_col: str, size: int, first: bool) -> DataFrame:
    names = [f.name for f in rows.schema if f.name not in _RESULT.names or first]
    schema = ", ".join([f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names] + [RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(shared.value, size)
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            texts = batch.column(text_col)
            before = None if first else batch.column("item_ids"), None if first else batch.column("spans")
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                count, hit, ids = scan(text, found)
                if not first and before[1][i].as_py():
                    old = [(s["start"], s["end"]) for s in before[1][i].as_py()]
                    at = np.array([m.start() for m in _WORD.finditer(text)], np.int64)
                    known = [np.arange(*np.searchsorted(at, s)) for s in old]
                    hit = np.unique(np.concatenate([hit, *known]))
                    ids |= set(before[0][i].as_py())
                columns[0].append(count)
                columns[1].append(len(hit))
                columns[2].append(sorted(ids))
                columns[3].append([{"start": a, "end": b} for a, b in original_spans(text, hit)] if len(hit) else [])
            kept = [batch.column(n) for n in names]
            added = [pa.array(c, f.type) for c, f in zip(columns, _RESULT, strict=True)]
            yield pa.RecordBatch.from_arrays(kept + added, names=[*names, *_RESULT.names])

    return rows.mapInArrow(run, schema)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Columns ``keep`` of each row (doc_id), then n_words, n_hit, item_ids, spans.

    NULL texts have no words; without benchmark rows nothing is hit. Repeated benchmark
    rows count once, a NULL item id marks words but is no item. Repeated documents are
    rows of their own. Columns other than ``keep`` and the text are not read.
    """
    keep = ["doc_id"] if keep is None else keep
    context = docs.sparkSession.sparkContext
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    for k, block in enumerate(_blocks(benchmark, item_id_col, item_text_col, block_bytes)):
        rows = _pass(rows, context.broadcast(block), "_text", size, k == 0)
    return rows.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *_RESULT.names)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs."""
    marked = find_contamination(
        docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]),
        benchmark,
        [f"c{i}" for i in range(len(docs.columns))],
        f"c{docs.columns.index(text_col)}",
    )
    clean = marked.filter("n_hit = 0")
    return clean.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS size,
    array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS r(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT size FROM win),
pos AS (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, sizes WHERE len(ws) >= size),
hit AS (SELECT doc_id, i, size, item_id FROM (
    SELECT doc_id, i, size, array_to_string(ws[i : i + size - 1], ' ') AS win FROM pos) JOIN win USING (size, win)),
hit_words AS (SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)"""
