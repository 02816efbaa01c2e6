"""Audit of how filters interact: what each of them removes in every order of application.

One pass over the texts gives each document a mask of the filters that it fails; documents
are then counted by part and mask. In an order, a filter's position is the inverse
permutation's entry, and a mask goes at the least position among its filters: the min-plus
product of masks (0 where a filter fails, infinite elsewhere) and positions. That removal
step says where the counts of a mask are added.

A filter that finds copies needs the whole table: a text's copies are told by its SHA-256,
and a document fails if a smaller id has the same text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.session import stage

FILTERS = "ABCDE"
_WORDS = r"[\x20\x09-\x0D]+"

ORACLE = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT doc_id, part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > first, false)] AS fails FROM w),
l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS bad FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad
    FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT substr('ABCDE', a.i, 1) || substr('ABCDE', b.i, 1) || substr('ABCDE', c.i, 1) || substr('ABCDE', d.i, 1)
    || substr('ABCDE', e.i, 1) AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS p
  FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
r AS (SELECT c.*, filter_order, p, coalesce(list_min([s FOR s IN [1, 2, 3, 4, 5] IF fails[p[s]]]), 6) AS gone FROM c, o),
s AS (SELECT part, filter_order, i AS step, p[i] AS k,
    sum(n) FILTER (WHERE gone > i) AS kept, sum(n) FILTER (WHERE gone = i) AS removed,
    sum(n) FILTER (WHERE gone < i AND fails[p[i]]) AS redundant,
    sum(n) FILTER (WHERE fails[p[i]] AND len([z FOR z IN fails IF z]) = 1) AS unique_fails,
    sum(good) FILTER (WHERE gone = i) AS good_lost, sum(bad) FILTER (WHERE gone = i) AS toxic_lost
  FROM r, x GROUP BY part, filter_order, p, i)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, k), 0)::BIGINT AS shapley
FROM s"""


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that look at one text (not NULL): few words, few distinct words, many
    capitals, markup characters."""
    words = F.filter(F.split(text, _WORDS), lambda w: w != "")
    n, capitals = F.size(words), F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)) * 100 < n * 65,
        "C": capitals * 100 > F.char_length(text) * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask (bit i: filter i of ``FILTERS`` fails), good and toxic of every row of ``docs``.

    NULL texts count as empty, NULL parts as the empty string. A document is good or toxic
    if any row of ``labels`` with its id says 1. Rows that share an id don't count as copies
    of each other, and a row without an id is no copy and has no labels. Texts are read
    once; what is shuffled is a hash and a few flags a row, by hash and id, so that a group
    of copies spreads over the tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tests = text_filters(F.col("_t"))
    bits = [F.when(tests[f], 1 << i).otherwise(0) for i, f in enumerate(FILTERS[:4])]
    narrow = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("_t")
    ).select("_id", "part", F.unhex(F.sha2("_t", 256)).alias("_hash"), (bits[0] + bits[1] + bits[2] + bits[3]).alias("_mask"))
    rows = stage(narrow, "failures")
    firsts = rows.filter("_id IS NOT NULL").groupBy("_hash").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    known = labels.groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    copy = F.when(F.col("_id").isNotNull() & F.col("_first").isNull(), 16).otherwise(0)
    joined = rows.join(firsts, ["_hash", "_id"], "left").join(known, "_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return joined.select("part", (F.col("_mask") + copy).cast("int").alias("mask"), flag("good"), flag("toxic"))


class Ranks:
    """Removal steps of all masks in all orders of ``n`` filters, and where counts go."""

    def __init__(self, n: int):
        self.orders = np.array(list(permutations(range(n))), np.int64)  # order, step -> filter
        self.position = np.argsort(self.orders, axis=1) + 1  # inverse permutation: order, filter -> step
        fails = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
        self.fails = fails.astype(bool)
        cost = np.where(self.fails, 0.0, np.inf)
        # min-plus product; the empty mask is never removed, which is step n + 1
        least = np.full((len(self.orders), 1 << n), np.inf)
        for f in range(n):
            least = np.minimum(least, self.position[:, f, None] + cost[None, :, f])
        self.step = np.where(np.isinf(least), n + 1, least).astype(np.int64)
        self.single = fails.sum(1) == 1

    def scatter(self, weights: np.ndarray) -> np.ndarray:
        """Sums of ``weights`` (part, mask) by part, order and removal step (the last: kept to the end)."""
        n_orders, steps = len(self.orders), self.orders.shape[1] + 1
        out = np.zeros((n_orders * steps, len(weights)), np.int64)
        cell = np.arange(n_orders)[:, None] * steps + self.step - 1
        for mask in np.flatnonzero(weights.any(0)):
            np.add.at(out, cell[:, mask], weights[:, mask])
        return out.reshape(n_orders, steps, -1).transpose(2, 0, 1)

    def report(self, n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
        """Counts by part, order and step from counts by part and mask."""
        removed = self.scatter(n)
        by_step = {"removed": removed, "good_lost": self.scatter(good), "toxic_lost": self.scatter(toxic)}
        steps = self.orders.shape[1]
        out = {k: v[:, :, :steps] for k, v in by_step.items()}
        out["kept"] = n.sum(1)[:, None, None] - np.cumsum(out["removed"], axis=2)
        failing = n @ self.fails.astype(np.int64)  # part, filter
        out["redundant"] = failing[:, self.orders] - out["removed"]
        alone = (n * self.single) @ self.fails.astype(np.int64)
        out["unique_fails"] = alone[:, self.orders]
        share = np.zeros_like(failing)
        for f in range(steps):
            share[:, f] = out["removed"][:, self.orders == f].sum(1)
        out["shapley"] = share[:, self.orders]
        return out


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(masks: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from :func:`failure_masks`.

    kept: documents after the step; removed: at it; redundant: fail its filter but went
    earlier; unique_fails: fail its filter only; good_lost, toxic_lost: removed at it and so
    labelled; shapley: removed by its filter over all orders. Without documents there are no
    rows. At most 32 counted masks a part reach a task.
    """
    one = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    counted = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), one("good"), one("toxic"))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))
    ranks = Ranks(len(FILTERS))
    names = ["".join(FILTERS[f] for f in order) for order in ranks.orders]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, steps = ranks.orders.shape
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # a part makes 600 rows
                piece = batch.slice(at, 64)
                lists, k = piece.column("c"), piece.num_rows
                flat, which = lists.flatten(), lists.value_lengths().to_numpy()
                row = np.repeat(np.arange(k), which)
                weights = {c: np.zeros((k, 1 << steps), np.int64) for c in ("n", "good", "toxic")}
                for c, w in weights.items():
                    w[row, flat.field("mask").to_numpy()] = flat.field(c).to_numpy()
                found = ranks.report(weights["n"], weights["good"], weights["toxic"])
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("part").take(pa.array(np.repeat(np.arange(k), orders * steps))),
                        pa.array(names * k).take(pa.array(np.repeat(np.arange(orders * k), steps))),
                        pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), orders * k)),
                        *[pa.array(found[c].ravel()) for c in COUNTS],
                    ],
                    names=["part", "filter_order", "step", *COUNTS],
                )

    return parts.mapInArrow(run, schema)


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(failure_masks(docs, labels))
