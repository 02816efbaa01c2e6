"""Exact Jaccard join of shingle sets as a metric-space join with pivots.

Sets with Jaccard distance d = 1 - |x & y| / |x | y| form a metric space; two texts link
when d <= r = 0.2. Equal sets are one point. Two kinds of pivots cut the space:

1. Single shingles {s}. All pivots inside x are equally near (1 - 1/|x|), all others are
   at distance 1, so one order of all shingles, the same for every set, decides ties: the
   cell of x is that of its first shingle. If d(x, y) <= r, then |x - y| <= r |x|, so y
   holds one of any floor(r |x|) + 1 shingles of x: x is copied into the cells of that
   many first pivots, which is all the boundary there is, and each linked pair meets in a
   cell. The order is that of the hashes, but shingles that stand first in more than
   COMMON texts come last, the more common the later: passages that many texts share do
   not crowd cells. They are counted over all texts. Document pivots cannot open the
   join: nearly all texts are at distance 1 from all of them.
2. Texts, inside cells, where distances are small. Every text of a region is measured
   against a few of its texts; the first is the one whose cells hold the most others for
   its size, which among copies of one origin is the origin. Texts within r of a pivot
   are connected through it and stay only if the triangle inequality allows a link to one
   that is not. Regions whose texts mostly link with one pivot are many views of the
   same texts and become one region. Pairs of a small region are measured; a larger one
   joins recursively around its pivot p: x ^ p and y ^ p, the differences from it, differ
   in as many places as x and y, so a linked pair agrees in the first places of both
   differences, the rarest first. For h = r (|x| + |y|) / (2 - r), which bounds |x ^ y| of
   a linked pair, the first common one stands at places i and j, counted from 0, with
   2i + |y ^ p| - |x ^ p| <= h and the same for j. Only if both lie within r of p may they
   agree nowhere, and then p connects them. Copies of one origin share most shingles, but
   few of their changes, so what they don't share is what this compares.

Distances are bounded from below by counts of the sets' hashes in 256 classes, which is a
pivot table of the symmetric difference; only pairs it cannot exclude read the sets. The
question is which texts are connected, so pairs already connected are not measured.
Regions are tables and rounds are written; no task holds a whole region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventmill.llm.components import components
from eventmill.llm.shingles import set_key, shingle_sets
from eventmill.session import stage_clean

PERCENT = 80
SIZE = 5
MOST_SHARED = 1 << 20  # shared shingles that the order may know; a bound of the broadcast
CLASSES = 256
COMMON = 4  # a shingle in more texts than this comes late in the order
STARS = 3  # pivots that every region starts with
FEW_PAIRS = 4096  # a region with up to this many open pairs measures them, a larger one joins around its pivot
SHARE = 64  # texts of a region that meet one copy of its pivot
FEW_IDS = 2_000_000  # ids up to this number are broadcast to pick texts, more are joined


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _batches(column, rows: int = 2000) -> Iterator[list]:
    for at in range(0, len(column), rows):
        yield column[at : at + rows].to_pylist()


def _survey(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, key, sig of every row; sig counts the set's hashes by class, up to 255."""
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sig = [], [], []
            for texts in _batches(batch.column("text")):
                for x in shingle_sets(texts, size):
                    n.append(len(x))
                    key.append(set_key(x))
                    counts = np.bincount((x & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
                    sig.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())],
                names=["doc_id", "n", "key", "sig"],
            )

    return docs.mapInArrow(run, f"doc_id {id_type.simpleString()}, n long, key binary, sig binary")


def _entered(n: int, percent: int) -> int:
    """Cells that a set of ``n`` shingles enters: n - ceil(t n) + 1, which is floor(r n) + 1."""
    return n + (-percent * n // 100) + 1


def _shared_shingles(docs: DataFrame, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand first, by hash, in more than COMMON texts, and their levels.

    Of each text those are counted that it would enter, and a quarter and 24 more, as the
    places of common ones go to the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _batches(batch.column("text")):
                low = [x[: _entered(len(x), percent) * 5 // 4 + 24] for x in shingle_sets(texts, size)]
                h, times = np.unique(np.concatenate(low), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times)], names=["h", "times"])

    counts = docs.select("text").mapInArrow(run, "h long, times long").groupBy("h").agg(F.sum("times").alias("times"))
    level = F.floor(F.log2("times")).cast("int").alias("level")
    shared = stage_clean(counts.filter(F.col("times") > COMMON).select("h", level), "jaccard-shared")
    least, rows = 0, 0
    for r in sorted(shared.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        rows += r["count"]
        if rows > MOST_SHARED:
            least = r["level"] + 1
            break
    found = shared.filter(F.col("level") >= least).toPandas()  # at most MOST_SHARED rows
    h = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], found["level"].to_numpy(np.uint8)[order]


def _first(x: np.ndarray, shared: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The first floor(r n) + 1 shingles in the common order: by level, then by hash."""
    h, level = shared
    count = _entered(len(x), percent)
    if not len(h):
        return x[:count]
    at = np.minimum(np.searchsorted(h, x), len(h) - 1)
    rank = np.where(h[at] == x, level[at], 0)
    return x[np.argsort(rank, kind="stable")[:count]]


def _cells(docs: DataFrame, shared, size: int, percent: int) -> DataFrame:
    """cell, k64: the cells that each set enters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _batches(batch.column("text")):
                sets = {set_key(x): x for x in shingle_sets(texts, size) if len(x)}
                if sets:
                    cells = [_first(x, shared.value, percent) for x in sets.values()]
                    keys = np.array([int.from_bytes(k[:8], "big", signed=True) for k in sets], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(cells).view(np.int64)),
                            pa.array(np.repeat(keys, [len(c) for c in cells])),
                        ],
                        names=["cell", "k64"],
                    )

    return docs.select("text").mapInArrow(run, "cell long, k64 long")


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, lo: lower bound of the distance from the class counts."""
    side = sets.select("node", "n", "sig")
    both = pairs.join(side.withColumnsRenamed({"node": "a", "n": "na", "sig": "sa"}), "a").join(
        side.withColumnsRenamed({"node": "b", "n": "nb", "sig": "sb"}), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16)
                for c in ("sa", "sb")
            )
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            apart = np.abs(x - y).sum(1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("a", "b", "na", "nb")] + [pa.array(2 * apart / (n + apart))],
                names=["a", "b", "na", "nb", "lo"],
            )

    return both.mapInArrow(run, "a long, b long, na long, nb long, lo double")


class _Join:
    def __init__(self, docs: DataFrame, sets: DataFrame, size: int, percent: int):
        self.docs, self.sets, self.size, self.percent = docs, sets, size, percent
        self.r = 1 - percent / 100
        self.links: list[DataFrame] = []

    def _contents(self, nodes: DataFrame) -> DataFrame:
        """node, content: the hashes of the sets of ``nodes``."""
        wanted = self.sets.join(nodes.distinct(), "node", "left_semi").select("node", "key", "doc")
        wanted = stage_clean(wanted, "jaccard-wanted")
        ids = wanted.select("doc")
        ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
        rows = self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi").select("text")
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for texts in _batches(batch.column("text"), 500):
                    content = list(shingle_sets(texts, size))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([set_key(x) for x in content]), pa.array([x.tobytes() for x in content], pa.binary())],
                        names=["key", "content"],
                    )

        read = rows.mapInArrow(run, "key binary, content binary").dropDuplicates(["key"])
        return stage_clean(wanted.select("node", "key").join(read, "key").select("node", "content"), "jaccard-sets")

    def measure(self, pairs: DataFrame) -> DataFrame:
        """a, b, lo, d, linked of distinct pairs; d is NULL where lo excludes a link."""
        bounded = stage_clean(_bounded(pairs, self.sets), "jaccard-pairs")
        far = F.col("lo") > self.r + 1e-9
        near = bounded.filter(~far)
        excluded = bounded.filter(far).select(
            "a", "b", "lo", F.lit(None).cast("double").alias("d"), F.lit(False).alias("linked")
        )
        if near.isEmpty():
            return excluded
        nodes = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node")))
        content = self._contents(nodes)
        both = near.join(content.withColumnsRenamed({"node": "a", "content": "x"}), "a").join(
            content.withColumnsRenamed({"node": "b", "content": "y"}), "b"
        )
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                xs, ys = batch.column("x"), batch.column("y")
                common = [
                    len(np.intersect1d(*(np.frombuffer(c[i].as_buffer(), np.uint64) for c in (xs, ys)), assume_unique=True))
                    for i in range(batch.num_rows)
                ]
                common = np.array(common, np.int64)
                union = batch.column("na").to_numpy() + batch.column("nb").to_numpy() - common
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("a", "b", "lo")]
                    + [pa.array(1 - common / np.maximum(union, 1)), pa.array(100 * common >= percent * union)],
                    names=["a", "b", "lo", "d", "linked"],
                )

        exact = stage_clean(both.mapInArrow(run, "a long, b long, lo double, d double, linked boolean"), "jaccard-measured")
        self.links.append(exact.filter("linked").select("a", "b"))
        return exact.union(excluded)

    def all_links(self) -> DataFrame:
        found = self.sets.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
        for more in self.links:
            found = found.union(more)
        return found

    def fits(self, n: str, m: str):
        """Sizes that a link allows."""
        return F.least(n, m) * 100 >= F.greatest(n, m) * self.percent

    def chosen(self, regions: DataFrame) -> DataFrame:
        """region, center, pivot, pn: the text with the highest score, and the first in other hash orders."""
        picks = [F.max(F.struct("score", F.col("node").alias("pivot"), F.col("n").alias("pn")))]
        for j in range(1, STARS):
            order = F.xxhash64("node", F.lit(0), F.lit(j)).alias("order")
            picks.append(F.min(F.struct(order, F.col("node").alias("pivot"), F.col("n").alias("pn"))))
        plain = F.array_distinct(F.array(*[F.struct(p["pivot"].alias("pivot"), p["pn"].alias("pn")) for p in picks]))
        found = regions.groupBy("region").agg(plain.alias("p"))
        return found.select("region", F.col("p")[0]["pivot"].alias("center"), F.inline("p"))

    def stars(self, regions: DataFrame) -> DataFrame:
        """Measure every text of a region against STARS of its texts and give the regions that remain.

        component is the region's center for texts linked with it, and the text itself for others.

        A text goes if it is a pivot, or lies in the core of one so deep that no text outside
        the core can link to it: what may link to it is connected with it already.
        """
        rows = regions.join(stage_clean(self.chosen(regions), "jaccard-pivots"), "region")
        told = stage_clean(self._told(rows, self.measure(self._pairs(rows))), "jaccard-told")
        core = F.col("hi") <= self.r + 1e-9
        edges = told.groupBy("region", "pivot").agg(F.min(F.when(~core, F.col("lo"))).alias("edge"))
        deep = core & (F.col("d") < F.coalesce("edge", F.lit(9.0)) - self.r - 1e-9)
        remains = told.join(edges, ["region", "pivot"]).groupBy("region", "node")
        remains = remains.agg(
            F.first("n").alias("n"),
            F.first("center").alias("center"),
            F.max(deep | (F.col("node") == F.col("pivot"))).alias("gone"),
            F.max(F.when(core & (F.col("pivot") == F.col("center")), F.col("center"))).alias("component"),
        )
        component = F.coalesce("component", "node").alias("component")
        return remains.filter("not gone").select("region", "node", "n", "center", component)

    def _told(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        """Texts and pivots with bounds of their distance: lo and hi, both d where it was measured."""
        ends = [F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")]
        own = F.when(F.col("node") == F.col("pivot"), F.lit(0.0))
        return (
            rows.select("*", *ends)
            .join(known, ["a", "b"], "left")
            .withColumn("d", F.coalesce(own, "d"))
            # sizes alone bound the distance of pairs that were not measured
            .withColumn("lo", F.coalesce("d", "lo", 1 - F.least("n", "pn") / F.greatest("n", "pn")))
            .withColumn("hi", F.coalesce("d", F.lit(1.0)))
            .select("region", "node", "n", "center", "pivot", "lo", "hi", "d")
        )

    def _pairs(self, rows: DataFrame) -> DataFrame:
        rows = rows.filter((F.col("node") != F.col("pivot")) & self.fits("n", "pn"))
        return rows.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()

    def across(self, regions: DataFrame) -> DataFrame:
        """Pairs of different components: texts not linked with a region's center with all its texts."""
        outside = regions.filter(F.col("component") != F.col("center"))
        outside = outside.select("region", *[F.col(c).alias(f"o_{c}") for c in ("node", "n", "component")])
        both = regions.join(outside, "region").filter(
            (F.col("component") != F.col("o_component"))
            & ((F.col("component") == F.col("center")) | (F.col("o_node") < F.col("node")))
            & self.fits("n", "o_n")
        )
        return both.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()

    def _differences(self, regions: DataFrame) -> DataFrame:
        """region, node, n, component, center, linked, delta: the difference of each text from its region's center.

        Copies of a center's set are dealt to the texts of its region by SHARE.
        """
        content = self._contents(regions.select("node").union(regions.select(F.col("center").alias("node"))))
        share = F.pmod(F.xxhash64("node"), F.col("shares")).alias("share")
        regions = regions.withColumn("shares", F.ceil(F.col("texts") / SHARE).cast("long"))
        copies = regions.groupBy("center").agg(F.max("shares").alias("shares"))
        copies = copies.select("center", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
        pivots = content.withColumnsRenamed({"node": "center", "content": "p"}).join(copies, "center")
        both = regions.select("*", share).join(content, "node").join(pivots, ["center", "share"])
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                xs, ps = batch.column("content"), batch.column("p")
                delta, linked = [], []
                for i in range(batch.num_rows):
                    x, p = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (xs, ps))
                    d = np.setxor1d(x, p, assume_unique=True)
                    union = (len(x) + len(p) + len(d)) // 2
                    linked.append(100 * (union - len(d)) >= percent * union)
                    delta.append(d.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("region", "node", "n", "component", "center")]
                    + [pa.array(linked), pa.array(delta, pa.list_(pa.int64()))],
                    names=["region", "node", "n", "component", "center", "linked", "delta"],
                )

        kept = both.select("region", "node", "n", "component", "center", "content", "p")
        told = "region long, node long, n long, component long, center long, linked boolean, delta array<long>"
        return stage_clean(kept.mapInArrow(run, told), "jaccard-deltas")

    def around(self, regions: DataFrame) -> DataFrame:
        """Pairs that may link, of texts whose differences from the region's center agree early enough."""
        deltas = self._differences(regions)
        self.links.append(
            deltas.filter("linked and node != center").select(
                F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")
            )
        )
        places = deltas.select("region", "node", F.explode("delta").alias("h"))
        often = places.groupBy("region", "h").agg(F.count("*").alias("times")).filter("times > 1")
        shared = places.join(often, ["region", "h"]).groupBy("region", "node")
        shared = shared.agg(F.sort_array(F.collect_list(F.struct("times", "h"))).alias("shared"))
        # those that no other text has come first; a text can't hold more of them than a link allows
        alone = F.col("m") - F.size("shared")
        most = F.floor(F.col("n") * (100 - self.percent) / self.percent).cast("long") + 1
        first = (
            deltas.withColumn("m", F.size("delta")).drop("delta").join(shared, ["region", "node"])
            .withColumn("alone", alone)
            .withColumn("first", F.slice("shared", 1, F.greatest(most - F.col("alone"), F.lit(0)).cast("int")))
            .select("region", "node", "n", "component", "m", "linked", "alone", F.posexplode("first").alias("at", "s"))
            .withColumn("at", F.col("at") + F.col("alone"))
            .select("region", F.col("s")["h"].alias("h"), "node", "n", "component", "m", "linked", "at")
        )
        first = stage_clean(first, "jaccard-places")
        outer = first.filter("not linked").drop("linked")
        outer = outer.withColumnsRenamed({c: f"o_{c}" for c in ("node", "n", "component", "m", "at")})
        bound = (F.col("n") + F.col("o_n")) * (100 - self.percent)
        early = ((2 * F.col("at") + F.col("o_m") - F.col("m")) * (100 + self.percent) <= bound) & (
            (2 * F.col("o_at") + F.col("m") - F.col("o_m")) * (100 + self.percent) <= bound
        )
        met = outer.join(first, ["region", "h"]).filter(
            (F.col("component") != F.col("o_component"))
            & (F.col("linked") | (F.col("o_node") < F.col("node")))
            & self.fits("n", "o_n")
            & early
        )
        return met.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()

    def _spread(self, regions: DataFrame) -> DataFrame:
        """``regions`` that hold several components, with all texts and those of the largest component."""
        linked = F.sum((F.col("component") == F.col("center")).cast("long"))
        spread = regions.groupBy("region").agg(F.greatest(linked, F.lit(1)).alias("most"), F.count("*").alias("texts"))
        return regions.join(spread.filter("texts > most"), "region")

    def run(self, regions: DataFrame) -> None:
        open_ = stage_clean(self._spread(stage_clean(self.stars(regions), "jaccard-regions")), "jaccard-regions")
        columns = ["region", "node", "n", "center", "component"]
        view = (F.col("most") > 1) & (2 * F.col("most") >= F.col("texts"))
        same = open_.filter(view).withColumn("region", F.xxhash64("center")).select(*columns).distinct()
        open_ = stage_clean(self._spread(same.union(open_.filter(~view).select(*columns))), "jaccard-regions")
        pairs = F.col("texts") * (F.col("texts") - F.col("most"))
        large = open_.filter(pairs > FEW_PAIRS)
        found = self.across(open_.filter(pairs <= FEW_PAIRS))
        if not large.isEmpty():
            found = found.union(self.around(large)).distinct()
        self.measure(found)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    component_id is the smallest id reachable by links, the row's own included. Texts
    without words and NULL texts have 0 shingles and link with nothing, equal ones
    included. Rows with equal sets are linked, repeated rows too. NULL ids are larger than
    others; a component of NULL ids only has NULL. Other columns are not read; an empty
    table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    slim = stage_clean(_survey(rows, size), "jaccard-survey")
    sets = stage_clean(
        slim.filter("n > 0")
        .groupBy("key")
        .agg(F.min("n").alias("n"), F.min("sig").alias("sig"), F.min("doc_id").alias("doc"))
        .withColumn("node", F.monotonically_increasing_id())
        .withColumn("k64", F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")),
        "jaccard-points",
    )
    shared = docs.sparkSession.sparkContext.broadcast(_shared_shingles(rows, size, percent))
    emitted = stage_clean(_cells(rows, shared, size, percent), "jaccard-cells")
    ends = emitted.groupBy("cell").agg(F.min("k64").alias("lo"), F.max("k64").alias("hi"), F.count("*").alias("texts"))
    met = emitted.join(ends.filter("lo != hi").select("cell", "texts"), "cell").distinct()
    scores = met.groupBy("k64").agg(F.sum("texts").alias("score"))
    named = sets.join(scores, "k64").select("k64", "node", "n", (F.col("score") / F.col("n")).alias("score"))
    regions = stage_clean(met.join(named, "k64").select(F.col("cell").alias("region"), "node", "n", "score"), "jaccard-regions")
    join = _Join(rows, sets, size, percent)
    join.run(regions)
    groups = components(join.all_links())
    named = sets.select("key", "node", "doc").join(groups, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    by_key = named.join(smallest, "component").select("key", "component_id")
    linked = slim.filter("n > 0").join(by_key, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = slim.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id. Texts without words all stay.

    Of rows that repeat the smallest id one stays, which is open.
    """
    told = near_duplicates(docs, id_col, text_col)
    keep = told.filter((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = keep.groupBy("doc_id").agg(F.count("*").alias("_rows"), F.min("n_shingles").alias("_n"))
    keep = stage_clean(keep.withColumnRenamed("doc_id", "_keep_id"), "jaccard-keep")
    kept = docs.join(keep, F.col(id_col).eqNullSafe(F.col("_keep_id")))
    if not keep.filter("_rows > 1 and _n > 0").isEmpty():
        kept = kept.filter("_n = 0").unionByName(kept.filter("_n > 0").dropDuplicates([id_col]))
    return kept.select(*docs.columns)


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(
    range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
often AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b USING (x)
  WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM often JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * common >= 80 * (na.n + nb.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.seen)
SELECT n.doc_id, n AS n_shingles, min(seen) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n"""
