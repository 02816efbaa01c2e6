"""Connected components of a link table, by alternating large and small stars.

Each round hangs the neighbours of a node on the smallest node it knows of; links shrink
to stars around the smallest node of their component. Rounds are written tables, so
lineage stays short and lost executors cost one round; nothing goes to the driver but
the count of links that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventmill.session import stage_clean


def _smallest(edges: DataFrame) -> DataFrame:
    """edges (u, v) as pairs (node, other) joined with the node's smallest neighbour or itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hung = _smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.filter("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links point from the larger to the smaller node."""
    near = _smallest(edges)
    hung = near.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(near.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node; component is the smallest node reachable.

    Links have no direction; repeated links and links of a node with itself are allowed,
    links with NULL are ignored.
    """
    whole = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    pair = whole.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = stage_clean(pair.filter("u != v").distinct(), "links")
    stars = edges.isEmpty()
    while not stars:
        edges = stage_clean(_small(_large(edges)), "links")
        # done when every node has one link, to a node that has none to a smaller one
        once = edges.groupBy("u").agg(F.count("*").alias("n"))
        stars = once.filter("n > 1").isEmpty() and edges.join(
            once.select(F.col("u").alias("v")), "v", "left_semi"
        ).isEmpty()
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
