"""Exact dedup: 128-bit content hash, smallest id stays, bytes compared inside every hash group.

Rows are grouped by (hash, normalised text). The hash map of the aggregation compares
the bytes, on the map side first, so a group that holds a third of all rows reaches the
shuffle as one row per task. Texts cross the network once, the join back to the rows
carries hashes and ids only. Two different texts under one hash show up as two rows of
one hash; only those hashes take a second pass that joins on the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.session import stage

SPACES = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def hash128(text: Column) -> Column:
    """First 16 bytes of SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _classes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))


def _marked(
    docs: DataFrame, id_col: str, text_col: str, content_hash: Callable[[Column], Column]
) -> DataFrame:
    """One row per (id, text): h, id, sha, keep_id, group_size, n (equal rows), kept."""
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("h", content_hash(F.col("norm")))
    groups = stage(
        _classes(rows)
        .groupBy("h")
        .agg(
            F.min("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
            F.count("*").alias("texts"),
        ),
        "dedup-groups",
    )
    slim = rows.select("h", "id", F.sha2("norm", 256).alias("sha"))
    members = slim.groupBy("h", "sha", "id").agg(F.count("*").alias("n"))
    result = members.join(groups.filter("texts = 1").drop("texts"), "h")
    collided = groups.filter("texts > 1").select("h")
    if not collided.isEmpty():
        open_rows = rows.join(collided, "h", "left_semi")
        apart = open_rows.groupBy("h", "norm", "id").agg(F.count("*").alias("n"))
        exact = apart.join(_classes(open_rows), ["h", "norm"]).withColumn("sha", F.sha2("norm", 256))
        result = result.unionByName(exact.drop("norm"))
    return result.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = hash128,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row, dropped ones too.

    NULL text counts as empty. A NULL id is larger than every other; keep_id is NULL
    where a group has no other. Of rows equal in id and text one is kept, all count in
    group_size. Other columns are not read; an empty table gives no rows.
    """
    marks = _marked(docs, id_col, text_col, content_hash)
    each = marks.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("kept") & (F.col("i") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the smallest id, all its columns.

    Rows equal in id and text leave one of them; which is open when other columns differ.
    """
    marks = _marked(docs, id_col, text_col, hash128).filter("kept").select("h", "id", "n")
    keep = stage(marks.withColumnsRenamed({c: f"_dedup_{c}" for c in marks.columns}), "dedup-kept")
    keyed = docs.withColumn("_dedup_key", hash128(normalised(F.col(text_col))))
    on = (F.col("_dedup_key") == F.col("_dedup_h")) & F.col(id_col).eqNullSafe(F.col("_dedup_id"))
    kept = keyed.join(keep, on, "left_semi")
    if not keep.filter("_dedup_n > 1").isEmpty():
        kept = kept.dropDuplicates(["_dedup_key", id_col])
    return kept.select(*[docs[c] for c in docs.columns])
