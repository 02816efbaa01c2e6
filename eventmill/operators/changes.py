"""Tables that grow by finished batches and are merged when read.

A batch is a folder ``batch_key=<number>~<key>`` that counts once its write has finished, so a
failed or repeated write never shows rows twice: the same key is published once. A base,
``base=<number>``, holds what the batches up to its number come to; :func:`fold` writes a
new one beside the old. One writer a table is assumed, any number of readers.

Three kinds of table use it: plain appends (:func:`read_published`), keyed rows of which
the newest counts (:func:`read_merged`), and partial aggregates that a reader adds up
(:func:`read_totals`). What a batch costs depends on the batch alone, wherever its keys lie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmill.operators.ordering import newest_per_key
from eventmill.session import micros
from eventmill.sources.files import child_dirs, exists, make_dirs, remove

BATCH, PREFIX = "_batch", "batch_key="
Totals = Callable[[DataFrame], DataFrame]


def _finished(spark: SparkSession, path: str) -> tuple[int, dict[str, str], set[str]]:
    """Number of the newest base (0: none), folders of finished batches after it by key in order, and
    all keys that were ever published."""
    names = child_dirs(spark, path)
    bases = [int(n[5:]) for n in names if n.startswith("base=") and exists(spark, f"{path}/{n}/_SUCCESS")]
    base = max(bases, default=0)
    batches = {n.split("~", 1)[1]: n for n in names if n.startswith(PREFIX) and exists(spark, f"{path}/{n}/_SUCCESS")}
    live = {k: n for k, n in batches.items() if _number(n) > base}
    return base, live, {*batches, *(n[5:] for n in names if n.startswith("done="))}


def _number(folder: str) -> int:
    return int(folder[len(PREFIX) :].split("~", 1)[0])


def publish(df: DataFrame, path: str, key: str | None = None, partition_by: list[str] = ()) -> bool:
    """Write ``df`` as one batch; False, and nothing is written, if ``key`` was published before.

    Without a key the batch is named by its number, so every call counts. Leftovers of a
    write that failed are removed first.
    """
    spark = df.sparkSession
    base, live, known = _finished(spark, path)
    if key is not None and key in known:
        return False
    for n in child_dirs(spark, path):
        if n.startswith(PREFIX) and not exists(spark, f"{path}/{n}/_SUCCESS"):
            remove(spark, f"{path}/{n}")
    number = max([base, *map(_number, live.values())]) + 1
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with micros(spark):
        writer.parquet(f"{path}/{PREFIX}{number:08d}~{number if key is None else key}")
    return True


def _folders(spark: SparkSession, path: str, folders: list[str]) -> DataFrame | None:
    """Rows of batch folders in one scan, with the batch's number; files may differ in columns."""
    if not folders:
        return None
    rows = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*[f"{path}/{n}" for n in folders])
    return rows.withColumn(BATCH, F.substring("batch_key", 1, 8).cast("int")).drop("batch_key")


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    base, live, _ = _finished(spark, path)
    return spark.read.parquet(f"{path}/base={base:08d}") if base else None, _folders(spark, path, list(live.values()))


def read_published(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of finished batches; None without any."""
    base, recent = _parts(spark, path)
    if recent is None:
        return base
    recent = recent.drop(BATCH)
    return recent if base is None else base.unionByName(recent, allowMissingColumns=True)


def read_batch(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows of one published batch that isn't folded yet."""
    return spark.read.parquet(f"{path}/{_finished(spark, path)[1][key]}")


# --- keyed rows ------------------------------------------------------------------------
def upsert(updates: DataFrame, path: str, keys: list[str], order: list[str] | None = None, key: str | None = None) -> bool:
    """Add a batch of changed rows; of several for one key the newest by ``order`` counts.

    Writes the batch's rows only. A key's row in a later batch stands for those before it,
    so applying a batch twice changes nothing.
    """
    rows = newest_per_key(updates, keys, order) if order else updates.dropDuplicates(keys)
    return publish(rows, path, key)


def _newest(base: DataFrame | None, recent: DataFrame | None, keys: list[str]) -> DataFrame | None:
    if recent is None:
        return base
    # batches after the base are few and small: the base is filtered by their keys and doesn't move
    newest = newest_per_key(recent, keys, [BATCH]).drop(BATCH)
    if base is None:
        return newest
    fresh = newest.select(*[F.col(k).alias(f"_u{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_u{i}"))
    return base.join(fresh, same, "left_anti").unionByName(newest, allowMissingColumns=True)


def read_merged(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The newest row of every key; None if nothing was ever published."""
    return _newest(*_parts(spark, path), keys)


# --- partial aggregates ------------------------------------------------------------------
def read_totals(spark: SparkSession, path: str, totals: Totals, where=None) -> DataFrame | None:
    """Partial rows of base and batches, ``where`` applied to the scans, put together by ``totals``."""
    rows = read_published(spark, path)
    if rows is None:
        return None
    return totals(rows if where is None else rows.filter(where))


# --- folding ---------------------------------------------------------------------------
def fold(
    spark: SparkSession,
    path: str,
    keys: list[str] | None = None,
    totals: Totals | None = None,
    partition_by: list[str] = (),
    at_least: int = 1,
) -> bool:
    """Write a new base of the old one and all batches, if there are ``at_least`` so many.

    ``keys``: newest row per key; ``totals``: partial rows put together; neither: all rows. The
    new base counts when its write has finished; until then readers see the old one
    and the batches, so a crash at any step loses nothing. The old base stays for running
    readers until the next fold; names of folded batches are kept.
    """
    base, live, _ = _finished(spark, path)
    if len(live) < at_least:
        return False
    old = spark.read.parquet(f"{path}/base={base:08d}") if base else None
    recent = _folders(spark, path, list(live.values()))
    if keys:
        rows = _newest(old, recent, keys)
    else:
        recent = recent.drop(BATCH)
        rows = recent if old is None else old.unionByName(recent, allowMissingColumns=True)
        rows = totals(rows) if totals else rows
    number = max(map(_number, live.values()))
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = rows.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by)
    with micros(spark):
        writer.parquet(f"{path}/base={number:08d}")
    _clear(spark, path, base)
    return True


def _clear(spark: SparkSession, path: str, before: int) -> None:
    """Remove what the base ``before`` has made superfluous; a reader may still use that base and the
    batches after it."""
    for n in child_dirs(spark, path):
        if n.startswith("base=") and int(n[5:]) < before:
            remove(spark, f"{path}/{n}")
        elif n.startswith(PREFIX) and _number(n) <= before:
            make_dirs(spark, f"{path}/done={n.split('~', 1)[1]}")
            remove(spark, f"{path}/{n}")
