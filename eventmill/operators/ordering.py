"""Order-dependent operators that stay distributed.

A window without a partition key, or with one hot key, sorts everything in one
task. Here the rows are range-sorted across the cluster, staged once with their
partition number and position, and everything that must cross a partition
boundary is a table with one row per partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from eventmill.session import stage

_POSITION_MASK = (1 << 33) - 1  # monotonically_increasing_id keeps the row position in the low 33 bits
_BLOCK = 100_000


def sorted_stage(df: DataFrame, order: list[Column]) -> DataFrame:
    """Globally sorted copy of ``df`` with ``_p`` (partition) and ``_i`` (position in it).

    ``order`` must end in a unique key; that also lets the range partitioner
    split a hot value.
    """
    ranged = df.orderBy(*order).withColumns(
        {
            "_p": F.spark_partition_id(),
            "_i": F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)),
        }
    )
    return stage(ranged, "sorted")


def global_rank(df: DataFrame, order: list[Column], name: str = "_g") -> DataFrame:
    """0-based rank of every row in the total order."""
    staged = sorted_stage(df, order)
    sizes = staged.groupBy("_p").agg((F.max("_i") + 1).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # one row per sort partition, so the broadcast does not grow with the data
    ranked = staged.join(F.broadcast(offsets), "_p")
    return ranked.select(*df.columns, (F.col("_offset") + F.col("_i")).alias(name))


def running_totals(df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """Running sums per key, including the current row.

    Rows of one key may span many sort partitions; each partition is summed on
    its own and receives the carry of the partitions before it.
    """
    inputs = {f"_in_{n}": c for n, c in totals.items()}
    staged = sorted_stage(df.withColumns(inputs), [*[F.col(k) for k in keys], *order])
    local = Window.partitionBy("_p", *keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)

    # Only the first key of a partition can have rows before it: one row per partition.
    firsts = staged.filter("_i = 0").select("_p", *[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)])
    spanning = firsts.select(*[f"_k{j}" for j in range(len(keys))]).distinct()
    same = _same_keys(keys)
    sums = (
        staged.join(F.broadcast(spanning), same, "left_semi")
        .groupBy("_p", *keys)
        .agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in totals])
    )
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        F.col("_p").alias("_cp"),
        *[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)],
        *[F.sum(f"_sum_{n}").over(before).alias(f"_carry_{n}") for n in totals],
    )
    windowed = staged.withColumns({f"_run_{n}": F.sum(f"_in_{n}").over(local) for n in totals})
    joined = windowed.join(F.broadcast(carry), (F.col("_p") == F.col("_cp")) & same, "left")
    return joined.select(
        *df.columns,
        *[_plus(F.col(f"_run_{n}"), F.col(f"_carry_{n}")).alias(n) for n in totals],
    )


def _plus(run: Column, carry: Column) -> Column:
    """Sum of two sums; as in a sum, NULL only where both are."""
    return F.when(run.isNotNull() | carry.isNotNull(), F.coalesce(run, F.lit(0)) + F.coalesce(carry, F.lit(0)))


def _same_keys(keys: list[str]) -> Column:
    condition = F.lit(True)
    for j, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k{j}"))
    return condition


def trailing_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    rows: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    block: int = _BLOCK,
) -> DataFrame:
    """Window columns over the last ``rows`` rows per key, in blocks of bounded size.

    Every block is preceded by a copy of the rows its first frames reach back to.
    """
    if rows > block:
        raise ValueError("a frame must fit in a block")
    ranked = global_rank(df, [*[F.col(k) for k in keys], *order])
    home = F.floor(F.col("_g") / block)
    tail = F.col("_g") % block > block - rows
    blocks = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    copies = ranked.withColumn("_home", home).withColumn("_b", F.explode(blocks))
    frame = Window.partitionBy(*keys, "_b").orderBy("_g").rowsBetween(-(rows - 1), 0)
    return copies.withColumns(build(frame)).filter(F.col("_b") == F.col("_home")).drop("_home", "_b", "_g")


def trailing_seconds(
    per_second: DataFrame,
    keys: list[str],
    second: str,
    span: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    block_seconds: int = 3600,
) -> DataFrame:
    """Window columns over the last ``span`` seconds of rows that are already one per key and second.

    A row is copied into the block after its own if frames there reach back to it. Blocks
    are at least as long as a frame, so it never reaches further.
    """
    block_seconds = max(block_seconds, span)
    home = F.floor(F.col(second) / block_seconds)
    last = F.floor((F.col(second) + (span - 1)) / block_seconds)
    copies = per_second.withColumn("_home", home).withColumn("_b", F.explode(F.sequence(home, last)))
    frame = Window.partitionBy(*keys, "_b").orderBy(second).rangeBetween(-(span - 1), 0)
    return copies.withColumns(build(frame)).filter(F.col("_b") == F.col("_home")).drop("_home", "_b")


def ntile_columns(df: DataFrame, values: dict[str, bool], tie: str, tiles: int) -> dict[str, Column]:
    """``ntile`` of several columns over the whole frame, as expressions on (value, tie).

    ``values`` maps a numeric column to whether it is ordered descending. All
    orders are ranked by one sort of narrow rows (column number, value, tie); only
    the first row of each tile, at most ``tiles - 1`` per column, comes to the
    driver. ``df`` should be staged, as it is read again for the count.
    """

    def key(column: str, descending: bool) -> Column:
        """Ascending sort value; NULL is the smallest value, as in Spark's orders."""
        v = F.col(column).cast("double")
        return F.coalesce(-v, F.lit(float("inf"))) if descending else F.coalesce(v, F.lit(float("-inf")))

    pairs = [F.struct(F.lit(i).alias("c"), key(*item).alias("v")) for i, item in enumerate(values.items())]
    narrow = df.select(F.explode(F.array(*pairs)).alias("x"), F.col(tie).alias("t")).select("x.c", "x.v", "t")
    total = df.count()
    size, spare = divmod(total, tiles)
    firsts = sorted({k * size + min(k, spare) for k in range(1, tiles)} - {0, total})
    starts = [i * total + f for i in range(len(values)) for f in firsts]
    cuts = []
    if starts:
        ranked = global_rank(narrow, [F.col("c"), F.col("v"), F.col("t")])
        cuts = ranked.filter(F.col("_g").isin(starts)).select("c", "v", "t").collect()
    out = {}
    for i, item in enumerate(values.items()):
        v, tile = key(*item), F.lit(1)
        for cut in cuts:
            if cut.c == i:
                tile = tile + F.when((v > cut.v) | ((v == cut.v) & (F.col(tie) >= cut.t)), 1).otherwise(0)
        out[item[0]] = tile
    return out


def page(df: DataFrame, order: list[Column], offset: int, limit: int | None, by_rank: bool = False) -> DataFrame:
    """One page in a total order.

    ``by_rank`` ranks all rows and cuts the page out, for pages so deep that the rows
    before them shouldn't come to one task; the result is the same.
    """
    if limit is None or limit == 0:
        return df.orderBy(*order)
    if not by_rank:
        return df.orderBy(*order).offset(offset).limit(limit)
    ranked = global_rank(df, order)
    return ranked.filter(F.col("_g").between(offset, offset + limit - 1)).drop("_g")


def page_with_totals(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page with ``total``, ``has_next`` and ``has_previous`` on every row."""
    total = df.agg(F.count("*")).scalar()
    return page(df, order, offset, limit).withColumns(
        {
            "total": total,
            "has_next": F.lit(offset + limit) < total,
            "has_previous": F.lit(offset > 0),
        }
    )


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def newest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key. ``max_by`` combines before the shuffle, so a hot key costs one row per task."""
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)
