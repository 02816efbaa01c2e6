"""Distributed ordering against brute force, with hot keys and ties."""

import random

import pytest
from pyspark.sql import functions as F

from eventmill.operators import ordering


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        data.append((i, key, rng.randrange(50), float(rng.randrange(8)) if rng.random() < 0.9 else None))
    return spark.createDataFrame(data, "id long, key string, t int, v double").repartition(7).cache(), data


def test_global_rank_is_the_total_order(rows):
    df, data = rows
    got = {r.id: r["_g"] for r in ordering.global_rank(df, [F.col("t"), F.col("id")]).collect()}
    want = {d[0]: g for g, d in enumerate(sorted(data, key=lambda d: (d[2], d[0])))}
    assert got == want


def test_running_totals_span_partitions(rows):
    df, data = rows
    got = ordering.running_totals(df, ["key"], [F.col("t"), F.col("id")], {"n": F.lit(1), "s": F.coalesce("v", F.lit(0.0))})
    assert set(got.columns) == {"id", "key", "t", "v", "n", "s"}
    want, state = {}, {}
    for d in sorted(data, key=lambda d: (d[2], d[0])):
        n, s = state.get(d[1], (0, 0.0))
        state[d[1]] = (n + 1, s + (d[3] or 0.0))
        want[d[0]] = state[d[1]]
    assert {r.id: (r.n, r.s) for r in got.collect()} == want


@pytest.mark.parametrize("block", [10, 64, 100_000])
def test_trailing_rows_in_small_blocks(rows, block):
    df, data = rows
    got = ordering.trailing_rows(
        df,
        ["key"],
        [F.col("t"), F.col("id")],
        5,
        lambda w: {"n": F.count("*").over(w), "first_id": F.first("id").over(w)},
        block,
    )
    want, seen = {}, {}
    for d in sorted(data, key=lambda d: (d[2], d[0])):
        seen.setdefault(d[1], []).append(d[0])
        last = seen[d[1]][-5:]
        want[d[0]] = (len(last), last[0])
    rows_got = got.collect()
    assert len(rows_got) == len(data)
    assert {r.id: (r.n, r.first_id) for r in rows_got} == want


def test_trailing_seconds_across_blocks(spark):
    seconds = sorted(random.Random(3).sample(range(20_000), 4000))
    df = spark.createDataFrame([(s, s % 3 + 1) for s in seconds], "second long, n int")
    got = ordering.trailing_seconds(df, [], "second", 60, lambda w: {"s": F.sum("n").over(w)}, block_seconds=100)
    want = {s: sum(x % 3 + 1 for x in seconds if s - 60 < x <= s) for s in seconds}
    assert {r.second: r.s for r in got.collect()} == want


def test_running_totals_ignore_null(spark):
    data = [(i, None if i < 600 or i % 7 == 0 else i) for i in range(800)]
    df = spark.createDataFrame(data, "id long, v long").repartition(8)
    got = {r.id: r.s for r in ordering.running_totals(df.withColumn("k", F.lit(1)), ["k"], [F.col("id")], {"s": F.col("v")}).collect()}
    run, want = None, {}
    for i, v in data:
        run = run if v is None else (run or 0) + v
        want[i] = run
    assert got == want


def test_frames_longer_than_a_block(spark):
    df = spark.createDataFrame([(60 * i, 1) for i in range(300)], "second long, n int")
    got = ordering.trailing_seconds(df, [], "second", 7200, lambda w: {"s": F.sum("n").over(w)})
    assert {r.second: r.s for r in got.collect()} == {60 * i: min(i + 1, 120) for i in range(300)}


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("size", [3, 5, 23, 500])
def test_ntile_matches_the_window_function(rows, size, descending):
    df, data = rows
    part = [d for d in data if d[0] < size]
    sub = df.filter(F.col("id") < size)
    tiles = ordering.ntile_columns(sub, {"t": not descending, "v": descending}, "id", 5)
    got = {r.id: r.tile for r in sub.select("id", tiles["v"].alias("tile")).collect()}

    def order(d):
        v = float("-inf") if d[3] is None else d[3]
        return (-v if descending else v, d[0])

    ranked = sorted(part, key=order)
    q, r = divmod(len(part), 5)
    sizes = [q + (1 if i < r else 0) for i in range(5)]
    tiles = [i + 1 for i, n in enumerate(sizes) for _ in range(n)]
    assert got == {d[0]: t for d, t in zip(ranked, tiles, strict=True)}


def test_empty_frames(spark):
    empty = spark.createDataFrame([], "id long, key string, t int, v double")
    assert ordering.global_rank(empty, [F.col("id")]).count() == 0
    assert ordering.running_totals(empty, ["key"], [F.col("id")], {"n": F.lit(1)}).count() == 0
    assert empty.select(ordering.ntile_columns(empty, {"v": False}, "id", 5)["v"]).count() == 0


def test_deep_page_equals_shallow_page(rows):
    df, _ = rows
    order = [F.desc("t"), F.asc("id")]
    shallow = [r.id for r in ordering.page(df, order, 40, 30).collect()]
    deep = sorted(r.id for r in ordering.page(df, order, 40, 30, by_rank=True).collect())
    assert deep == sorted(shallow)


def test_newest_per_key_keeps_null_key(rows):
    df, data = rows
    got = {r.key: r.id for r in ordering.newest_per_key(df, ["key"], ["t", "id"]).collect()}
    want = {}
    for d in sorted(data, key=lambda d: (d[2], d[0])):
        want[d[1]] = d[0]
    assert got == want
