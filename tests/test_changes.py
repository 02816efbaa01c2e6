"""Tables of finished batches: crashes, repeats, merging and folding."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eventmill.operators import changes, writers


def read(spark, path):
    return sorted(tuple(r) for r in changes.read_merged(spark, path, ["k"]).select("k", "v").collect())


def test_random_keys_write_their_rows_only(spark, tmp_path):
    path = tmp_path / "t"
    changes.publish(spark.range(100_000).select(F.col("id").alias("k"), F.lit("old").alias("v")), str(path))
    updates = spark.range(50).select((F.col("id") * 1999).alias("k"), F.lit("new").alias("v"))
    changes.upsert(updates, str(path), ["k"])
    folders = sorted(p for p in path.iterdir() if p.name.startswith("batch_key="))
    assert [spark.read.parquet(str(p)).count() for p in folders] == [100_000, 50]
    rows = changes.read_merged(spark, str(path), ["k"])
    assert rows.count() == 100_000 and rows.filter("v = 'new'").count() == 50


def test_newest_batch_counts_and_keys_may_be_null(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k int, v string, seq int"
    changes.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "n", 1)], schema), path, ["k"], ["seq"])
    changes.upsert(spark.createDataFrame([(1, "x", 1), (1, "y", 3), (1, "z", 2), (None, "m", 1), (3, "c", 1)], schema), path, ["k"], ["seq"])
    want = [(1, "y"), (2, "b"), (3, "c"), (None, "m")]
    got = sorted(((r.k, r.v) for r in changes.read_merged(spark, path, ["k"]).collect()), key=lambda r: (r[0] is None, r[0]))
    assert got == want
    assert changes.fold(spark, path, keys=["k"])
    got = sorted(((r.k, r.v) for r in changes.read_merged(spark, path, ["k"]).collect()), key=lambda r: (r[0] is None, r[0]))
    assert got == want


def test_a_named_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert changes.publish(df, path, "delivery-7") and not changes.publish(df, path, "delivery-7")
    assert changes.publish(df, path, "delivery-8")
    assert changes.read_published(spark, path).count() == 2
    # also after folding, and after the folded batch is gone
    for n in range(3):
        assert changes.fold(spark, path)
        assert not changes.publish(df, path, "delivery-7")
        assert changes.publish(df, path, f"more-{n}")
    assert changes.read_published(spark, path).count() == 5


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = tmp_path / "t"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert writers.append_evolving(df, str(path), key="one")
    broken = df.withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(PySparkException):
        writers.append_evolving(broken, str(path), attempts=1, key="two")
    # what a killed writer leaves: data files without the mark of a finished write
    left = path / "batch_key=00000002~two"
    left.mkdir(exist_ok=True)
    (left / "part-0.parquet").write_bytes(b"half a file")
    assert writers.read_evolving(spark, str(path)).count() == 2
    assert writers.append_evolving(df, str(path), key="two")
    assert writers.read_evolving(spark, str(path)).count() == 4
    assert not writers.append_evolving(df, str(path), key="two")


def test_a_commit_that_fails_after_the_write_is_not_doubled(spark, tmp_path, monkeypatch):
    """The job finishes, but its caller sees an error and tries again."""
    path, calls, real = str(tmp_path / "t"), [], changes.publish

    def flaky(*args):
        done = real(*args)
        calls.append(done)
        if len(calls) == 1:
            raise PySparkException("connection lost", messageParameters={})
        return done

    monkeypatch.setattr(changes, "publish", flaky)
    monkeypatch.setattr(writers.time, "sleep", lambda s: None)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert writers.validated_write(df, path)
    assert calls == [True, False] and writers.read_evolving(spark, path).count() == 2


def test_crash_while_folding_loses_nothing(spark, tmp_path):
    path = tmp_path / "t"
    for i in range(4):
        changes.upsert(spark.createDataFrame([(i, "a"), (0, f"v{i}")], "k int, v string"), str(path), ["k"])
    want = read(spark, str(path))
    half = path / "base=00000004"  # a fold that never finished
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"half a file")
    assert read(spark, str(path)) == want
    assert changes.fold(spark, str(path), keys=["k"]) and read(spark, str(path)) == want
    # a fold that ended before it removed what it made superfluous
    changes.upsert(spark.createDataFrame([(9, "z")], "k int, v string"), str(path), ["k"])
    before = changes._clear
    changes._clear = lambda *a: None
    try:
        assert changes.fold(spark, str(path), keys=["k"])
    finally:
        changes._clear = before
    assert read(spark, str(path)) == sorted([*want, (9, "z")])


def test_a_reader_that_listed_before_a_fold_still_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(3):
        changes.upsert(spark.createDataFrame([(i, "a")], "k int, v string"), path, ["k"])
    slow = changes.read_merged(spark, path, ["k"])
    assert changes.fold(spark, path, keys=["k"])
    assert slow.count() == 3


def test_columns_may_be_added(spark, tmp_path):
    path = str(tmp_path / "t")
    changes.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    changes.fold(spark, path, keys=["k"])
    changes.upsert(spark.createDataFrame([(2, "c", 5)], "k int, v string, w int"), path, ["k"])
    got = sorted((r.k, r.v, r.w) for r in changes.read_merged(spark, path, ["k"]).collect())
    assert got == [(1, "a", None), (2, "c", 5)]
    assert changes.read_merged(spark, str(tmp_path / "none"), ["k"]) is None


def test_small_batches_do_not_move_the_base(spark, tmp_path):
    path = str(tmp_path / "t")
    changes.publish(spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v")), path)
    changes.fold(spark, path, keys=["k"])
    changes.upsert(spark.createDataFrame([(5, "b")], "k long, v string"), path, ["k"])
    plan = changes.read_merged(spark, path, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
