from datetime import date

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from eventmill.operators import documents, writers
from eventmill.schemas import GOLD_TABLES
from eventmill.sources import tables


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_upsert_twice_equals_once(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    updates = spark.createDataFrame([(2, "B"), (3, "c"), (None, "N")], "k int, v string")
    writers.upsert(base, path, ["k"])
    want = {1: "a", 2: "B", 3: "c", None: "N"}
    for _ in range(2):
        writers.upsert(updates, path, ["k"])
        assert as_dict(writers.read_current(spark, path)) == want


def test_newest_update_wins_and_columns_may_grow(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.upsert(spark.createDataFrame([(1, "a", 0)], "k int, v string, seq int"), path, ["k"])
    updates = spark.createDataFrame([(1, "x", 1, 9.0), (1, "y", 3, 8.0), (1, "z", 2, 7.0)], "k int, v string, seq int, w double")
    writers.upsert(updates, path, ["k"], ["seq"])
    assert [tuple(r) for r in writers.read_current(spark, path).select("k", "v", "w").collect()] == [(1, "y", 8.0)]


def test_unfinished_version_is_ignored(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.upsert(spark.createDataFrame([(1, "a")], "k int, v string"), path, ["k"])
    (tmp_path / "t" / "v=00000002").mkdir()
    assert as_dict(writers.read_current(spark, path)) == {1: "a"}
    assert writers.read_current(spark, str(tmp_path / "none")) is None


def test_partition_upsert_touches_only_its_partitions(spark, tmp_path):
    path = tmp_path / "t"
    base = spark.createDataFrame([(date(2024, 1, d), k, d) for d in (1, 2) for k in "ab"], "day date, k string, v int")
    writers.upsert_partitions(base, str(path), ["day", "k"], "day")
    before = {p.name for p in (path / "day=2024-01-01").iterdir()}
    update = spark.createDataFrame([(date(2024, 1, 2), "b", 99), (date(2024, 1, 3), "a", 3)], "day date, k string, v int")
    writers.upsert_partitions(update, str(path), ["day", "k"], "day")
    assert {p.name for p in (path / "day=2024-01-01").iterdir()} == before
    got = {(str(r.day), r.k): r.v for r in spark.read.parquet(str(path)).collect()}
    assert got == {
        ("2024-01-01", "a"): 1, ("2024-01-01", "b"): 1, ("2024-01-02", "a"): 2,
        ("2024-01-02", "b"): 99, ("2024-01-03", "a"): 3,
    }


def test_validated_write_refuses_and_retries(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1,), (None,)], "k int")
    no_nulls = lambda d: F.count_if(F.col("k").isNull()) == 0
    assert not writers.validated_write(df, path, valid=no_nulls)
    assert tables.read_if_present(spark, path) is None
    assert writers.validated_write(df.na.drop(), path, valid=no_nulls)
    calls = []

    def flaky():
        calls.append("run")
        if calls.count("run") < 3:
            raise PySparkException("lost", messageParameters={})

    writers.with_retry(flaky, sleep=calls.append)
    assert calls == ["run", 1.0, "run", 2.0, "run"]
    with pytest.raises(AnalysisException):
        writers.with_retry(lambda: spark.sql("select no_such_column"), sleep=calls.append)
    assert len(calls) == 5


def test_ensure_tables_and_guarded_reads(spark, lake):
    paths = {lake.path("gold", n): s for n, s in GOLD_TABLES.items()}
    assert len(writers.ensure_tables(spark, paths)) == 4
    assert writers.ensure_tables(spark, paths) == []
    assert tables.read_if_present(spark, lake.path("gold", "customer_metrics")) is None
    assert tables.read_or_empty(spark, lake.path("gold", "nothing"), GOLD_TABLES["event_analytics"]).count() == 0
    with pytest.raises(ValueError):
        lake.path("platinum", "x")


def test_date_folders_padded_unpadded_and_missing(spark, tmp_path):
    for name, v in (("2024-01-01", 1), ("2024-1-2", 2), ("2024-01-04", 4)):
        spark.createDataFrame([(v,)], "v int").write.parquet(str(tmp_path / name / "w"))
    spark.createDataFrame([(5, "x")], "v int, extra string").write.parquet(str(tmp_path / "2024-01-05" / "w"))
    df = tables.read_date_folders(spark, str(tmp_path), "w", date(2024, 1, 1), date(2024, 1, 5))
    assert sorted((r.v, r.extra) for r in df.collect()) == [(1, None), (2, None), (4, None), (5, "x")]
    assert tables.read_date_folders(spark, str(tmp_path), "w", date(2023, 1, 1), date(2023, 1, 2)) is None


def test_compaction_keeps_rows_and_versions_expire(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_version(spark.range(1000).withColumn("k", F.col("id") % 10).repartition(6), path)
    report = writers.compact(spark, path, ["k"]).first()
    assert (report["rows"], report.files_before, report.files_after) == (1000, 6, 1)
    writers.write_version(spark.range(3), path)
    assert writers.expire_versions(spark, path, keep=1) == [1, 2]
    assert writers.read_current(spark, path).count() == 3


def test_document_ids_come_from_the_time_not_its_text(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' window_start, timestamp'2024-01-01 00:05:00' window_end, 'x' event_type, 1L n")
    row = documents.documents(df, "event_analytics").first()
    assert (row.doc_id, row.window_start) == ("1704067200_x", "2024-01-01T00:00:00Z")


def test_generated_ids_are_stable(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    now = F.current_timestamp()
    first = {r.k: r.doc_id for r in documents.generated_documents(df, now).collect()}
    again = {r.k: r.doc_id for r in documents.generated_documents(df.repartition(3), now).collect()}
    assert first == again and len(set(first.values())) == 2


def test_xml_drops_malformed_rows(spark, tmp_path):
    file = tmp_path / "a.xml"
    file.write_text("<rows><r><id>1</id></r><r><id>oops</id></r><r><id>3</id></r></rows>")
    df = tables.read_xml(spark, str(file), "r", spark.createDataFrame([], "id int").schema)
    assert sorted(r.id for r in df.collect()) == [1, 3]
