"""Cases the oracle tables don't reach: NULL partitions, second deliveries, map keys, default cuts."""

from pyspark.sql import functions as F

from eventmill import session
from eventmill.catalog.projections import CONTRACT, contract_rows, holes
from eventmill.functions.scalars import scrub_sensitive
from eventmill.operators import writers
from eventmill.plans import jobs
from eventmill.sources import nested as fixtures
from eventmill.sources import tables as scans


def test_upsert_keeps_the_null_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", "x=1/y"), (4, "d", "007")], "k int, v string, p string")
    writers.upsert_partitions(first, path, ["k"], "p")
    writers.upsert_partitions(spark.createDataFrame([(1, "A", None), (3, "C", "x=1/y")], first.schema), path, ["k"], "p")
    back = writers.read_partitions(spark, path, "p", [None, "x=1/y", "007", "none"], first.schema["p"].dataType)
    assert sorted((r.k, r.v, r.p) for r in back.collect()) == [(1, "A", None), (2, "b", None), (3, "C", "x=1/y"), (4, "d", "007")]


def test_upsert_reads_touched_partitions_only(spark, tmp_path):
    path = tmp_path / "t"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string")
    writers.upsert_partitions(rows, str(path), ["k"], "p")
    (path / "p=z").mkdir()
    (path / "p=z" / "part-0.parquet").write_bytes(b"no parquet")
    writers.upsert_partitions(rows.filter("k = 1"), str(path), ["k"], "p")
    assert spark.read.parquet(str(path / "p=a"), str(path / "p=b")).count() == 2


def test_masking_reaches_map_values(spark):
    data = [({"user": "someone", "PassWord": "secret99", "note": None}, [{"token": 5, "n": 6}])]
    df = spark.createDataFrame(data, "event_data map<string,string>, parts array<map<string,int>>")
    row = scrub_sensitive(df).first()
    assert row.event_data == {"user": "someone", "PassWord": "***et99", "note": None}
    assert row.parts == [{"token": None, "n": 6}]


def test_bronze_scan_has_no_default_cut(spark):
    df = spark.range(1500).select(F.lit("a").alias("event_type"))
    assert scans.read_bronze(df, "a").count() == 1500
    assert scans.read_bronze(df, "a", limit=1000).count() == 1000


def test_second_delivery_adds_to_the_lookups(tables, lake):
    records = fixtures.traffic_records(tables)
    half = F.abs(F.xxhash64("headersession.SessionIndex")) % 2
    now = F.lit("2024-02-01").cast("timestamp")
    for k in (0, 1):
        jobs.traffic_ingest(lake, records.filter(half == k), now)
    stored = writers.read_current(lake.spark, lake.path("bronze", "TrafficLookup"))
    from eventmill.operators.nested import traffic_lookups

    want = {tuple(r) for r in traffic_lookups(records).select("lookupType", "lookupValue").collect()}
    assert {tuple(r) for r in stored.select("lookupType", "lookupValue").collect()} == want


def test_contract_results_replace_each_other(tables, lake):
    now = F.lit("2024-02-01").cast("timestamp")
    rows = contract_rows(tables)
    half = F.abs(F.xxhash64("id")) % 2
    for k in (0, 1):
        jobs.contract_ingest(lake, rows.filter(half == k), CONTRACT, "sales", "orders", now)
    bronze = lake.spark.read.parquet(lake.path("bronze", "sales_orders")).count()
    assert lake.spark.read.parquet(lake.path("gold", "sales_orders_by_kind")).agg(F.sum("n")).first()[0] == bronze


def test_event_ingest_counts_its_own_batch(spark, tables, lake):
    events = holes(tables).limit(50)
    for day in ("2024-02-01", "2024-02-02"):
        counts = jobs.event_ingest(lake, events, f"job-{day}", F.lit(day).cast("timestamp"))
        assert {r.event_type: r["count"] for r in counts.collect()}["total"] == 50


def test_staged_tables_are_discarded_by_application(spark):
    kept = dict(session._staged)
    session._staged.clear()
    try:
        df = session.stage(spark.range(3), "tests")
        session._staged["another application"] = ["/nowhere"]
        assert df.count() == 3
        assert session.discard_staged(spark) == 1
        assert session._staged == {"another application": ["/nowhere"]}
    finally:
        session._staged.clear()
        session._staged.update(kept)


def test_stored_times_prune(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_table(spark.range(5).select(F.timestamp_seconds("id").alias("ts")), path)
    import pyarrow.dataset as ds

    file = next(ds.dataset(path).get_fragments())
    assert "INT64" in str(file.metadata.schema.column(0).physical_type)


def test_first_seen_table_equals_the_whole_history(spark, tables, lake):
    from eventmill.operators import rollups

    segments = tables.raw("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))
    for day in ("2024-01-02", "2024-01-03", "2024-01-03", "2024-01-06", "2024-01-03"):
        start, end = F.lit(day).cast("timestamp"), F.lit(f"{day} 12:00:00").cast("timestamp")
        jobs.window_aggregation(lake, tables.events, tables.campaigns, segments, start, end, start)
        got = spark.read.parquet(lake.path("gold", "customer_metrics")).filter(F.col("window_start") == start)
        want = rollups.window_customer_metrics(tables.events, start, end, start)
        assert [tuple(r) for r in got.select(*want.columns).collect()] == [tuple(r) for r in want.collect()]
    seen = jobs.first_seen_table(lake)
    everyone = tables.events.filter(F.col("customer_id").isNotNull())
    assert seen.count() == everyone.select("customer_id").distinct().count()


EVENT = "event_id long, customer_id long, event_type string, value double, event_ts timestamp, came timestamp, device_type string"


def _at(text):
    from datetime import datetime

    return datetime.fromisoformat(f"2024-01-01 {text}")


def _run(spark, tables, lake, data, start, end, ingested):
    events = spark.createDataFrame(data, EVENT)
    segments = spark.createDataFrame([(7, "a")], "customer_id long, segment string")
    bounds = [F.lit(_at(x)) for x in (start, end)]
    jobs.window_aggregation(lake, events, tables.campaigns, segments, *bounds, bounds[1], ingested=ingested)
    rows = spark.read.parquet(lake.path("gold", "customer_metrics")).collect()
    return {r.window_start.strftime("%H:%M"): r.new_customers for r in rows}


def test_late_events_mend_new_customers(spark, tables, lake):
    for ingested in (None, "came"):
        own = scans.Lake(spark, f"{lake.base}/{ingested}")
        data = [
            (1, 5, "view", 1.0, _at("10:01"), _at("10:01"), "m"),
            (2, 7, "view", 1.0, _at("10:06"), _at("10:06"), "m"),
            (3, 8, "view", 1.0, _at("10:07"), _at("10:07"), "m"),
        ]
        assert _run(spark, tables, own, data[:1], "10:00", "10:04:59", ingested) == {"10:00": 1}
        # customer 7 came in first at 10:02, which is only known after that window was run
        data.append((4, 7, "view", 1.0, _at("10:02"), _at("10:08"), "m"))
        assert _run(spark, tables, own, data, "10:05", "10:09:59", ingested) == {"10:00": 2, "10:05": 1}
        # and customer 8 only after both
        data.append((5, 8, "view", 1.0, _at("10:03"), _at("10:12"), "m"))
        got = _run(spark, tables, own, data, "10:10", "10:14:59", ingested)
        assert got == {"10:00": 3, "10:05": 0, "10:10": 0}
        assert _run(spark, tables, own, data, "10:05", "10:09:59", ingested) == got
        seen = {r.customer_id: r.first_seen for r in jobs.first_seen_table(own).collect()}
        assert seen == {5: _at("10:01"), 7: _at("10:02"), 8: _at("10:03")}


def test_first_seen_folders_are_bounded(spark, tables, lake, monkeypatch):
    monkeypatch.setattr(jobs, "FOLD_AFTER", 3)
    data = []
    for k in range(9):
        data.append((k, 100 + k, "view", 1.0, _at(f"10:{k:02d}"), _at(f"10:{k:02d}"), "m"))
        _run(spark, tables, lake, data, f"10:{k:02d}", f"10:{k:02d}:59", "came")
    from eventmill.sources.files import child_dirs

    names = child_dirs(spark, lake.path("gold", "customer_first_seen"))
    assert sum(n.startswith(("batch_key=", "base=")) for n in names) <= 2 * 3 + 2
    assert jobs.first_seen_table(lake).count() == 9
