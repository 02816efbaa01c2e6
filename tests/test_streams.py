"""Streams over several files against their batch twins."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventmill.session import ROCKSDB_PROVIDER
from eventmill.sources import nested as fixtures
from eventmill.streaming import keyed, medallion, sessions, sinks, sources, windows

SCHEMA = "event_id long, customer_id long, action string, device_type string, category string, value double, event_timestamp timestamp"
BASE = datetime(2024, 1, 1)


def rows(n, step=7, hot=3):
    return [
        (i, 1 if i % hot == 0 else i % 50, "view" if i % 2 else "buy", "mobile", "c", float(i % 9), BASE + timedelta(seconds=i * step))
        for i in range(n)
    ]


def write_files(spark, path, parts):
    """One file per part; modification order is the order of the batches."""
    import os
    import time

    for i, part in enumerate(parts):
        one = f"{path}/_{i}"
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(one)
        file = next(f for f in os.listdir(one) if f.endswith(".parquet"))
        os.makedirs(f"{path}/in", exist_ok=True)
        target = f"{path}/in/{i:03d}.parquet"
        os.link(f"{one}/{file}", target)
        os.utime(target, (time.time() - 1000 + i, time.time() - 1000 + i))
    return f"{path}/in"


def as_set(df):
    cols = sorted(df.columns)
    return {tuple(r) for r in df.select(*cols).collect()}


@pytest.fixture
def in_order(spark, tmp_path):
    data = rows(900)
    parts = [data[i : i + 225] for i in range(0, 900, 225)]
    return write_files(spark, str(tmp_path), parts), spark.createDataFrame(data, SCHEMA)


def stream(spark, path):
    return sources.table_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)


def test_published_updates_equal_the_batch(spark, in_order, tmp_path):
    files, batch = in_order
    metric = windows.customer_metrics()
    path = str(tmp_path / "out")
    q = windows.publish_metrics(stream(spark, files), metric, path, str(tmp_path / "cp"), None)
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 4
    assert as_set(windows.read_gold(spark, path, metric)) == as_set(windows.batch_metrics(batch, metric))


def test_append_equals_the_closed_windows(spark, in_order, tmp_path):
    files, batch = in_order
    metric = windows.customer_metrics()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    out = str(tmp_path / "out")
    sinks.append_stream(windows.append_metrics(stream(spark, files), metric), out, str(tmp_path / "cp"), None).awaitTermination()
    closed = batch.agg(F.max("event_timestamp")).first()[0] - timedelta(minutes=10)
    want = windows.batch_metrics(batch, metric).filter(F.col("window_end") <= F.lit(closed))
    assert want.count() > 0
    assert as_set(spark.read.parquet(out)) == as_set(want)


def test_chained_minutes_equal_the_closed_minutes(spark, in_order, tmp_path):
    files, batch = in_order
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    out = str(tmp_path / "out")
    minutes = windows.append_minute_totals(stream(spark, files))
    sinks.append_stream(minutes, out, str(tmp_path / "cp"), None).awaitTermination()
    got = {r.window_start: r.total_events_per_minute for r in spark.read.parquet(out).collect()}
    closed = batch.agg(F.max("event_timestamp")).first()[0] - timedelta(seconds=30)
    want = batch.groupBy(F.window("event_timestamp", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    want = {r.w.start: r.n for r in want.collect() if r.w.end <= closed}
    assert got == {k: v for k, v in want.items() if k in got}
    assert len(want) - len(got) <= 1 and len(got) > 50


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    late = [(9999, 5, "view", "mobile", "c", 1.0, BASE)]
    files = write_files(spark, str(tmp_path), [rows(300), rows(10, 1) and [(500, 2, "view", "mobile", "c", 1.0, BASE + timedelta(hours=2))], late])
    path = str(tmp_path / "out")
    q = windows.publish_metrics(stream(spark, files), windows.customer_metrics(), path, str(tmp_path / "cp"), None)
    q.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    assert dropped == 1
    assert windows.read_gold(spark, path, windows.customer_metrics()).agg(F.sum("event_count")).first()[0] == 301


def test_a_second_run_continues_from_the_checkpoint(spark, in_order, tmp_path):
    files, batch = in_order
    metric = replace(windows.customer_metrics(), round_to={})
    path, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):
        windows.publish_metrics(stream(spark, files), metric, path, cp, None).awaitTermination()
    assert windows.read_gold(spark, path, metric).agg(F.sum("event_count")).first()[0] == batch.count()


def test_repeated_batch_replaces_itself(spark, tmp_path):
    handle = sinks.append_batches(str(tmp_path / "out"), ["action"])
    df = spark.createDataFrame(rows(20), SCHEMA)
    for _ in range(2):
        handle(df, 0)
    handle(df, 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_a_batch_is_written_without_sorting_it(spark, tmp_path, monkeypatch):
    """A few partitions are open side by side; more than these give the same rows."""
    from pyspark.sql import DataFrameWriter

    write, seen = DataFrameWriter.parquet, []

    def watched(self, path, *args, **kwargs):
        seen.append(int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")))
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    df = spark.createDataFrame(rows(200), SCHEMA).coalesce(1)
    for column in ("action", "value"):  # two and nine values
        sinks.append_batches(str(tmp_path / column), [column])(df, 0)
        found = spark.read.parquet(str(tmp_path / column))
        assert sorted(map(str, found.select("event_id", "customer_id", column).collect())) == sorted(
            map(str, df.select("event_id", "customer_id", column).collect())
        )
    assert seen == [sinks.OPEN_PARTITIONS] * 2 and min(seen) > 1
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_a_batch_is_as_many_files_as_its_rows_need(spark, tmp_path):
    from eventmill.catalog.streams import batch_files

    messages = spark.range(4000).select(F.col("id").alias("offset"), F.lit("x").alias("value"))
    for most, files in ((10_000, 1), (1000, 1), (200, 5)):
        path = f"{tmp_path}/in{most}"
        assert batch_files(messages, path, 4, most) == files
        sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
        assert len(sizes) == 4 * files and sum(sizes) == 4000 and max(sizes) < 1.5 * 1000 / files
    assert batch_files(messages.limit(0), f"{tmp_path}/none", 4, 10) == 1


def test_a_new_checkpoint_keeps_older_rows(spark, tmp_path):
    files = write_files(spark, str(tmp_path), [rows(30)])
    out = str(tmp_path / "out")
    for cp in ("a", "b"):
        handle = sinks.append_batches(out, ["action"])
        sinks.batch_stream(stream(spark, files), handle, str(tmp_path / cp), None, mode="append").awaitTermination()
    assert spark.read.parquet(out).count() == 60
    assert spark.read.parquet(out).select("stream_id").distinct().count() == 2


def test_what_a_batch_writes_does_not_grow(spark, tmp_path):
    """Customers that come back all day: each batch writes the windows it touches, and no state."""
    data = rows(1600, step=1)
    files = write_files(spark, str(tmp_path), [data[i : i + 200] for i in range(0, 1600, 200)])
    metric, path = windows.customer_metrics(), tmp_path / "out"
    wide = replace(metric, width="1 day")
    windows.publish_metrics(stream(spark, files), wide, str(path), str(tmp_path / "cp"), None).awaitTermination()
    sizes = {}
    for folder in sorted(path.iterdir()):
        n = spark.read.parquet(str(folder)).count()
        sizes[folder.name] = (n, sum(f.stat().st_size for f in folder.glob("*.parquet")))
    full = [v for v in sizes.values() if v[0]]
    assert len(full) == 8 and {n for n, _ in full} == {2}
    assert full[-1][1] < 1.5 * full[0][1]
    batch = spark.createDataFrame(data, SCHEMA)
    assert as_set(windows.read_gold(spark, str(path), wide)) == as_set(windows.batch_metrics(batch, wide))


def test_folded_metrics_stay_the_same_and_go_on(spark, in_order, tmp_path):
    files, batch = in_order
    metric, path, cp = windows.realtime_metrics(), str(tmp_path / "out"), str(tmp_path / "cp")
    windows.publish_metrics(stream(spark, files), metric, path, cp, None).awaitTermination()
    want = as_set(windows.batch_metrics(batch, metric))
    assert as_set(windows.read_gold(spark, path, metric)) == want
    assert windows.fold_metrics(spark, path, metric) and not windows.fold_metrics(spark, path, metric)
    assert as_set(windows.read_gold(spark, path, metric)) == want
    more = [(9000 + i, 3, "view", "mobile", "c", 1.0, BASE + timedelta(hours=3, seconds=i)) for i in range(50)]
    write_files(spark, str(tmp_path / "more"), [more])
    import os

    os.link(tmp_path / "more" / "in" / "000.parquet", f"{files}/900.parquet")
    windows.publish_metrics(stream(spark, files), metric, path, cp, None).awaitTermination()
    both = batch.unionByName(spark.createDataFrame(more, SCHEMA))
    assert as_set(windows.read_gold(spark, path, metric)) == as_set(windows.batch_metrics(both, metric))


def test_typed_bronze_and_registry(spark, tables, lake):
    path = f"{lake.base}/messages"
    fixtures.envelope(tables.events).write.parquet(path)
    medallion.create_folders(lake, "bronze", list(medallion.TYPED_TOPICS))
    registry = sinks.QueryRegistry(spark)
    for name, q in medallion.typed_bronze_tables(lake, sources.event_stream(spark, "files", path), None).items():
        registry.add(name, q)
    registry.wait()
    status = registry.status()
    registry.stop()
    assert {s["active"] for s in status.values()} == {False}
    total = sum(spark.read.parquet(lake.path("bronze", t)).count() for t in [*medallion.TYPED_TOPICS, "rejected"])
    assert total == tables.events.count()


def test_continuous_medallion_reaches_gold(spark, tables, lake, monkeypatch):
    from eventmill.plans import jobs

    for name in ("RAW_BRONZE", "SILVER", "GOLD", "EVENT_RATE"):
        monkeypatch.setattr(sinks, name, "1 second")
    path = f"{lake.base}/messages"
    fixtures.envelope(tables.events).write.parquet(path)
    registry = jobs.start_medallion(lake, sources.event_stream(spark, "files", path))
    try:
        for name in ("raw_events", *medallion.SILVER_TABLES, "rejected", "customer_metrics", "transaction_metrics", "event_rates"):
            registry.queries[name].processAllAvailable()
        assert all(s["active"] for s in registry.status().values())
    finally:
        registry.stop()
    n = tables.events.count()
    assert spark.read.parquet(lake.path("bronze", "raw_events")).count() == n
    assert sum(spark.read.parquet(lake.path("silver", t)).count() for t in [*medallion.SILVER_TABLES, "rejected"]) == n
    rates = windows.read_gold(spark, lake.path("gold", "event_rates"), windows.event_rate())
    assert rates.agg(F.sum("event_count")).first()[0] == n
    assert windows.read_gold(spark, lake.path("gold", "customer_metrics"), windows.customer_metrics()).count() > 0


def _moments(*seconds, key=1):
    return [(i, key, "view", "mobile", "c", 1.0, BASE + timedelta(seconds=s)) for i, s in enumerate(seconds)]


def _sessions(spark, tmp_path, parts, gap, delay="1 hour"):
    files = write_files(spark, str(tmp_path), parts)
    events = stream(spark, files).withColumn("event_ts", F.col("event_timestamp"))
    made = {"n": F.count("*"), "last": F.max("event_ts")}
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    rows = sessions.windowed_sessions(events, ["customer_id"], gap, made, delay)
    sessions.publish_sessions(rows, out, cp, None).awaitTermination()
    tell = lambda df: sorted((r.customer_id, (r.starts - BASE).seconds, (r.ends - BASE).seconds, r.n) for r in df.collect())
    live = sessions.open_sessions(spark, cp, ["customer_id"], list(made))
    return tell(spark.read.schema(rows.schema).parquet(out)), tell(live)


def test_a_late_event_joins_two_sessions(spark, tmp_path):
    closed, live = _sessions(spark, tmp_path, [_moments(0, 100), _moments(3000), _moments(1500), _moments(9000, key=2)], "1800 seconds")
    assert live == [(2, 9000, 10800, 1)]
    assert closed == [(1, 0, 4800, 4)]


@pytest.mark.parametrize("ttl", [keyed.TTL_EVENT, keyed.TTL_LATEST, keyed.TTL_METRICS])
def test_counters_live_until_their_time(spark, tmp_path, ttl):
    """Each event renews the counter; the first after its time starts a new one."""
    first = _moments(0, ttl - 1, 2 * ttl - 2)
    again = _moments(3 * ttl, 3 * ttl + 1)
    closed, live = _sessions(spark, tmp_path, [first, again, _moments(3 * ttl + 2)], f"{ttl} seconds", "0 seconds")
    assert closed == [(1, 0, 3 * ttl - 2, 3)]
    assert live == [(1, 3 * ttl, 4 * ttl + 2, 3)]


def test_every_message_is_kept_once(spark, tables, lake):
    from eventmill.catalog.streams import spoiled

    path = f"{lake.base}/messages"
    spoiled(fixtures.envelope(tables.events)).write.parquet(path)
    medallion.raw_bronze(lake, sources.event_stream(spark, "files", path, ["customer-events", "transaction-events", "analytics-events", "other-topic"]), None).awaitTermination()
    for q in medallion.silver_tables(lake, None).values():
        q.awaitTermination()
    rejected = spark.read.parquet(lake.path("silver", "rejected"))
    good = [spark.read.parquet(lake.path("silver", t)) for t in medallion.SILVER_TABLES]
    assert rejected.count() + sum(g.count() for g in good) == tables.events.count()
    assert {r.reason for r in rejected.select("reason").distinct().collect()} == {"empty", "malformed_json", "no_known_field", "unknown_topic"}
    raw = {r.offset: r.raw_data for r in spark.read.parquet(lake.path("bronze", "raw_events")).collect()}
    assert all(raw[r.offset] == r.raw_data for r in rejected.collect())
    for g in good:
        payload = [c for c in g.columns if c not in ("kafka_timestamp", "processing_timestamp", "date_partition", "event_timestamp")]
        assert g.filter(F.coalesce(*[F.col(c).cast("string") for c in payload]).isNull()).count() == 0


def test_sources_by_type(spark):
    with pytest.raises(ValueError):
        sources.event_stream(spark, "socket")
    assert sources.event_stream(spark, "rate").isStreaming
    options = sources.kafka_options("h:1", ["a", "b"], sources.FAST_RECORDS_PER_TRIGGER, **sources.FAST_OPTIONS)
    assert options["subscribe"] == "a,b" and options["maxOffsetsPerTrigger"] == "10000"


def test_request_limits_hot_identifier(spark):
    data = [(i, BASE + timedelta(milliseconds=i * 10), "user:1" if i % 3 == 0 else f"ip:{i % 5}", "/x") for i in range(9000)]
    data.append((9001, BASE, "ip:9", "/upload/a"))
    df = spark.createDataFrame(data, "request_id long, ts timestamp, identifier string, path string").repartition(6)
    limits = keyed.RequestLimits(keyed.LIMITS)
    got = {r.request_id: (r.n, r.allowed, r.remaining) for r in keyed.check_requests(df, limits).collect()}
    seen = {}
    for i, ts, who, path in sorted(data, key=lambda d: (d[1], d[0])):
        slot = (who, int((ts - BASE).total_seconds()) // 60)
        seen[slot] = n = seen.get(slot, 0) + 1
        cap = 1000 if who.startswith("user:") else 100
        cap = min(cap, 10) if path.startswith("/upload") else cap
        assert got[i] == (n, n <= cap, max(0, cap - n))


def test_counters_expire(spark):
    df = spark.createDataFrame([("a", BASE), ("b", BASE - timedelta(seconds=61))], "event_type string, ts timestamp")
    assert [r.event_type for r in keyed.alive(df, "ts", F.lit(BASE), keyed.TTL_LATEST).collect()] == ["a"]
