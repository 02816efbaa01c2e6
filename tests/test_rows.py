"""Parsing, enrichment, contracts, quality on hand-written edge rows."""

from datetime import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventmill.functions import scalars
from eventmill.operators import batchlog, contracts, enrich, marts, nested, parse, quality, service
from eventmill.schemas import CUSTOMER_BEHAVIOR, contract_schema

NOW = datetime(2024, 1, 31)


def one(spark, value, kind, fn):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(fn(F.col("x")).alias("y")).first().y


def test_lenient_timestamps(spark):
    texts = {
        "2025-11-16T10:00:00.1": datetime(2025, 11, 16, 10, 0, 0, 100000),
        "2025-11-16 10:00:00": datetime(2025, 11, 16, 10),
        "2025-11-16T10:00:00Z": datetime(2025, 11, 16, 10),
        "2025-11-16T12:00:00+02:00": datetime(2025, 11, 16, 10),
        "1763287200000": datetime(2025, 11, 16, 10),
        "junk": None,
        "": None,
        None: None,
    }
    for text, want in texts.items():
        assert one(spark, text, "string", lambda c: F.date_format(scalars.lenient_timestamp(c), "yyyy-MM-dd HH:mm:ss.SSS")) == (
            want.strftime("%Y-%m-%d %H:%M:%S.%f")[:-3] if want else None
        )


def test_labels_and_masks(spark):
    assert one(spark, 7.4, "double", lambda c: scalars.range_label(c, 5)) == "5 - 10"
    assert one(spark, -1.0, "double", lambda c: scalars.range_label(c, 5)) == "-5 - 0"
    assert one(spark, 1234567, "long", scalars.millions_label) == "1.235M"
    assert one(spark, 1234567, "long", scalars.millions_range_label) == "1.23M - 1.235M"
    assert [one(spark, v, "long", scalars.short_number) for v in (999, 1500, 2500000)] == ["999", "1.5K", "2.5M"]
    assert [one(spark, v, "string", scalars.mask) for v in ("123", "1234", "12345", None)] == ["***", "****", "*2345", None]


def test_malformed_json_keeps_its_text(spark):
    rows = spark.createDataFrame([('{"customer_id": 5}',), ('{"customer_id": ',), (None,)], "raw string")
    parsed = parse.parse_payload(rows, "raw", CUSTOMER_BEHAVIOR, [])
    good, bad = parse.split_corrupt(parsed)
    assert [r.customer_id for r in good.collect()] == [5, None]
    assert [r["_corrupt_record"] for r in bad.collect()] == ['{"customer_id": ']


def test_routing_of_unknown_types(spark):
    assert [one(spark, v, "string", parse.route) for v in ("transaction", "x", None)] == [
        "transaction-events", "analytics-events", "analytics-events",
    ]
    assert one(spark, "x", "string", lambda c: parse.route(c, "unknown")) == "unknown"


def test_defaults_and_required(spark):
    df = spark.createDataFrame([("a", None), ("", NOW), (None, NOW)], "event_type string, timestamp timestamp")
    assert [r.event_type for r in enrich.fill_defaults(df, F.lit(NOW)).collect()] == ["a", "unknown", "unknown"]
    assert enrich.require(df, ["event_type", "absent"]).count() == 1
    assert enrich.require(df, []).count() == 3


def test_names_and_text(spark):
    df = spark.createDataFrame([(1, None, [1, 2])], "` 'a'` int, b string, c array<int>")
    clean = enrich.clean_names(df)
    assert clean.columns == ["a", "b", "c"]
    assert tuple(enrich.stringify(clean).first()) == ("1", "", "[1,2]")


def test_changed_fields_are_null_safe(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "id int, x string, y int")
    new = spark.createDataFrame([(1, "a", None), (2, None, 1), (3, "n", 1)], "id int, x string, y int")
    rows = enrich.changed_fields(old, new, "id").collect()
    assert [(r.id, r.updated_fields) for r in rows] == [(2, ["x"])]
    assert rows[0].changes["x"] == Row(old_value="b", new_value=None)


def test_partition_choice():
    assert enrich.partition_columns("any", ["InsertionTime"]) == ["year", "month"]
    assert enrich.partition_columns("any", ["date"]) == ["date"]
    assert enrich.partition_columns("traffic_data", ["region"]) == ["region"]
    assert enrich.partition_columns("other", ["x"]) == []


def test_incidents_without_children_and_unmapped_states(spark):
    schema = (
        "PrimaryFileName string, InsertionTime long, IncidentFiles array<struct<FileName:string>>, "
        "incidentHistories array<struct<IncidentState:string,ServiceName:string,ServerName:string,FailType:string>>"
    )
    df = spark.createDataFrame(
        [("p1", 0, [("f",)], [("Open", "s", "", None), ("Odd", "s", "h", "t")]), ("p2", 0, [], None)], schema
    )
    assert nested.incident_files(df).count() == 1
    history = nested.incident_history(df, {"Open": ("C", "P")}).collect()
    assert [(r.Category, r.ProcessType) for r in history] == [("C", "P"), ("UNMAPPED_Odd", "UNMAPPED_Odd")]
    pairs = {tuple(r) for r in nested.incident_lookups(df).collect()}
    assert pairs == {
        ("PrimaryFileName", "p1"), ("PrimaryFileName", "p2"), ("ServiceName", "s"), ("ServerName", "h"), ("FailType", "t"),
    }


def test_passage_times(spark):
    schema = (
        "headersession struct<SessionIndex:string,SystemName:string,Location0:string,Location1:string,Location2:string,"
        "SessionStart:string,SessionEnd:string>, trafficDataList array<struct<PassageTime:string,ImportTime:string,VehicleClass:string>>"
    )
    head = ("s", "dev", "l", None, None, "2024-01-01 00:00:00", None)
    rows = [("2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "car"), ("1704164645000", None, "bus"), ("junk", "junk", "van"), (None, None, "x")]
    got = nested.passages(spark.createDataFrame([(head, rows)], schema), F.lit(NOW)).collect()
    now = 1706659200000
    assert [r.PassageTime for r in got] == [1704164645000, 1704164645000, now, now]
    assert [r.ImportTime for r in got] == [1704164645000, None, now, None]
    assert (got[0].DeviceIndex, got[0].Location1, got[0].hour, got[0].minute) == ("dev", "", 3, 4)


CONTRACT = {
    "schema": {"fields": [{"name": "id", "type": "long"}, {"name": "at", "ms": True}, {"name": "n", "type": "integer"}]},
    "quality_rules": {"required": ["id", "missing"]},
}


def test_contract_rows(spark):
    assert contract_schema(CONTRACT, raw=True)["at"].dataType == T.StringType()
    assert contract_schema(CONTRACT)["at"].dataType == T.LongType()
    values = ['{"id":1,"at":"2024-01-01T00:00:00Z","n":2}', '{"at":"x"}', '{"id":3,"at":"x","InsertionTime":0}', "bad"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    rows = contracts.apply_contract(df, CONTRACT, F.lit(NOW)).orderBy("id").collect()
    assert [(r.id, r["at"], r.year, r.day) for r in rows] == [(1, 1704067200000, 2024, 31), (3, None, 1970, 1)]


def test_source_name_is_bound_outside_quotes(spark):
    sql = """select 'src' as s, "src" as t, src.k, {x} from src where `src` = 1 and k in (select k from SRC src)"""
    assert contracts.bind_source(sql).count("{src}") == 2 or "from {src}" in contracts.bind_source(sql)
    df = spark.createDataFrame([(1,), (2,)], "k int")
    out = contracts.run_aggregation(df, "select 'src' as tag, count(*) as n from src where k > 1")
    assert tuple(out.first()) == ("src", 1)
    joined = contracts.run_aggregation(df, "select a.k from src a join src b on a.k = b.k")
    assert joined.count() == 2


def test_failing_aggregation_is_reported(spark):
    df = spark.createDataFrame([(1,)], "k int")
    done = []
    spec = {"aggregations": [{"name": "bad", "sql": "select z from src"}, {"name": "good", "sql": "select k from src"}, {"name": "none"}]}
    results = contracts.run_aggregations(df, "t", spec, lambda target, d: done.append((target, d.count())))
    assert [(r["name"], r["status"]) for r in results] == [("bad", "error"), ("good", "success")]
    assert done == [("t_good", 1)]


def test_quality_of_empty_and_bad_tables(spark):
    empty = spark.createDataFrame([], "a int, m map<string,int>")
    row = quality.quality_report(empty, "t").first()
    assert (row.total_records, row.quality_score, row.passed, row.warnings) == (0, 1.0, True, ["empty dataset"])
    bad = spark.createDataFrame([(None, {"x": 1})] * 50, "a int, m map<string,int>")
    row = quality.quality_report(bad, "t", [quality.Rule("a known", F.col("a").isNull())]).first()
    assert row.duplicate_count == 49 and not row.passed
    assert abs(row.quality_score - 0.9 * 0.8 * 0.85) < 1e-9
    report = quality.validate_batch(bad, "t", T.StructType([T.StructField("a", T.IntegerType(), False)])).first()
    assert report.schema_issues == ["field count: expected 1, got 2", "nullability of a: expected not null", "unexpected field: m"]
    assert report.recommendations[0].startswith("fix the schema") and not report.overall_passed


def test_rates_with_zero_views_and_null_amounts(spark):
    rows = [(1, 1, "purchase", NOW, None, "p"), (2, 1, "purchase", NOW, 5.0, "p"), (3, None, "add_to_cart", NOW, None, None)]
    df = spark.createDataFrame(rows, "event_id long, customer_id long, event_type string, event_ts timestamp, amount double, product_id string")
    row = marts.product_analytics(df).first()
    assert (row.views, row.purchases, row.revenue, row.conversion_rate, row.cart_conversion_rate) == (0, 2, 5.0, None, None)
    counts = {r.event_type: r["count"] for r in service.event_type_counts(df).collect()}
    assert counts == {"purchase": 2, "add_to_cart": 1, "total": 3}


def test_union_of_disjoint_windows_is_the_whole(spark, tables):
    from eventmill.operators import rollups

    e = tables.events
    lo, hi = e.agg(F.min("event_ts"), F.max("event_ts")).first()
    mid = lo + (hi - lo) / 2
    parts = [rollups.window_event_analytics(e.filter(F.col("event_ts") <= F.lit(mid)), lo, hi, hi)]
    parts.append(rollups.window_event_analytics(e.filter(F.col("event_ts") > F.lit(mid)), lo, hi, hi))
    whole = {r.event_type: r.event_count for r in rollups.window_event_analytics(e, lo, hi, hi).collect()}
    split = {r.event_type: r.n for r in parts[0].union(parts[1]).groupBy("event_type").agg(F.sum("event_count").alias("n")).collect()}
    assert split == whole


def test_running_averages_skip_unfinished_batches(spark):
    rows = [(1, "t", 10, NOW, NOW), (2, "t", 20, NOW, None), (3, "t", 30, NOW, NOW)]
    df = spark.createDataFrame(
        rows, "batch_id long, table_name string, record_count long, processing_start timestamp, processing_end timestamp"
    )
    got = {r.batch_id: r.average_batch_size for r in batchlog.running_batch_averages(df).collect()}
    assert got == {1: 10.0, 3: 20.0}


def test_customer_360_keeps_the_null_customer_and_counts_ids_once(spark):
    rows = [
        (1, None, "purchase", NOW, 5.0, "p", "s", "mobile"),
        (1, None, "purchase", NOW, 5.0, "p", "s", "mobile"),
        (2, None, "page_view", NOW, None, None, "s", None),
        (3, 7, "error", NOW, None, None, None, None),
    ]
    df = spark.createDataFrame(
        rows,
        "event_id long, customer_id long, event_type string, event_ts timestamp, amount double, product_id string, "
        "session_id string, device_type string",
    )
    got = {r.customer_id: r for r in marts.customer_360(df, F.lit(NOW)).collect()}
    assert (got[None].total_events, got[None].purchases, got[None].page_views, got[None].total_spent) == (3, 1, 1, 10.0)
    assert (got[None].devices_used, got[None].purchase_frequency) == (["mobile"], 1.0)
    assert (got[7].purchases, got[7].page_views, got[7].devices_used, got[7].avg_order_value) == (0, 0, [], None)
