"""Queries: whole jobs; each runs end to end and its tables are read back."""

from pyspark.sql import functions as F

from eventmill.catalog.marts import DAILY
from eventmill.catalog.projections import BAD, CONTRACT, CROWS, HOLES, LOOK, TOPIC, TREC, contract_rows, holes
from eventmill.catalog.registry import ctes, register, rounded
from eventmill.catalog.rollups import EVN, TXN, day_window
from eventmill.functions.scalars import latest
from eventmill.operators import changes, documents, rollups, writers
from eventmill.plans import jobs
from eventmill.schemas import SOURCE_TABLES
from eventmill.session import shared_dir
from eventmill.sources import nested as fixtures
from eventmill.sources.canonical import Tables
from eventmill.sources.tables import Lake
from eventmill.streaming import medallion, sources, windows


def lake(t, label):
    return Lake(t.spark, shared_dir(t.spark, label))


def _now(t):
    return latest(t.raw("events"), "ts")


def _counts(lk, names, layer, reader=None):
    reader = reader or (lambda p: lk.spark.read.parquet(p))
    out = None
    for n in names:
        line = reader(lk.path(layer, n)).agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows")
        out = line if out is None else out.unionByName(line)
    return out


@register(
    "job1_streaming_medallion",
    ctes(
        "ev",
        f"""SELECT 'raw_events' AS table_name, count(*) AS rows FROM ev
UNION ALL SELECT 'customer_events', count(*) FROM ev WHERE {TOPIC} = 'customer-events' AND NOT {BAD}
UNION ALL SELECT 'transaction_events', count(*) FROM ev WHERE {TOPIC} = 'transaction-events' AND NOT {BAD}
UNION ALL SELECT 'analytics_events', count(*) FROM ev WHERE {TOPIC} = 'analytics-events' AND NOT {BAD}
UNION ALL SELECT 'customer_metrics', count(*) FROM (SELECT DISTINCT time_bucket(INTERVAL 5 MINUTE, event_ts), event_type, device_type FROM ev
  WHERE {TOPIC} = 'customer-events' AND NOT {BAD})
UNION ALL SELECT 'transaction_metrics', count(*) FROM (SELECT DISTINCT time_bucket(INTERVAL 5 MINUTE, event_ts), least(event_id % 5, 2), category FROM ev
  WHERE {TOPIC} = 'transaction-events' AND NOT {BAD})
UNION ALL SELECT 'event_rates', sum(event_count)::BIGINT FROM (SELECT count(*) AS event_count FROM ev)
UNION ALL SELECT 'customer_behavior', count(*) FROM ev WHERE {TOPIC} = 'customer-events' AND NOT {BAD}
UNION ALL SELECT 'transactions', count(*) FROM ev WHERE {TOPIC} = 'transaction-events' AND NOT {BAD}
UNION ALL SELECT 'analytics_metrics', count(*) FROM ev WHERE {TOPIC} = 'analytics-events' AND NOT {BAD}
UNION ALL SELECT 'rejected', count(*) FROM ev WHERE {BAD}
UNION ALL SELECT 'realtime_metrics', count(*) FROM ev WHERE {TOPIC} = 'customer-events' AND NOT {BAD}
UNION ALL SELECT 'dashboard_metrics', count(*) FROM ev WHERE {TOPIC} = 'customer-events' AND NOT {BAD}""",
    ),
)
def _(t):
    """Rows of the tables; of rates, real-time metrics and dashboard, the events they add up to."""
    lk = lake(t, "job1")
    raw = sources.table_stream(t.spark, t.path("events"), SOURCE_TABLES["events"])
    jobs.start_medallion(lk, fixtures.envelope(Tables.to_events(raw)), continuous=False).stop()
    parts = _counts(lk, ["raw_events"], "bronze").union(_counts(lk, [*medallion.SILVER_TABLES, "rejected"], "silver"))
    parts = parts.union(_counts(lk, list(medallion.TYPED_TOPICS), "bronze"))
    metrics = {"customer_metrics": windows.customer_metrics(), "transaction_metrics": windows.transaction_metrics()}
    gold = None
    for name, metric in metrics.items():
        line = _counts(lk, [name], "gold", lambda p, m=metric: windows.read_gold(t.spark, p, m))
        gold = line if gold is None else gold.unionByName(line)
    rates = windows.read_gold(t.spark, lk.path("gold", "event_rates"), windows.event_rate())
    realtime = windows.read_gold(t.spark, lk.path("silver", "realtime_metrics"), windows.realtime_metrics())
    for name, rows, column in (
        ("event_rates", rates, "event_count"),
        ("realtime_metrics", realtime, "event_count"),
        ("dashboard_metrics", medallion.read_minutes(lk), "total_events_per_minute"),
    ):
        gold = gold.unionByName(rows.agg(F.sum(column).alias("rows")).withColumn("table_name", F.lit(name)))
    return parts.union(gold)


@register("job2_customer_marts", ctes("ev", DAILY))
def _(t):
    paths = jobs.customer_marts(lake(t, "job2"), t.events, _now(t))
    return rounded(t.spark.read.parquet(paths["daily_metrics"]))


@register(
    "job3_window_aggregation",
    ctes(
        "ev",
        f"""SELECT event_type, count(*) AS event_count, count(DISTINCT customer_id) AS unique_customers FROM ev
WHERE event_ts >= {EVN} - INTERVAL 1 DAY AND event_ts <= {EVN} GROUP BY 1""",
    ),
)
def _(t):
    lk = lake(t, "job3")
    segments = t.raw("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))
    for _ in range(2):  # a repeated window leaves one set of rows
        jobs.window_aggregation(lk, t.events, t.campaigns, segments, *day_window(t), _now(t))
    return t.spark.read.parquet(lk.path("gold", "event_analytics")).select("event_type", "event_count", "unique_customers")


@register(
    "job4_range_aggregation",
    ctes(
        "ev",
        f"""SELECT event_type AS action, count(*) AS event_count, round(sum(value), 6) AS total_value, 'customer_actions' AS aggregation_type FROM ev
WHERE event_ts >= {EVN} - INTERVAL 1 DAY AND event_ts <= {EVN} GROUP BY 1""",
    ),
)
def _(t):
    paths = jobs.range_aggregation(lake(t, "job4"), t.events, t.transactions, t.metrics, *day_window(t), "run", "json")
    rows = t.spark.read.schema("action string, event_count bigint, total_value double, aggregation_type string")
    return rounded(rows.json(paths["customer_action_aggregations"]))


@register(
    "job5_hourly_rollup",
    ctes(
        "tx",
        f"""SELECT date_trunc('hour', created_at)::TIMESTAMP AS hour, status, count(*) AS total_transactions, round(sum(amount), 2) AS total_revenue
FROM tx WHERE created_at >= {TXN} - INTERVAL 24 HOUR GROUP BY 1, 2""",
    ),
)
def _(t):
    customers = rollups.windowed_customer_metrics(t.events)
    transactions = rollups.windowed_transaction_metrics(t.transactions)
    paths = jobs.hourly_rollup(lake(t, "job5"), customers, transactions, _now(t), latest(t.raw("orders"), "o_orderdate"))
    rows = t.spark.read.parquet(paths["transaction_hourly"])
    return rounded(rows.select("hour", "status", "total_transactions", "total_revenue"), 2)


@register(
    "job6_document_export",
    ctes(
        "ev",
        f"""SELECT 'event_analytics' AS table_name, count(DISTINCT event_type) AS documents FROM ev WHERE event_ts >= {EVN} - INTERVAL 1 DAY
UNION ALL SELECT 'customer_metrics', 1 FROM events HAVING count(*) > 0
UNION ALL SELECT 'campaign_metrics', count(DISTINCT campaign_id) FROM ev WHERE event_ts >= {EVN} - INTERVAL 1 DAY
UNION ALL SELECT 'segment_metrics', (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_custkey IN (SELECT customer_id FROM ev WHERE event_ts >= {EVN} - INTERVAL 1 DAY))
UNION ALL SELECT 'customer_action_aggregations', count(DISTINCT event_type) FROM ev WHERE event_ts >= {EVN} - INTERVAL 1 DAY
UNION ALL SELECT 'pipeline_run_summary', 1
UNION ALL SELECT 'customer_hourly', count(*) FROM (SELECT DISTINCT date_trunc('hour', event_ts), event_type, device_type FROM ev WHERE event_ts >= {EVN} - INTERVAL 24 HOUR)
UNION ALL SELECT 'transaction_hourly', (SELECT count(*) FROM (SELECT DISTINCT date_trunc('hour', o_orderdate), o_orderstatus FROM orders
  WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 24 HOUR))
UNION ALL SELECT 'lookups', count(DISTINCT event_type) FROM ev""",
    ),
)
def _(t):
    """Documents per exported table."""
    lk, out = lake(t, "job6"), shared_dir(t.spark, "job6out")
    segments = t.raw("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))
    jobs.window_aggregation(lk, t.events, t.campaigns, segments, *day_window(t), _now(t))
    jobs.range_aggregation(lk, t.events, t.transactions, t.metrics, *day_window(t), "run")
    customers = rollups.windowed_customer_metrics(t.events)
    transactions = rollups.windowed_transaction_metrics(t.transactions)
    jobs.hourly_rollup(lk, customers, transactions, _now(t), latest(t.raw("orders"), "o_orderdate"))
    jobs.document_export(lk, out, *day_window(t), _now(t))
    lookups = t.raw("events").select(F.lit("event_type").alias("lookupType"), F.col("event_type").alias("lookupValue")).distinct()
    jobs.export_lookups({"lookups": lookups}, out)
    result = t.spark.read.schema(lookups.schema).json(f"{out}/lookups").agg(F.count("*").alias("documents"))
    result = result.select(F.lit("lookups").alias("table_name"), "documents")
    for name in ("customer_action_aggregations", "pipeline_run_summary", "customer_hourly", "transaction_hourly"):
        docs = t.spark.read.schema("doc_id string").json(f"{out}/{name}").agg(F.count_distinct("doc_id").alias("documents"))
        result = result.unionByName(docs.withColumn("table_name", F.lit(name)))
    for name in ("event_analytics", "customer_metrics", "campaign_metrics", "segment_metrics"):
        docs = documents.read_documents(t.spark, f"{out}/{name}")
        result = result.unionByName(
            docs.agg(F.count_distinct("doc_id").alias("documents")).withColumn("table_name", F.lit(name))
        )
    return result


@register(
    "job7_contract_ingest",
    f"""WITH {CROWS}, ok AS (SELECT * FROM crows WHERE kind IS NOT NULL AND seen IS NOT NULL)
SELECT 'sales_orders_by_kind' AS target, 'success' AS status, CAST(count(*) AS BIGINT) AS n FROM ok
UNION ALL SELECT 'daily_counts', 'success', CAST(count(*) AS BIGINT) FROM ok UNION ALL SELECT 'sales_orders_broken', 'error', NULL""",
)
def _(t):
    lk = lake(t, "job7")
    result = jobs.contract_ingest(lk, contract_rows(t), CONTRACT, "sales", "orders", _now(t))
    out = None
    for r in result["aggregations"]:
        if r["status"] == "success":
            rows = t.spark.read.parquet(lk.path("gold", r["target"])).agg(F.sum("n").alias("n"))
        else:
            rows = t.raw("events").agg(F.lit(None).cast("bigint").alias("n"))
        line = rows.select(F.lit(r["target"]).alias("target"), F.lit(r["status"]).alias("status"), "n")
        out = line if out is None else out.unionByName(line)
    return out


@register(
    "job8_incident_ingest",
    LOOK
    + """ SELECT 'Incident' AS table_name, count(*) AS rows FROM main
UNION ALL SELECT 'IncidentFiles', CAST(sum("IncidentId" % 3) AS BIGINT) FROM main
UNION ALL SELECT 'IncidentHistory', count(*) FROM mapped
UNION ALL SELECT 'IncidentLookup', count(*) FROM pairs WHERE "lookupValue" IS NOT NULL""",
)
def _(t):
    lk = lake(t, "job8")
    for _ in range(2):  # the second delivery merges into the same rows
        jobs.incident_ingest(lk, fixtures.incidents(t), fixtures.STATE_MAP, "month")
    rows = None
    for name, keys in jobs.INCIDENT_KEYS.items():
        line = _counts(lk, [name], "silver", lambda p, k=keys: changes.read_merged(t.spark, p, k))
        rows = line if rows is None else rows.union(line)
    return rows.union(_counts(lk, ["IncidentLookup"], "silver", lambda p: writers.read_current(t.spark, p)))


@register(
    "job9_traffic_ingest",
    f"""WITH {TREC} SELECT 'TrafficHeaderSession' AS table_name, count(*) AS rows FROM hdr UNION ALL SELECT 'TrafficData', count(*) FROM pass
UNION ALL SELECT 'TrafficLookup', (SELECT count(DISTINCT "SessionIndex") + count(DISTINCT dev) + count(DISTINCT "Location0") + count(DISTINCT "Location1")
  + count(DISTINCT "Location2") FROM hdr) + (SELECT count(DISTINCT event_type) FROM pass)""",
)
def _(t):
    lk = lake(t, "job9")
    jobs.traffic_ingest(lk, fixtures.traffic_records(t), _now(t))
    flat = _counts(lk, ["TrafficHeaderSession"], "bronze", lambda p: writers.read_evolving(t.spark, p))
    flat = flat.union(_counts(lk, ["TrafficData"], "bronze"))
    return flat.union(_counts(lk, ["TrafficLookup"], "bronze", lambda p: writers.read_current(t.spark, p)))


@register(
    "job10_vpc_ingest",
    """SELECT 'VpcEvent' AS table_name, count(*) AS rows, true AS accepted FROM events
UNION ALL SELECT 'VpcClerks', count(*), true FROM supplier""",
)
def _(t):
    lk = lake(t, "job10")
    blank = F.lit(None).cast("string")
    events = t.raw("events").select(
        F.col("event_id").cast("string").alias("EventId"),
        F.col("event_type").alias("EventType"),
        F.col("ts").alias("EventTime"),
        F.concat(F.lit("vpc-"), (F.col("user_id") % 9).cast("string")).alias("VpcId"),
        *[blank.alias(c) for c in ("InstanceId", "ResourceId", "State", "PreviousState", "Region", "AvailabilityZone", "Source")],
        F.col("props").alias("Details"),
        F.when(F.col("event_type") == "error", "high").otherwise("low").alias("Severity"),
    )
    clerks = t.raw("supplier").select(
        F.col("s_suppkey").cast("string").alias("ClerkId"),
        F.col("s_name").alias("ClerkName"),
        *[blank.alias(c) for c in ("Status", "LastUpdate", "VpcId", "Region")],
        (F.col("s_acctbal") > 0).alias("IsActive"),
        F.col("s_nationkey").alias("ProcessingLoad"),
        blank.alias("LastHeartbeat"),
    )
    accepted = jobs.vpc_ingest(lk, events, clerks, "batch_1", _now(t))
    counts = _counts(lk, ["VpcEvent", "VpcClerks"], "bronze", lambda p: writers.read_evolving(t.spark, p))
    return counts.withColumn("accepted", F.lit(accepted["VpcEvent"] and accepted["VpcClerks"]))


@register(
    "job11_event_ingest",
    f"""WITH k AS (SELECT coalesce(nullif({HOLES}, ''), 'unknown') AS event_type FROM events)
SELECT event_type, count(*) AS count FROM k GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM k""",
)
def _(t):
    return jobs.event_ingest(lake(t, "job11"), holes(t), "batch_1", _now(t))


@register(
    "job12_table_check",
    """SELECT n AS table_name, n = 'event_analytics' AS available, CASE WHEN n = 'event_analytics' THEN (SELECT count(DISTINCT event_type) FROM events) ELSE 0 END AS rows
FROM (VALUES ('customer_behavior'), ('transactions'), ('analytics_metrics'), ('customer_metrics'), ('campaign_metrics'), ('event_analytics'), ('segment_metrics')) v(n)""",
)
def _(t):
    lk = lake(t, "job12")
    start, end = t.raw("events").agg(F.min("ts")).scalar(), _now(t)
    writers.write_table(rollups.window_event_analytics(t.events, start, end, end), lk.path("gold", "event_analytics"))
    return jobs.check_tables(lk)
