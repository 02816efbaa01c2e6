"""Queries: windowed gold metrics and re-aggregations."""

from pyspark.sql import functions as F

from eventmill.catalog.registry import ctes, more, register, rounded
from eventmill.functions.scalars import ago, latest
from eventmill.operators import marts, rollups

EVN = "(SELECT max(ts) FROM events)"
TXN = "(SELECT max(o_orderdate) FROM orders)"


def day_window(t):
    """The last day of the events as (start, end)."""
    now = latest(t.raw("events"), "ts")
    return ago(now, days=1), now


BOUNDS = f"{EVN} - INTERVAL 1 DAY AS window_start, {EVN} AS window_end"
LAST_DAY = f"event_ts >= {EVN} - INTERVAL 1 DAY AND event_ts <= {EVN}"


@register(
    "agg14_window_customer_metrics",
    more(
        "ev",
        "firsts AS (SELECT customer_id, min(event_ts) AS f FROM ev GROUP BY 1)",
        f"""SELECT {BOUNDS}, count(DISTINCT customer_id) AS total_customers,
  count(DISTINCT customer_id) FILTER (f >= {EVN} - INTERVAL 1 DAY) AS new_customers,
  count(DISTINCT customer_id) AS active_customers, count(customer_id) AS total_events,
  round(sum(coalesce(value, 0)) / nullif(count(DISTINCT customer_id), 0), 2) AS avg_customer_value
FROM ev JOIN firsts USING (customer_id) WHERE {LAST_DAY}""",
    ),
)
def _(t):
    return rollups.window_customer_metrics(t.events, *day_window(t)).drop("created_at")


@register(
    "agg15_campaign_metrics",
    ctes(
        "camp",
        f"""SELECT campaign_id, {BOUNDS}, CAST(sum(impressions) AS BIGINT) AS total_impressions,
  CAST(sum(clicks) AS BIGINT) AS total_clicks, CAST(sum(conversions) AS BIGINT) AS total_conversions,
  round(sum(spend), 6) AS total_spend, round(sum(clicks) / nullif(sum(impressions), 0)::DOUBLE * 100, 2) AS ctr,
  round(sum(conversions) / nullif(sum(clicks), 0)::DOUBLE * 100, 2) AS conversion_rate
FROM camp WHERE {LAST_DAY} GROUP BY campaign_id""",
    ),
)
def _(t):
    return rounded(rollups.window_campaign_metrics(t.campaigns, *day_window(t)).drop("created_at"))


@register(
    "agg16_event_analytics",
    ctes(
        "ev",
        f"""SELECT event_type, {BOUNDS}, count(*) AS event_count, count(DISTINCT customer_id) AS unique_customers,
  round(sum(coalesce(value, 0)), 6) AS total_revenue, round(sum(coalesce(value, 0)) / count(*), 2) AS avg_revenue
FROM ev WHERE {LAST_DAY} GROUP BY event_type""",
    ),
)
def _(t):
    return rounded(rollups.window_event_analytics(t.events, *day_window(t)).drop("created_at"))


@register(
    "agg17_segment_metrics",
    ctes(
        "ev",
        f"""SELECT c_mktsegment AS segment, {BOUNDS}, count(DISTINCT customer_id) AS customer_count,
  count(event_type) AS total_orders, round(sum(coalesce(value, 0)), 6) AS total_revenue,
  round(sum(coalesce(value, 0)) / nullif(count(event_type), 0), 2) AS avg_order_value
FROM ev LEFT JOIN customer ON c_custkey = customer_id WHERE {LAST_DAY} GROUP BY 1""",
    ),
)
def _(t):
    segments = t.raw("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))
    return rounded(rollups.window_segment_metrics(t.events, segments, *day_window(t)).drop("created_at"))


GOLD = """gold_c AS (
  SELECT time_bucket(INTERVAL 5 MINUTE, event_ts) AS window_start, event_type AS action, device_type,
    count(customer_id) AS event_count, count(DISTINCT customer_id) AS unique_customers,
    avg(value) AS avg_value, sum(value) AS total_value FROM ev GROUP BY 1, 2, 3),
gold_t AS (
  SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS window_start, status, payment_method,
    count(*) AS transaction_count, sum(amount) AS total_amount, avg(amount) AS avg_amount,
    count(DISTINCT customer_id) AS unique_customers FROM tx GROUP BY 1, 2, 3)"""


@register(
    "agg18_hourly_customer_rollup",
    more(
        "ev tx",
        GOLD,
        f"""SELECT date_trunc('hour', window_start) AS hour, action, device_type, CAST(sum(event_count) AS BIGINT) AS total_events,
  CAST(sum(unique_customers) AS BIGINT) AS sum_unique_customers, round(avg(avg_value), 6) AS avg_engagement
FROM gold_c WHERE window_start >= {EVN} - INTERVAL 24 HOUR GROUP BY 1, 2, 3""",
    ),
)
def _(t):
    gold = rollups.windowed_customer_metrics(t.events, digits=None)
    return rounded(rollups.hourly_customer_rollup(gold, latest(t.raw("events"), "ts")))


@register(
    "agg19_hourly_transaction_rollup",
    more(
        "ev tx",
        GOLD,
        f"""SELECT date_trunc('hour', window_start) AS hour, status, CAST(sum(transaction_count) AS BIGINT) AS total_transactions,
  round(sum(total_amount), 6) AS total_revenue, round(avg(avg_amount), 6) AS avg_transaction_value
FROM gold_t WHERE window_start >= {TXN} - INTERVAL 24 HOUR GROUP BY 1, 2""",
    ),
)
def _(t):
    gold = rollups.windowed_transaction_metrics(t.transactions, digits=None)
    return rounded(rollups.hourly_transaction_rollup(gold, latest(t.raw("orders"), "o_orderdate")))


HOURLY_ACTIONS = """acts AS (
  SELECT date_trunc('hour', event_ts) AS hour, event_type AS action, count(*) AS event_count, sum(value) AS total_value,
    avg(value) AS avg_value, count(DISTINCT customer_id) AS unique_customers FROM ev GROUP BY 1, 2)"""


@register(
    "agg29_reaggregate_actions",
    more(
        "ev",
        HOURLY_ACTIONS,
        """SELECT action, CAST(sum(event_count) AS BIGINT) AS event_count, round(sum(total_value), 6) AS total_value,
  round(avg(avg_value), 6) AS avg_value, CAST(sum(unique_customers) AS BIGINT) AS sum_unique_customers
FROM acts GROUP BY 1""",
    ),
)
def _(t):
    gold = t.events.groupBy(F.date_trunc("hour", "event_ts").alias("hour"), F.col("event_type").alias("action")).agg(
        F.count("*").alias("event_count"),
        F.sum("value").alias("total_value"),
        F.avg("value").alias("avg_value"),
        F.count_distinct("customer_id").alias("unique_customers"),
    )
    return rounded(rollups.reaggregate_actions(gold))


@register(
    "agg30_reaggregate_metrics",
    more(
        "met",
        """days AS (SELECT metric_name, CAST(event_ts AS DATE) AS d, avg(value) AS avg_value, min(value) AS min_value,
  max(value) AS max_value, count(*) AS measurement_count FROM met GROUP BY 1, 2)""",
        """SELECT metric_name, round(avg(avg_value), 6) AS avg_value, min(min_value) AS min_value, max(max_value) AS max_value,
  CAST(sum(measurement_count) AS BIGINT) AS measurement_count FROM days GROUP BY 1""",
    ),
)
def _(t):
    daily = t.metrics.groupBy("metric_name", F.to_date("event_ts").alias("d")).agg(
        F.avg("value").alias("avg_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.count("*").alias("measurement_count"),
    )
    return rounded(rollups.reaggregate_metrics(daily))


@register(
    "agg33_recent_hourly_revenue",
    ctes(
        "tx",
        f"""SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS transaction_count,
  round(sum(amount), 6) AS total_revenue, round(avg(amount), 6) AS avg_transaction_value,
  count(DISTINCT customer_id) AS unique_customers
FROM tx WHERE date_trunc('hour', created_at) >= {TXN} - INTERVAL 24 HOUR GROUP BY 1 ORDER BY 1 DESC LIMIT 100""",
    ),
)
def _(t):
    now = latest(t.raw("orders"), "o_orderdate")
    # the hour filter is also a filter on the raw time, which the scan can use
    recent = t.transactions.filter(F.col("created_at") >= ago(now, hours=24))
    hourly = marts.hourly_revenue(recent)
    since = F.date_format(ago(now, hours=24), "yyyy-MM-dd HH:mm:ss")
    return rounded(rollups.newest_rows(hourly, F.col("hour"), since, 100))


@register(
    "agg34_recent_metric_series",
    ctes(
        "met",
        f"""SELECT strftime(time_bucket(INTERVAL 5 MINUTE, event_ts), '%Y-%m-%d %H:%M:%S') AS time_bucket, metric_name,
  round(avg(value), 6) AS avg_value, count(*) AS measurement_count FROM met
  WHERE time_bucket(INTERVAL 5 MINUTE, event_ts) >= {EVN} - INTERVAL 1 HOUR
  GROUP BY 1, 2 ORDER BY 1 DESC, 2 LIMIT 1000""",
    ),
)
def _(t):
    now = latest(t.raw("events"), "ts")
    series = marts.metric_timeseries(t.metrics.filter(F.col("event_ts") >= ago(now, hours=1)))
    since = F.date_format(ago(now, hours=1), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return rounded(rollups.newest_rows(series, F.col("time_bucket"), since, 1000, "metric_name"))


DASH = """silver AS (
  SELECT time_bucket(INTERVAL 30 SECOND, event_ts) AS window_start, event_type AS action, category, count(*) AS event_count,
    count(DISTINCT customer_id) AS unique_customers, sum(coalesce(value, 0)) AS total_value,
    avg(coalesce(value, 0)) AS avg_value FROM ev GROUP BY 1, 2, 3),
dash AS (
  SELECT time_bucket(INTERVAL 1 MINUTE, window_start) AS window_start,
    time_bucket(INTERVAL 1 MINUTE, window_start) + INTERVAL 1 MINUTE AS window_end,
    CAST(sum(event_count) AS BIGINT) AS total_events_per_minute, CAST(sum(unique_customers) AS BIGINT) AS sum_unique_customers,
    sum(total_value) AS total_revenue, avg(avg_value) AS avg_event_value, count(*) AS metric_records,
    sum(event_count) / 60.0::DOUBLE AS events_per_second FROM silver GROUP BY 1, 2)"""


def dashboard(t):
    w = F.window("event_ts", "30 seconds")
    silver = t.events.groupBy(w, F.col("event_type").alias("action"), "category").agg(
        F.count("*").alias("event_count"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.sum(F.coalesce("value", F.lit(0.0))).alias("total_value"),
        F.avg(F.coalesce("value", F.lit(0.0))).alias("avg_value"),
    )
    return rollups.minute_dashboard(silver.withColumn("window_start", F.col("window.start")))


@register(
    "agg37_dashboard_now",
    more(
        "ev",
        DASH,
        f"""SELECT CAST(coalesce(sum(total_events_per_minute), 0) AS BIGINT) AS total_events,
  round(coalesce(max_by(events_per_second, window_end), 0), 6) AS events_per_second,
  CAST(coalesce(sum(sum_unique_customers), 0) AS BIGINT) AS total_customers,
  round(coalesce(sum(total_revenue), 0), 6) AS total_revenue,
  round(coalesce(sum(total_revenue) / nullif(sum(total_events_per_minute), 0), 0), 6) AS avg_event_value
FROM (SELECT * FROM dash WHERE window_end >= {EVN} - INTERVAL 5 MINUTE ORDER BY window_end DESC LIMIT 10)""",
    ),
)
def _(t):
    return rounded(rollups.dashboard_now(dashboard(t), latest(t.raw("events"), "ts")))


@register(
    "agg38_bronze_now",
    ctes(
        "ev",
        f"""SELECT count(*) AS total_events, count(DISTINCT customer_id) AS total_customers,
  round(coalesce(sum(value), 0), 6) AS total_revenue, round(count(*) / 300.0::DOUBLE, 6) AS events_per_second,
  round(coalesce(sum(value) / nullif(count(*), 0), 0), 6) AS avg_event_value
FROM ev WHERE event_ts >= {EVN} - INTERVAL 5 MINUTE""",
    ),
)
def _(t):
    return rounded(rollups.bronze_now(t.events, latest(t.raw("events"), "ts")))


@register(
    "agg39_trend",
    more(
        "ev",
        DASH,
        f"""SELECT window_end, total_events_per_minute, round(events_per_second, 6) AS events_per_second, sum_unique_customers,
  round(total_revenue, 6) AS total_revenue FROM dash WHERE window_end >= {EVN} - INTERVAL 1 HOUR""",
    ),
)
def _(t):
    return rounded(rollups.trend(dashboard(t), latest(t.raw("events"), "ts")))
