"""Queries: batch marts, RFM, sessions."""

from pyspark.sql import functions as F

from eventmill.catalog.registry import ctes, more, register, rounded
from eventmill.functions.scalars import latest
from eventmill.operators import marts
from eventmill.operators.sessions import sessionize

CUSTOMER_360 = """
SELECT customer_id, count(*) AS total_events, count(DISTINCT session_id) AS total_sessions,
  count(DISTINCT event_id) FILTER (event_type = 'page_view') AS page_views,
  count(DISTINCT event_id) FILTER (event_type = 'purchase') AS purchases,
  round(sum(amount), 6) AS total_spent, round(avg(amount), 6) AS avg_order_value,
  min(event_ts) AS first_seen, max(event_ts) AS last_seen,
  array_to_string(list_sort(list(DISTINCT device_type)), ',') AS devices_used,
  count(DISTINCT product_id) AS unique_products_viewed,
  CAST(date_diff('day', min(event_ts), (SELECT max(ts) FROM events)) AS INTEGER) AS days_since_first_seen,
  CAST(date_diff('day', max(event_ts), (SELECT max(ts) FROM events)) AS INTEGER) AS days_since_last_seen,
  round(count(DISTINCT event_id) FILTER (event_type = 'purchase')
    / (date_diff('day', min(event_ts), (SELECT max(ts) FROM events)) + 1)::DOUBLE, 6) AS purchase_frequency,
  round(count(*) * 0.3::DOUBLE + count(DISTINCT event_id) FILTER (event_type = 'purchase') * 0.7::DOUBLE, 6) AS engagement_score
FROM ev GROUP BY customer_id"""


def c360(t):
    df = marts.customer_360(t.events, latest(t.raw("events"), "ts"))
    return rounded(df.withColumn("devices_used", F.array_join("devices_used", ",")))


register("agg1_customer_360", ctes("ev", CUSTOMER_360))(c360)

RFM_BASE = """base AS (
  SELECT customer_id, CAST(date_diff('day', max(event_ts), (SELECT max(ts) FROM events)) AS INTEGER) AS recency,
    count(*) AS frequency, sum(amount) AS monetary
  FROM ev WHERE event_type = 'purchase' GROUP BY customer_id)"""


@register(
    "agg2_rfm_base",
    more("ev", RFM_BASE, "SELECT customer_id, recency, frequency, round(monetary, 6) AS monetary FROM base"),
)
def _(t):
    return rounded(marts.rfm_base(t.events, latest(t.raw("events"), "ts")))


def rfm_oracle(best: str, body: str) -> str:
    score = "CAST(%s AS INTEGER)" % best
    return more(
        "ev",
        RFM_BASE
        + f""",
scored AS (SELECT *, {score.format("ntile(5) OVER (ORDER BY recency, customer_id)")} AS r_score,
  {score.format("ntile(5) OVER (ORDER BY frequency DESC, customer_id)")} AS f_score,
  {score.format("ntile(5) OVER (ORDER BY round(monetary, 2) DESC, customer_id)")} AS m_score FROM base),
rfm AS (SELECT *, r_score + f_score + m_score AS rfm_score,
  CASE WHEN r_score + f_score + m_score >= 12 THEN 'VIP' WHEN r_score + f_score + m_score >= 9 THEN 'Premium'
    WHEN r_score + f_score + m_score >= 6 THEN 'Standard' ELSE 'Basic' END AS segment FROM scored)""",
        body,
    )


ALL = "SELECT customer_id, recency, frequency, round(monetary, 6) AS monetary, r_score, f_score, m_score, rfm_score, segment FROM rfm"


def rfm(t, **kw):
    base = marts.rfm_base(t.events, latest(t.raw("events"), "ts"))
    return marts.rfm_segments(base.withColumn("monetary", F.round("monetary", 2)), **kw)


@register("win1_rfm_segments", rfm_oracle("6 - {}", ALL))
def _(t):
    return rounded(rfm(t))


@register("win1_rfm_reference_direction", rfm_oracle("{}", ALL))
def _(t):
    return rounded(rfm(t, reference_direction=True))


@register("agg6_segment_distribution", rfm_oracle("6 - {}", "SELECT segment, count(*) AS count FROM rfm GROUP BY 1"))
def _(t):
    return marts.segment_distribution(rfm(t))


@register(
    "agg6_date_range",
    ctes(
        "ev",
        """SELECT min(CAST(event_ts AS DATE)) AS first_date, max(CAST(event_ts AS DATE)) AS last_date,
  count(DISTINCT CAST(event_ts AS DATE)) AS days FROM ev WHERE event_type = 'purchase'""",
    ),
)
def _(t):
    return marts.date_range(marts.daily_metrics(t.events))


PRODUCT = """
SELECT product_id, count(*) AS total_interactions, count(DISTINCT customer_id) AS unique_customers,
  count(*) FILTER (event_type = 'page_view') AS views, count(*) FILTER (event_type = 'add_to_cart') AS add_to_cart,
  count(*) FILTER (event_type = 'purchase') AS purchases, round(sum(amount), 6) AS revenue,
  round(avg(amount), 6) AS avg_price,
  round(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'page_view'), 0)::DOUBLE * 100, 6) AS conversion_rate,
  round(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'add_to_cart'), 0)::DOUBLE * 100, 6) AS cart_conversion_rate
FROM ev WHERE product_id IS NOT NULL GROUP BY product_id"""


@register("agg3_product_analytics", ctes("ev", PRODUCT))
def _(t):
    return rounded(marts.product_analytics(t.events))


DAILY = """
SELECT CAST(event_ts AS DATE) AS date, count(*) AS total_orders, count(DISTINCT customer_id) AS unique_customers,
  round(sum(amount), 6) AS revenue, round(avg(amount), 6) AS avg_order_value
FROM ev WHERE event_type = 'purchase' GROUP BY 1"""


@register("agg4_daily_metrics", ctes("ev", DAILY))
def _(t):
    return rounded(marts.daily_metrics(t.events)).orderBy("date")


DEVICE = """
SELECT device_type, CAST(event_ts AS DATE) AS date, count(*) AS events, count(DISTINCT customer_id) AS unique_users,
  count(*) FILTER (event_type = 'purchase') AS conversions, round(sum(amount), 6) AS revenue,
  round(count(*) FILTER (event_type = 'purchase') / count(*)::DOUBLE * 100, 6) AS conversion_rate
FROM ev GROUP BY 1, 2"""


@register("agg5_device_performance", ctes("ev", DEVICE))
def _(t):
    return rounded(marts.device_performance(t.events))


@register(
    "agg7_action_summary",
    ctes(
        "ev",
        """SELECT event_type AS action, count(*) AS event_count, round(sum(value), 6) AS total_value,
  round(avg(value), 6) AS avg_value, count(DISTINCT customer_id) AS unique_customers,
  'customer_actions' AS aggregation_type FROM ev GROUP BY 1""",
    ),
)
def _(t):
    return rounded(marts.stamp(marts.action_summary(t.events), "customer_actions").drop("created_at"))


@register(
    "agg8_hourly_customer_summary",
    ctes(
        "ev",
        """SELECT strftime(date_trunc('hour', event_ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS event_count,
  round(sum(value), 6) AS total_value, count(DISTINCT customer_id) AS unique_customers,
  count(DISTINCT event_type) AS unique_actions, 'customer_hourly' AS aggregation_type FROM ev GROUP BY 1""",
    ),
)
def _(t):
    return rounded(marts.stamp(marts.hourly_customer_summary(t.events), "customer_hourly").drop("created_at"))


@register(
    "agg9_transaction_status",
    ctes(
        "tx",
        """SELECT status, count(*) AS transaction_count, round(sum(amount), 2) AS total_amount,
  round(avg(amount), 6) AS avg_amount, min(amount) AS min_amount, max(amount) AS max_amount,
  'transaction_status' AS aggregation_type FROM tx GROUP BY 1""",
    ),
)
def _(t):
    summary = marts.stamp(marts.transaction_status_summary(t.transactions), "transaction_status")
    return rounded(summary.drop("created_at"), cents=("total_amount",))


HOURLY_REVENUE = """SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS hour,
  count(*) AS transaction_count, round(sum(amount), 6) AS total_revenue,
  round(avg(amount), 6) AS avg_transaction_value, count(DISTINCT customer_id) AS unique_customers
  FROM tx GROUP BY 1"""


@register("agg10_hourly_revenue", ctes("tx", HOURLY_REVENUE))
def _(t):
    return rounded(marts.hourly_revenue(t.transactions))


@register(
    "agg11_metric_summary",
    ctes(
        "met",
        """SELECT metric_name, count(*) AS measurement_count, round(avg(value), 6) AS avg_value,
  min(value) AS min_value, max(value) AS max_value, round(stddev_samp(value), 6) AS stddev_value
  FROM met GROUP BY 1""",
    ),
)
def _(t):
    return rounded(marts.metric_summary(t.metrics))


@register(
    "agg12_metric_timeseries",
    ctes(
        "met",
        """SELECT strftime(time_bucket(INTERVAL 5 MINUTE, event_ts), '%Y-%m-%d %H:%M:%S') AS time_bucket, metric_name,
  round(avg(value), 6) AS avg_value, count(*) AS measurement_count FROM met GROUP BY 1, 2""",
    ),
)
def _(t):
    return rounded(marts.metric_timeseries(t.metrics))


@register(
    "agg13_run_summary",
    """SELECT 'run' AS pipeline_run_id, (SELECT min(ts) FROM events) AS start_time,
  (SELECT max(ts) FROM events) AS end_time,
  (epoch_us((SELECT max(ts) FROM events)) // 1000 - epoch_us((SELECT min(ts) FROM events)) // 1000) / 1000.0::DOUBLE
    AS processing_duration_seconds,
  CAST((SELECT count(*) FROM events) * 2 + (SELECT count(*) FROM orders) AS BIGINT) AS total_events_processed,
  (SELECT count(*) FROM events) AS customer_events_count, (SELECT count(*) FROM orders) AS transaction_events_count,
  (SELECT count(*) FROM events) AS system_metrics_count, 'completed' AS status""",
)
def _(t):
    raw = t.raw("events")
    first, last = raw.agg(F.min("ts")).scalar(), raw.agg(F.max("ts")).scalar()
    streams = {"customer_events": t.events, "transaction_events": t.transactions, "system_metrics": t.metrics}
    return rounded(marts.run_summary(streams, "run", first, last, last))


SESSIONS = """marked AS (
  SELECT *, CASE WHEN event_ts - lag(event_ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts
  FROM ev WINDOW w AS (PARTITION BY customer_id ORDER BY event_ts, event_id)),
numbered AS (
  SELECT *, CAST(sum(starts) OVER (PARTITION BY customer_id ORDER BY event_ts, event_id) AS BIGINT) AS session_no FROM marked),
sess AS (
  SELECT customer_id, session_no, min(event_ts) AS session_start, max(event_ts) AS session_end, count(*) AS events,
    count(*) FILTER (event_type = 'page_view') AS page_views, count(*) FILTER (event_type = 'purchase') AS purchases,
    sum(amount) AS revenue,
    (epoch_us(max(event_ts)) - epoch_us(min(event_ts))) / 1000000.0::DOUBLE AS duration_seconds
  FROM numbered GROUP BY 1, 2)"""


@register(
    "agg53_customer_sessions",
    more(
        "ev",
        SESSIONS,
        """SELECT customer_id, session_no, session_start, session_end, events::BIGINT AS events, page_views::BIGINT AS page_views,
  purchases::BIGINT AS purchases, round(revenue, 6) AS revenue, round(duration_seconds, 6) AS duration_seconds FROM sess""",
    ),
)
def _(t):
    return rounded(sessionize(t.events))
