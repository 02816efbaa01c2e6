"""Queries: dashboards, customers, campaigns and the declared surfaces."""

from pyspark.sql import functions as F

from eventmill.catalog.marts import SESSIONS
from eventmill.catalog.registry import ctes, more, register, rounded
from eventmill.functions.scalars import latest
from eventmill.operators import service
from eventmill.operators.sessions import sessionize

EVN = "(SELECT max(ts) FROM events)"
TXN = "(SELECT max(o_orderdate) FROM orders)"
SAN = "(SELECT max(l_shipdate) FROM lineitem)"


def ev_now(t):
    return latest(t.raw("events"), "ts")


def tx_now(t):
    return latest(t.raw("orders"), "o_orderdate")


def sale_now(t):
    return latest(t.raw("lineitem"), "l_shipdate")


@register(
    "agg20_realtime_snapshot",
    ctes(
        "ev tx",
        f"""SELECT count(*) AS transaction_count, count(DISTINCT customer_id) AS unique_customers,
  round(coalesce(sum(amount), 0), 2) AS total_value,
  (SELECT count(*) FROM ev WHERE event_ts >= {EVN} - INTERVAL 5 MINUTE) AS total_events,
  round((SELECT count(*) FROM ev WHERE event_ts >= {EVN} - INTERVAL 5 MINUTE) / 300.0::DOUBLE, 2) AS events_per_second,
  CASE WHEN (SELECT count(*) FROM ev WHERE event_ts >= {EVN} - INTERVAL 5 MINUTE) > 0 THEN 'active' ELSE 'no_data' END AS status
FROM tx WHERE created_at >= {TXN} - INTERVAL 5 MINUTE""",
    ),
)
def _(t):
    return service.realtime_snapshot(t.events, t.transactions, ev_now(t), tx_now(t))


@register(
    "agg21_dashboard_summary",
    ctes(
        "ev tx cust",
        f"""SELECT count(*) AS total_transactions, round(coalesce(sum(amount), 0), 2) AS total_revenue,
  round(coalesce(avg(amount), 0), 2) AS avg_transaction_value, count(DISTINCT customer_id) AS unique_customers,
  (SELECT count(*) FROM ev WHERE event_ts >= {EVN} - INTERVAL 24 HOUR) AS total_events,
  (SELECT count(*) FROM cust WHERE status = 'active' AND last_order_date >= {TXN} - INTERVAL 24 HOUR) AS active_customers
FROM tx WHERE created_at >= {TXN} - INTERVAL 24 HOUR""",
    ),
)
def _(t):
    return service.dashboard_summary(t.events, t.transactions, t.customers, ev_now(t), tx_now(t))


@register(
    "agg22_activity_status",
    ctes(
        "ev",
        f"""SELECT n AS recent_activity_count, CASE WHEN n > 0 THEN 'running' ELSE 'stopped' END AS status,
  CASE WHEN n > 0 THEN 'active' ELSE 'inactive' END AS consumer,
  CASE WHEN n > 10 THEN 'active' ELSE 'inactive' END AS stream_processing,
  CASE WHEN n > 0 THEN 'active' ELSE 'inactive' END AS metrics_writer,
  CASE WHEN n > 10 THEN 100 WHEN n > 0 THEN 50 ELSE 0 END AS health_score
FROM (SELECT count(*) AS n FROM ev WHERE event_ts >= {EVN} - INTERVAL 5 MINUTE)""",
    ),
)
def _(t):
    return service.activity_status(t.events, ev_now(t))


@register(
    "agg23_daily_history_revenue",
    ctes(
        "tx",
        f"""SELECT CAST(created_at AS DATE) AS date, count(*) AS transactions, round(sum(amount), 2) AS revenue
FROM tx WHERE created_at >= {TXN} - INTERVAL 30 DAY GROUP BY 1""",
    ),
)
def _(t):
    return service.daily_history(t.transactions, tx_now(t))


@register(
    "agg23_daily_history_customers",
    ctes(
        "tx",
        f"""SELECT CAST(created_at AS DATE) AS date, count(*) AS transactions, count(DISTINCT customer_id) AS unique_customers
FROM tx WHERE created_at >= {TXN} - INTERVAL 30 DAY GROUP BY 1""",
    ),
)
def _(t):
    return service.daily_history(t.transactions, tx_now(t), metric_type="customers")


TOP = f"""top AS (
  SELECT product_id, round(sum(amount), 2) AS total_revenue, count(*) AS total_orders, round(avg(amount), 2) AS avg_order_value
  FROM sales WHERE created_at >= {SAN} - INTERVAL 30 DAY GROUP BY 1 ORDER BY total_revenue DESC, product_id LIMIT 10)"""
TOP_BODY = """SELECT product_id, total_revenue, total_orders, avg_order_value,
  coalesce(p_name, 'Product ' || product_id) AS name, coalesce(p_brand, 'Unknown') AS category
FROM top LEFT JOIN part ON p_partkey = product_id"""


@register("agg24_top_products", more("sales", TOP, TOP_BODY))
def _(t):
    return service.top_products(t.sales, t.products, sale_now(t))


@register("jn2_top_products_missing_dimension", more("sales", TOP, TOP_BODY.replace("LEFT JOIN part", "LEFT JOIN (SELECT * FROM part WHERE p_type <> 'ECONOMY')")))
def _(t):
    known = t.raw("part").filter("p_type <> 'ECONOMY'").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category")
    )
    return service.top_products(t.sales, known, sale_now(t))


@register(
    "agg25_customer_statistics",
    ctes(
        "cust",
        """SELECT count(*) AS total_customers, count(*) FILTER (status = 'active') AS active_customers,
  count(*) FILTER (status = 'churned') AS churned_customers, round(sum(total_spent), 2) AS total_revenue,
  round(avg(total_spent), 6) AS avg_order_value, CAST(sum(total_orders) AS BIGINT) AS total_orders,
  round(count(*) FILTER (status = 'churned') / count(*)::DOUBLE * 100, 2) AS churn_rate,
  round(count(*) FILTER (status = 'active') / count(*)::DOUBLE * 100, 2) AS activity_rate FROM cust""",
    ),
)
def _(t):
    return rounded(service.customer_statistics(t.customers), cents=("total_revenue",))


for _name, _column in (("agg26_lifecycle_distribution", "lifecycle_stage"), ("agg26_status_distribution", "status")):
    register(
        _name,
        ctes(
            "cust",
            f"""SELECT coalesce({_column}, 'unknown') AS {_column}, count(*) AS count,
  round(count(*) / (SELECT count(*) FROM cust)::DOUBLE * 100, 2) AS percentage FROM cust GROUP BY 1""",
        ),
    )(lambda t, c=_column: service.distribution(t.customers, c))

register(
    "win9_percent_of_total",
    ctes(
        "ev",
        """SELECT device_type, count(*) AS count, round(count(*) / (SELECT count(*) FROM ev)::DOUBLE * 100, 4) AS percentage
FROM ev GROUP BY 1""",
    ),
)(lambda t: service.distribution(t.events, "device_type", 4))


def users(t):
    """Users from the customer dimension: active = ordered within 90 days, verified = positive balance."""
    return t.customers.select(
        F.col("customer_id").alias("user_id"),
        (F.col("status") == "active").alias("is_active"),
        (F.col("balance") > 0).alias("is_verified"),
        F.col("last_order_date").alias("last_login"),
        "created_at",
        F.col("total_orders").alias("login_count"),
        F.col("segment").alias("role"),
    )


@register(
    "agg27_user_statistics",
    ctes(
        "cust",
        f"""SELECT count(*) AS total_users, count(*) FILTER (status = 'active') AS active_users,
  count(*) FILTER (balance > 0) AS verified_users,
  count(*) FILTER (last_order_date >= {TXN} - INTERVAL 30 DAY) AS active_last_30_days,
  count(*) FILTER (created_at >= {TXN} - INTERVAL 7 DAY) AS new_last_7_days,
  round(count(*) FILTER (status = 'active') / count(*)::DOUBLE * 100, 6) AS activation_rate,
  round(count(*) FILTER (balance > 0) / count(*)::DOUBLE * 100, 6) AS verification_rate FROM cust""",
    ),
)
def _(t):
    return rounded(service.user_statistics(users(t), tx_now(t)))


@register(
    "agg28_segment_breakdown",
    ctes(
        "cust",
        f"""SELECT segment, count(*) AS count, count(*) FILTER (created_at >= {TXN} - INTERVAL 30 DAY) AS new_customers,
  round(count(*) / (SELECT count(*) FROM cust)::DOUBLE * 100, 1) AS percentage FROM cust GROUP BY 1""",
    ),
)
def _(t):
    return service.segment_breakdown(t.customers, tx_now(t))


RUNS = """runs AS (
  SELECT o_orderkey AS run_id, o_orderdate AS created_at,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
    o_totalprice / 1000 AS duration_seconds FROM orders)"""


def runs(t):
    status = (
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    )
    return t.raw("orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").alias("created_at"),
        status.alias("status"),
        (F.col("o_totalprice") / 1000).alias("duration_seconds"),
    )


@register(
    "agg31_run_status",
    "WITH "
    + RUNS
    + f""" SELECT (SELECT run_id FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 1) AS last_run,
  (SELECT status FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 1) AS last_status, count(*) AS runs_today,
  count(*) FILTER (status = 'completed') AS completed_today, round(coalesce(avg(duration_seconds), 0), 2) AS avg_processing_time,
  round(coalesce(count(*) FILTER (status = 'completed') / nullif(count(*), 0)::DOUBLE * 100, 0), 2) AS success_rate
FROM runs WHERE CAST(created_at AS DATE) = CAST({TXN} AS DATE)""",
)
def _(t):
    return service.run_status(runs(t), tx_now(t))


HOURS = """ch AS (SELECT date_trunc('hour', event_ts) AS hour, count(DISTINCT customer_id) AS total_customers FROM ev GROUP BY 1),
th AS (SELECT date_trunc('hour', event_ts) AS hour, sum(amount) AS total_revenue, count(*) AS total_transactions,
  avg(amount) AS avg_transaction_value FROM ev WHERE event_type = 'purchase' GROUP BY 1)"""


def history_hours(t):
    hour = F.date_trunc("hour", "event_ts").alias("hour")
    customers = t.events.groupBy(hour).agg(F.count_distinct("customer_id").alias("total_customers"))
    orders = (
        t.events.filter("event_type = 'purchase'")
        .groupBy(hour)
        .agg(
            F.sum("amount").alias("total_revenue"),
            F.count("*").alias("total_transactions"),
            F.avg("amount").alias("avg_transaction_value"),
        )
    )
    return customers, orders


for _g in ("hour", "day", "week", "month"):
    register(
        f"agg32_calendar_history_{_g}",
        more(
            "ev",
            HOURS
            + f""",
c AS (SELECT date_trunc('{_g}', hour)::TIMESTAMP AS timestamp, sum(total_customers) AS customers FROM ch GROUP BY 1),
o AS (SELECT date_trunc('{_g}', hour)::TIMESTAMP AS timestamp, sum(total_revenue) AS revenue, sum(total_transactions) AS orders,
  avg(avg_transaction_value) AS avg_order_value FROM th GROUP BY 1)""",
            """SELECT c.timestamp, round(coalesce(revenue, 0), 6) AS revenue, CAST(coalesce(orders, 0) AS BIGINT) AS orders,
  CAST(coalesce(customers, 0) AS BIGINT) AS customers, round(coalesce(avg_order_value, 0), 6) AS avg_order_value,
  round(coalesce(orders, 0) / greatest(customers, 1)::DOUBLE * 100, 6) AS conversion_rate
FROM c LEFT JOIN o ON c.timestamp = o.timestamp""",
        ),
    )(
        lambda t, g=_g: rounded(
            service.calendar_history(*history_hours(t), g, t.raw("events").agg(F.date_trunc("hour", F.min("ts"))).scalar(), ev_now(t))
        )
    )

register(
    "jn1_bucket_left_join",
    more(
        "ev",
        HOURS,
        """SELECT ch.hour AS timestamp, CAST(total_customers AS BIGINT) AS customers,
  CAST(coalesce(total_transactions, 0) AS BIGINT) AS orders FROM ch LEFT JOIN th ON ch.hour = th.hour""",
    ),
)(
    lambda t: service.calendar_history(
        *history_hours(t), "hour", t.raw("events").agg(F.date_trunc("hour", F.min("ts"))).scalar(), ev_now(t)
    ).select("timestamp", "customers", "orders")
)

RATIOS = """ratios AS (
  SELECT campaign_id, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks,
    CAST(sum(conversions) AS BIGINT) AS conversions, sum(spend) AS cost, sum(revenue) AS revenue,
    sum(clicks) / nullif(sum(impressions), 0)::DOUBLE * 100 AS ctr, sum(conversions) / nullif(sum(clicks), 0)::DOUBLE * 100 AS cvr,
    (sum(revenue) - sum(spend)) / nullif(sum(spend), 0) * 100 AS roi, sum(spend) / nullif(sum(clicks), 0)::DOUBLE AS cpc,
    sum(spend) / nullif(sum(conversions), 0)::DOUBLE AS cpa, sum(revenue) / nullif(sum(spend), 0) AS roas
  FROM camp GROUP BY 1)"""


@register(
    "agg36_campaign_ratios",
    more(
        "camp",
        RATIOS,
        """SELECT campaign_id, impressions, clicks, conversions, round(cost, 6) AS cost, round(revenue, 6) AS revenue,
  round(ctr, 6) AS ctr, round(cvr, 6) AS cvr, round(roi, 6) AS roi, round(cpc, 6) AS cpc, round(cpa, 6) AS cpa,
  round(roas, 6) AS roas FROM ratios""",
    ),
)
def _(t):
    return rounded(service.campaign_ratios(t.campaigns))


@register(
    "agg35_campaign_overview",
    more(
        "camp",
        RATIOS,
        """SELECT count(*) AS total_campaigns, count(*) FILTER (campaign_id < 5) AS active_campaigns, round(sum(cost) * 2, 6) AS total_budget,
  round(sum(cost), 6) AS total_spent, round(sum(revenue), 6) AS total_revenue, round(avg(coalesce(ctr, 0)), 2) AS avg_ctr,
  round(avg(coalesce(cvr, 0)), 2) AS avg_cvr, round((sum(revenue) - sum(cost)) / sum(cost) * 100, 2) AS total_roi FROM ratios""",
    ),
)
def _(t):
    campaigns = service.campaign_ratios(t.campaigns).withColumns(
        {"status": F.when(F.col("campaign_id") < 5, "active").otherwise("paused"), "budget": F.col("cost") * 2}
    )
    return rounded(service.campaign_overview(campaigns))


@register(
    "agg40_event_type_counts",
    ctes("ev", "SELECT event_type, count(*) AS count FROM ev GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM ev"),
)
def _(t):
    return service.event_type_counts(t.events)


@register(
    "prj6_type_rollup",
    """WITH typed AS (SELECT CASE event_type WHEN 'purchase' THEN 'transaction_completed' WHEN 'error' THEN 'system_metric'
    ELSE 'customer_' || event_type END AS event_type FROM events)
SELECT CASE WHEN contains(event_type, 'customer') THEN 'Customer' WHEN contains(event_type, 'transaction') THEN 'Transaction'
  ELSE 'Analytics' END AS category, count(*) AS count FROM typed GROUP BY 1""",
)
def _(t):
    kind = (
        F.when(F.col("event_type") == "purchase", "transaction_completed")
        .when(F.col("event_type") == "error", "system_metric")
        .otherwise(F.concat(F.lit("customer_"), F.col("event_type")))
    )
    return service.type_rollup(t.raw("events").select(kind.alias("event_type")))


# --- declared surfaces ------------------------------------------------------------
@register(
    "dec1_channel_performance",
    ctes(
        "ev",
        """SELECT device_type AS channel, count(DISTINCT customer_id) AS visitors,
  count(*) FILTER (event_type = 'purchase') AS conversions, round(sum(amount), 6) AS revenue,
  round(avg(amount), 6) AS avg_order_value,
  round(count(*) FILTER (event_type = 'purchase') / nullif(count(DISTINCT customer_id), 0)::DOUBLE * 100, 6) AS conversion_rate
FROM ev GROUP BY 1""",
    ),
)
def _(t):
    return rounded(service.channel_performance(t.events, "device_type"))


@register(
    "dec2_geography",
    ctes(
        "cust",
        """SELECT n_name AS country, r_name AS region, count(*) AS customers, round(sum(total_spent), 2) AS revenue,
  round(sum(total_spent) / nullif(sum(total_orders), 0)::DOUBLE, 6) AS avg_order_value
FROM cust JOIN nation ON n_nationkey = nation_key JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""",
    ),
)
def _(t):
    return rounded(service.geography(t.customers, t.geography), cents=("revenue",))


_VALUE = {
    "revenue": "sum(amount) FILTER ({f})",
    "orders": "(count(*) FILTER ({f}))::DOUBLE",
    "customers": "(count(DISTINCT customer_id) FILTER ({f}))::DOUBLE",
    "conversion_rate": "(count(*) FILTER ({f} AND status = 'completed')) / nullif(count(*) FILTER ({f}), 0)::DOUBLE * 100",
}
for _metric, _period, _days in (("revenue", "7d", 7), ("orders", "30d", 30), ("customers", "90d", 90), ("conversion_rate", "24h", 1)):
    _now = f"created_at > {TXN} - INTERVAL {_days} DAY"
    register(
        f"dec3_trend_{_metric}_{_period}",
        more(
            "tx",
            f"""v AS (SELECT {_VALUE[_metric].format(f=_now)} AS c, {_VALUE[_metric].format(f="NOT (" + _now + ")")} AS p
  FROM tx WHERE created_at > {TXN} - INTERVAL {2 * _days} DAY),
w AS (SELECT c, p, coalesce(round((c - p) / nullif(p, 0) * 100, 2), 0) AS tp FROM v)""",
            """SELECT round(c, 2) AS current_value, round(p, 2) AS previous_value, tp AS trend_percent,
  CASE WHEN tp > 0 THEN 'up' WHEN tp < 0 THEN 'down' ELSE 'neutral' END AS trend_direction FROM w""",
        ),
    )(lambda t, m=_metric, p=_period: rounded(service.trend_change(t.transactions, tx_now(t), m, p), 2))


@register(
    "dec4_day_over_day",
    more(
        "tx",
        f"""d AS (SELECT round(sum(amount) FILTER (td), 2) AS today_revenue, round(sum(amount) FILTER (NOT td), 2) AS previous_revenue,
  count(*) FILTER (td) AS today_orders, count(*) FILTER (NOT td) AS previous_orders,
  count(DISTINCT customer_id) FILTER (td) AS today_customers, count(DISTINCT customer_id) FILTER (NOT td) AS previous_customers
  FROM (SELECT *, CAST(created_at AS DATE) = CAST({TXN} AS DATE) AS td FROM tx
    WHERE created_at >= CAST({TXN} AS DATE) - INTERVAL 1 DAY))""",
        """SELECT *, round((today_revenue - previous_revenue) / nullif(previous_revenue, 0) * 100, 2) AS revenue_change_percent,
  round((today_orders - previous_orders) / nullif(previous_orders, 0)::DOUBLE * 100, 2) AS orders_change_percent,
  round((today_customers - previous_customers) / nullif(previous_customers, 0)::DOUBLE * 100, 2) AS customers_change_percent FROM d""",
    ),
)
def _(t):
    return service.day_over_day(t.transactions, tx_now(t))


@register(
    "dec5_top_customers",
    ctes(
        "tx",
        """SELECT customer_id, c_name AS customer_name, total_spent, total_orders, last_order_date FROM (
  SELECT customer_id, round(sum(amount), 2) AS total_spent, count(*) AS total_orders, max(created_at) AS last_order_date
  FROM tx GROUP BY 1 ORDER BY total_spent DESC, customer_id LIMIT 10) LEFT JOIN customer ON c_custkey = customer_id""",
    ),
)
def _(t):
    names = t.raw("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"))
    return service.top_customers(t.transactions, names)


@register(
    "dec6_top_products_growth",
    more(
        "sales",
        f"""g AS (SELECT product_id, count(*) FILTER (n) AS sales, round(sum(amount) FILTER (n), 2) AS revenue,
  round(sum(amount) FILTER (NOT n), 2) AS previous_revenue
  FROM (SELECT *, created_at >= {SAN} - INTERVAL 30 DAY AS n FROM sales WHERE created_at >= {SAN} - INTERVAL 60 DAY)
  GROUP BY 1 HAVING count(*) FILTER (n) > 0 ORDER BY revenue DESC, product_id LIMIT 10)""",
        """SELECT product_id, g.sales, revenue, previous_revenue,
  round((revenue - previous_revenue) / nullif(previous_revenue, 0) * 100, 6) AS growth_rate,
  coalesce(p_name, 'Product ' || product_id) AS name, coalesce(p_brand, 'Unknown') AS category
FROM g LEFT JOIN part ON p_partkey = product_id""",
    ),
)
def _(t):
    return rounded(service.top_products_with_growth(t.sales, t.products, sale_now(t)))


@register(
    "dec7_realtime_sessions",
    more(
        "ev",
        SESSIONS,
        f"""SELECT round(count(*) FILTER (purchases > 0) / count(*)::DOUBLE * 100, 6) AS conversion_rate,
  round(avg(duration_seconds), 6) AS avg_session_duration, round(count(*) FILTER (events = 1) / count(*)::DOUBLE, 6) AS bounce_rate,
  (SELECT count(DISTINCT customer_id) FROM ev WHERE event_ts >= {EVN} - INTERVAL 5 MINUTE) AS active_users,
  round((SELECT count(*) FROM ev WHERE event_ts >= {EVN} - INTERVAL 5 MINUTE) / 300.0::DOUBLE, 6) AS events_per_second,
  round((SELECT coalesce(sum(amount), 0) FROM ev WHERE event_ts >= {EVN} - INTERVAL 5 MINUTE) / 5.0::DOUBLE, 6) AS revenue_per_minute
FROM sess""",
    ),
)
def _(t):
    return rounded(service.realtime_sessions(t.events, sessionize(t.events), ev_now(t)))


@register(
    "dec8_campaign_over_time",
    ctes(
        "camp",
        f"""SELECT campaign_id, CAST(event_ts AS DATE) AS date, CAST(sum(impressions) AS BIGINT) AS impressions,
  CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(conversions) AS BIGINT) AS conversions, round(sum(spend), 6) AS spend,
  round(sum(revenue), 6) AS revenue FROM camp WHERE event_ts >= {EVN} - INTERVAL 30 DAY GROUP BY 1, 2""",
    ),
)
def _(t):
    return rounded(service.campaign_over_time(t.campaigns, ev_now(t), "30d"))


@register(
    "dec9_behavior_summary",
    ctes(
        "ev",
        """SELECT count(DISTINCT customer_id) AS unique_customers, round(avg(value), 6) AS avg_engagement,
  (SELECT string_agg(event_type, ',' ORDER BY n DESC, event_type) FROM
    (SELECT event_type, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3)) AS top_actions,
  (SELECT string_agg(device_type, ',' ORDER BY n DESC, device_type) FROM
    (SELECT device_type, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3)) AS top_devices FROM ev""",
    ),
)
def _(t):
    df = service.behavior_summary(t.events)
    joined = {c: F.array_join(c, ",") for c in ("top_actions", "top_devices")}
    return rounded(df.withColumns(joined))


@register(
    "dec10_transaction_overview",
    ctes(
        "tx",
        """SELECT round(sum(amount), 2) AS total_revenue, count(*) AS total_transactions, round(avg(amount), 2) AS avg_transaction_value,
  round(count(*) FILTER (status = 'completed') / count(*)::DOUBLE * 100, 6) AS success_rate,
  (SELECT string_agg(status || '=' || n, ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM tx GROUP BY 1)) AS status_breakdown
FROM tx""",
    ),
)
def _(t):
    df = service.transaction_overview(t.transactions)
    pairs = F.transform(
        F.map_entries("status_breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return rounded(df.withColumn("status_breakdown", F.array_join(pairs, ",")))


@register(
    "dec11_funnel",
    more(
        "ev",
        """u AS (SELECT customer_id, min(event_ts) FILTER (event_type = 'page_view') AS a,
  min(event_ts) FILTER (event_type = 'add_to_cart') AS b, min(event_ts) FILTER (event_type = 'purchase') AS c FROM ev GROUP BY 1),
n AS (SELECT count(*) FILTER (a IS NOT NULL) AS na, count(*) FILTER (b > a) AS nb, count(*) FILTER (b > a AND c > b) AS nc FROM u)""",
        """SELECT 1 AS step, 'page_view' AS stage, na AS customers, round(na / nullif(na, 0)::DOUBLE * 100, 6) AS from_start, round(na / nullif(na, 0)::DOUBLE * 100, 6) AS from_previous FROM n
UNION ALL SELECT 2, 'add_to_cart', nb, round(nb / nullif(na, 0)::DOUBLE * 100, 6), round(nb / nullif(na, 0)::DOUBLE * 100, 6) FROM n
UNION ALL SELECT 3, 'purchase', nc, round(nc / nullif(na, 0)::DOUBLE * 100, 6), round(nc / nullif(nb, 0)::DOUBLE * 100, 6) FROM n""",
    ),
)
def _(t):
    return rounded(service.funnel(t.events, ["page_view", "add_to_cart", "purchase"]))


@register(
    "dec12_revenue_trend",
    more(
        "tx",
        "m AS (SELECT date_trunc('month', created_at)::TIMESTAMP AS period, round(sum(amount), 2) AS revenue, count(*) AS orders FROM tx GROUP BY 1)",
        """SELECT *, lag(revenue) OVER (ORDER BY period) AS previous_revenue,
  round((revenue - lag(revenue) OVER (ORDER BY period)) / nullif(lag(revenue) OVER (ORDER BY period), 0) * 100, 2) AS change_percent FROM m""",
    ),
)
def _(t):
    return service.revenue_trend(t.transactions)


@register(
    "win10_period_over_period",
    more(
        "tx",
        "m AS (SELECT date_trunc('day', created_at)::TIMESTAMP AS period, round(sum(amount), 2) AS revenue, count(*) AS orders FROM tx GROUP BY 1)",
        """SELECT *, lag(revenue) OVER (ORDER BY period) AS previous_revenue,
  round((revenue - lag(revenue) OVER (ORDER BY period)) / nullif(lag(revenue) OVER (ORDER BY period), 0) * 100, 2) AS change_percent FROM m""",
    ),
)
def _(t):
    return service.revenue_trend(t.transactions, "day")


@register(
    "dec13_user_account",
    ctes(
        "cust",
        f"""SELECT customer_id AS user_id, total_orders AS login_count, last_order_date AS last_login,
  CAST(date_diff('day', created_at, {TXN}) AS INTEGER) AS account_age_days, coalesce(status = 'active', false) AS is_active,
  balance > 0 AS is_verified, segment AS role FROM cust""",
    ),
)
def _(t):
    return service.user_account(users(t), tx_now(t))
