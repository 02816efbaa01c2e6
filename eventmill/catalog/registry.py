"""Registered queries: a Spark callable and, where SQL can say it, the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventmill.sources.canonical import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # the oracles' times are UTC
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 6, cents: tuple[str, ...] = ()) -> DataFrame:
    """Round doubles so that the order of additions cannot change the result.

    ``cents`` names large money sums, whose last digits depend on that order.
    """

    def one(field):
        column = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, T.DoubleType):
            return column
        return F.round(column, 2 if field.name in cents else digits).alias(field.name)

    return df.select(*[one(f) for f in df.schema])


# --- the canonical frames again, for DuckDB -----------------------------------
_CTE = {
    "ev": """ev AS (
  SELECT event_id, user_id AS customer_id,
    CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'add_to_cart' ELSE event_type END AS event_type,
    ts AS event_ts, value, CASE WHEN event_type = 'purchase' THEN value END AS amount,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS campaign_id,
    CASE event_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device_type,
    CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 6 WHEN 0 THEN 'electronics' WHEN 1 THEN 'clothing'
      WHEN 2 THEN 'books' WHEN 3 THEN 'home' WHEN 4 THEN 'sports' ELSE 'food' END AS category,
    's' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id
  FROM events)""",
    "tx": """tx AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_totalprice AS amount,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
    o_orderpriority AS payment_method, o_orderdate AS created_at
  FROM orders)""",
    "sales": """sales AS (
  SELECT l_partkey AS product_id, l_orderkey AS transaction_id, l_suppkey AS supplier_id,
    l_extendedprice AS amount, l_shipdate AS created_at
  FROM lineitem)""",
    "cust": """cust0 AS (
  SELECT c_custkey AS customer_id, c_name AS name, c_nationkey AS nation_key, c_acctbal AS balance,
    c_mktsegment AS segment, coalesce(n, 0) AS total_orders, coalesce(s, 0.0) AS total_spent,
    created_at, last_order_date,
    date_diff('day', last_order_date, (SELECT max(o_orderdate) FROM orders)) AS age
  FROM customer LEFT JOIN (
    SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s, min(o_orderdate) AS created_at,
      max(o_orderdate) AS last_order_date FROM orders GROUP BY 1) ON o_custkey = c_custkey),
cust AS (
  SELECT * EXCLUDE (age),
    CASE WHEN age <= 90 THEN 'active' WHEN age <= 365 THEN 'inactive' ELSE 'churned' END AS status,
    CASE WHEN total_orders >= 12 THEN 'loyal' WHEN total_orders >= 8 THEN 'repeat'
      WHEN total_orders >= 1 THEN 'new' END AS lifecycle_stage
  FROM cust0)""",
    "met": """met AS (
  SELECT event_id AS sample_id, event_type AS metric_name, ts AS event_ts, value FROM events)""",
    "camp": """camp AS (
  SELECT campaign_id, event_ts,
    CASE WHEN event_type = 'page_view' THEN 1 ELSE 0 END AS impressions,
    CASE WHEN event_type = 'add_to_cart' THEN 1 ELSE 0 END AS clicks,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS conversions,
    value * 0.1 AS spend, coalesce(amount, 0.0) AS revenue
  FROM ev)""",
    "pas": """pas AS (
  SELECT ts AS passage_time, value AS speed, event_type AS VehicleClass, 'L' || k AS Location0,
    'D' || (k % 20) AS DeviceIndex, 'R' || (k % 5) AS Region, 80.0::DOUBLE AS SpeedLimit
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))""",
    "trf": """trf AS (
  SELECT epoch_ms(date_trunc('hour', passage_time)) AS window_start,
    epoch_ms(date_trunc('hour', passage_time) + INTERVAL 1 HOUR) AS window_end,
    strftime(date_trunc('hour', passage_time), '%Y-%m-%d') AS processing_date,
    VehicleClass, Location0, DeviceIndex, Region, SpeedLimit,
    avg(speed) AS avg_speed, count(*) AS vehicle_count,
    count(*) FILTER (speed > SpeedLimit) AS violation_count
  FROM pas GROUP BY ALL)""",
    "blog": """blog AS (
  SELECT o_orderkey AS batch_id, o_orderpriority AS table_name, n AS record_count, o_orderdate AS processing_start,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_seconds(n) END AS processing_end,
    CAST(q AS BIGINT) AS bytes_processed
  FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
    ON l_orderkey = o_orderkey)""",
}
_NEEDS = {"camp": ["ev"], "trf": ["pas"]}


def ctes(names: str, body: str) -> str:
    """Prefix ``body`` with the canonical frames it uses."""
    order: list[str] = []
    for n in names.split():
        for dep in [*_NEEDS.get(n, []), n]:
            if dep not in order:
                order.append(dep)
    return "WITH " + ",\n".join(_CTE[n] for n in order) + "\n" + body.strip()


def more(names: str, extra: str, body: str) -> str:
    """Like :func:`ctes` with further CTE definitions in between."""
    head = ctes(names, "").rstrip()
    return head + ",\n" + extra.strip() + "\n" + body.strip()
