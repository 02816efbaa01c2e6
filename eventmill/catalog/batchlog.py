"""Queries: batch log, rates, quality."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventmill.catalog.registry import ctes, more, register, rounded
from eventmill.functions.scalars import latest
from eventmill.operators import batchlog, quality
from eventmill.operators.ordering import newest_per_key, page, page_with_totals, top_k
from eventmill.schemas import SOURCE_TABLES

SEC = "(epoch_us(processing_end) - epoch_us(processing_start)) / 1000000.0::DOUBLE"
SUMMARY = f"""count(*) AS total_batches, count(processing_end) AS successful_batches,
  CAST(sum(record_count) AS BIGINT) AS total_records, round(coalesce(sum({SEC}), 0), 6) AS total_seconds,
  round(sum(record_count) / count(*)::DOUBLE, 6) AS avg_records_per_batch,
  round(coalesce(sum({SEC}) / nullif(count(processing_end), 0), 0), 6) AS avg_seconds,
  round(sum(record_count) / nullif(sum({SEC}), 0)::DOUBLE, 6) AS records_per_second"""
EVN = "(SELECT max(ts) FROM events)"


@register("agg45_processing_summary", ctes("blog", f"SELECT {SUMMARY} FROM blog"))
def _(t):
    return rounded(batchlog.processing_summary(t.batch_log))


@register("agg45_processing_by_table", ctes("blog", f"SELECT table_name, {SUMMARY} FROM blog GROUP BY 1"))
def _(t):
    return rounded(batchlog.processing_summary(t.batch_log, by_table=True))


@register(
    "agg45_processing_last_week",
    ctes("blog", f"SELECT {SUMMARY} FROM blog WHERE processing_start >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 10080 MINUTE"),
)
def _(t):
    return rounded(batchlog.processing_summary(t.batch_log, latest(t.raw("orders"), "o_orderdate"), 10080))


@register(
    "agg46_metric_state",
    ctes(
        "met",
        """SELECT metric_name, max_by(value, (event_ts, sample_id)) AS current, round(avg(value), 6) AS average,
  max(value) AS max, min(value) AS min, count(*) AS samples FROM met GROUP BY 1""",
    ),
)
def _(t):
    return rounded(batchlog.metric_state(t.metrics))


@register(
    "agg47_batch_statistics",
    ctes(
        "blog",
        f"""SELECT count(processing_end) AS batches_processed, count(*) - count(processing_end) AS batches_failed,
  CAST(sum(record_count) FILTER (processing_end IS NOT NULL) AS BIGINT) AS items_processed,
  round(avg(record_count) FILTER (processing_end IS NOT NULL), 6) AS average_batch_size,
  round(avg({SEC}), 6) AS average_processing_seconds FROM blog""",
    ),
)
def _(t):
    return rounded(batchlog.batch_statistics(t.batch_log))


@register(
    "agg48_success_rates",
    more(
        "blog",
        f"""r AS (SELECT CAST(sum(record_count) AS BIGINT) AS received,
  CAST(coalesce(sum(record_count) FILTER (processing_end IS NULL), 0) AS BIGINT) AS errors, avg({SEC}) * 1000 AS ms FROM blog)""",
        """SELECT received, errors, round(ms, 6) AS avg_processing_ms,
  round((received - errors) / received::DOUBLE * 100, 6) AS success_rate_percent,
  round(errors / received::DOUBLE * 100, 6) AS error_rate_percent FROM r""",
    ),
)
def _(t):
    return rounded(batchlog.success_rates(t.batch_log))


@register(
    "agg49_describe",
    """SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev,
  round(min(value), 6) AS min, round(max(value), 6) AS max FROM events""",
)
def _(t):
    parts = {"count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    return rounded(t.raw("events").agg(*[f("value").alias(n) for n, f in parts.items()]))


@register("agg50_filtered_average", "SELECT round(avg(value), 6) AS avg_value FROM events WHERE value > 50")
def _(t):
    return rounded(t.raw("events").filter("value > 50").agg(F.avg("value").alias("avg_value")))


@register(
    "win3_latest_per_customer",
    ctes(
        "ev",
        """SELECT customer_id, event_id, event_type, event_ts, value FROM ev
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY event_ts DESC, event_id DESC) = 1""",
    ),
)
def _(t):
    rows = t.events.select("customer_id", "event_id", "event_type", "event_ts", "value")
    return newest_per_key(rows, ["customer_id"], ["event_ts", "event_id"])


@register(
    "win5_two_hour_rate",
    ctes(
        "ev",
        """SELECT second, CAST(sum(n) OVER w AS BIGINT) AS recent_events,
  round(sum(n) OVER w / greatest(1, second - min(second) OVER w)::DOUBLE, 6) AS events_per_second
FROM (SELECT CAST(floor(epoch_us(event_ts) / 1000000) AS BIGINT) AS second, count(*) AS n FROM ev GROUP BY 1)
WINDOW w AS (ORDER BY second RANGE BETWEEN 7199 PRECEDING AND CURRENT ROW)""",
    ),
)
def _(t):
    return rounded(batchlog.trailing_rate(t.events, 7200))


for _n in (50, 120, 10):
    register(
        f"win4_newest_{_n}",
        ctes("ev", f"SELECT event_id, event_type, event_ts, value FROM ev ORDER BY event_ts DESC, event_id DESC LIMIT {_n}"),
    )(lambda t, n=_n: batchlog.newest_events(t.events, n).select("event_id", "event_type", "event_ts", "value"))


@register(
    "win4_newest_per_type",
    ctes(
        "ev",
        """SELECT event_type, event_id, CAST(row_number() OVER w AS INTEGER) AS rank FROM ev
WINDOW w AS (PARTITION BY event_type ORDER BY event_ts DESC, event_id DESC) QUALIFY row_number() OVER w <= 10""",
    ),
)
def _(t):
    return batchlog.newest_per_group(t.events, ["event_type"], 10).select("event_type", "event_id", "rank")


@register(
    "win5_trailing_rate",
    ctes(
        "ev",
        """SELECT second, CAST(sum(n) OVER w AS BIGINT) AS recent_events,
  round(sum(n) OVER w / greatest(1, second - min(second) OVER w)::DOUBLE, 6) AS events_per_second
FROM (SELECT CAST(floor(epoch_us(event_ts) / 1000000) AS BIGINT) AS second, count(*) AS n FROM ev GROUP BY 1)
WINDOW w AS (ORDER BY second RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    ),
)
def _(t):
    return rounded(batchlog.trailing_rate(t.events))


@register(
    "win5_current_rate",
    ctes(
        "ev",
        f"""SELECT count(*) AS recent_events, CASE WHEN max(event_ts) < {EVN} - INTERVAL 2 SECOND THEN 0.0::DOUBLE
  ELSE count(*) / 5.0::DOUBLE END AS events_per_second FROM ev WHERE event_ts >= {EVN} - INTERVAL 5 SECOND AND event_ts <= {EVN}""",
    ),
)
def _(t):
    return batchlog.current_rate(t.events, latest(t.raw("events"), "ts"))


@register(
    "win6_sample_rate",
    ctes(
        "met",
        """SELECT sample_id, metric_name, round(CASE WHEN event_ts > first_value(event_ts) OVER w THEN
  greatest((value - first_value(value) OVER w) / ((epoch_us(event_ts) - epoch_us(first_value(event_ts) OVER w)) / 1000000.0::DOUBLE), 0)
  END, 6) AS rate
FROM met WINDOW w AS (PARTITION BY metric_name ORDER BY event_ts, sample_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
    ),
)
def _(t):
    return rounded(batchlog.sample_rate(t.metrics).select("sample_id", "metric_name", "rate"))


@register(
    "win7_trailing_mean",
    ctes(
        "met",
        """SELECT sample_id, metric_name, round(avg(value) OVER w, 8) AS trailing_mean, count(*) OVER w AS measurements
FROM met WINDOW w AS (PARTITION BY metric_name ORDER BY event_ts, sample_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""",
    ),
)
def _(t):
    means = batchlog.trailing_mean(t.metrics)
    return rounded(means.select("sample_id", "metric_name", "trailing_mean", "measurements"), 8)


@register(
    "win8_running_batch_averages",
    ctes(
        "blog",
        f"""SELECT batch_id, table_name, CAST(row_number() OVER w AS BIGINT) AS batches_processed,
  round(avg(record_count) OVER w, 9) AS average_batch_size, round(avg({SEC}) OVER w, 9) AS average_processing_seconds
FROM blog WHERE processing_end IS NOT NULL
WINDOW w AS (PARTITION BY table_name ORDER BY processing_start, batch_id ROWS UNBOUNDED PRECEDING)""",
    ),
)
def _(t):
    return rounded(batchlog.running_batch_averages(t.batch_log), 9)


@register(
    "lim1_order_by_keys",
    ctes("tx", "SELECT status, payment_method, count(*) AS n FROM tx GROUP BY 1, 2 ORDER BY n DESC, 1, 2"),
)
def _(t):
    counts = t.transactions.groupBy("status", "payment_method").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "status", "payment_method")


PAGE = """SELECT customer_id, name, segment, (SELECT count(*) FROM cust) AS total, (SELECT count(*) FROM cust) > {end} AS has_next,
  {prev} AS has_previous FROM cust ORDER BY customer_id LIMIT {limit} OFFSET {offset}"""
for _label, _offset, _limit in (("first", 0, 25), ("third", 50, 25)):
    register(
        f"lim2_customer_page_{_label}",
        ctes("cust", PAGE.format(end=_offset + _limit, prev=str(_offset > 0).lower(), limit=_limit, offset=_offset)),
    )(
        lambda t, o=_offset, n=_limit: page_with_totals(
            t.customers.select("customer_id", "name", "segment"), [F.asc("customer_id")], o, n
        )
    )


@register(
    "lim2_deep_event_page",
    "SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id LIMIT 9000 OFFSET 1001",
)
def _(t):
    deep = page(t.raw("events"), [F.desc("ts"), F.asc("event_id")], 1001, 9000, by_rank=True)
    return deep.select("event_id", "user_id", "value")


@register(
    "lim3_top_products_by_volume",
    "SELECT l_partkey AS product_id, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1 ORDER BY quantity DESC, 1 LIMIT 10",
)
def _(t):
    totals = t.raw("lineitem").groupBy(F.col("l_partkey").alias("product_id")).agg(F.sum("l_quantity").alias("quantity"))
    return top_k(totals, [F.desc("quantity"), F.asc("product_id")], 10)


# --- quality -----------------------------------------------------------------------
def _null_rows(table: str, columns: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS null_percentage FROM {table}"""
        for c in columns
    )


EV_COLUMNS = ["event_id", "customer_id", "event_type", "event_ts", "value", "amount", "product_id"]


@register("agg41_column_nulls", ctes("ev", _null_rows("ev", EV_COLUMNS)))
def _(t):
    return rounded(quality.column_nulls(t.events.select(*EV_COLUMNS)))


def _text(df, *columns):
    return df.withColumns({c: F.array_join(c, "; ") for c in columns})


@register(
    "agg41_quality_report",
    ctes(
        "ev",
        """SELECT 'events' AS table_name, (SELECT count(*) FROM ev) AS total_records, 4 AS total_columns,
  (SELECT count(*) FROM ev) - count(*) AS duplicate_count,
  round(((SELECT count(*) FROM ev) - count(*)) * 100.0::DOUBLE / (SELECT count(*) FROM ev), 6) AS duplicate_percentage,
  round(0.8 * 0.85::DOUBLE, 6) AS quality_score, 'high duplicate percentage; rule failed: small value' AS issues,
  'moderate null percentage: amount' AS warnings, false AS passed
FROM (SELECT DISTINCT event_type, device_type, amount, category FROM ev)""",
    ),
)
def _(t):
    rule = quality.Rule("small value", F.col("amount") > 10)
    fine = quality.Rule("known device", F.col("device_type").isNull())
    columns = t.events.select("event_type", "device_type", "amount", "category")
    return rounded(_text(quality.quality_report(columns, "events", [rule, fine]), "issues", "warnings"))


@register(
    "agg41_quality_orders",
    """SELECT 'orders' AS table_name, count(*) AS total_records, 6 AS total_columns, CAST(0 AS BIGINT) AS duplicate_count,
  0.0::DOUBLE AS duplicate_percentage, 1.0::DOUBLE AS quality_score, '' AS issues, '' AS warnings, true AS passed FROM orders""",
)
def _(t):
    return rounded(_text(quality.quality_report(t.raw("orders"), "orders"), "issues", "warnings"))


@register(
    "agg42_schema_compatibility",
    """SELECT 'field count: expected 7, got 6' AS issue, count(*) AS rows_affected FROM events
UNION ALL SELECT 'missing field: region', count(*) FROM events
UNION ALL SELECT 'type of ts: expected timestamp, got timestamp_ntz', count(*) FROM events
UNION ALL SELECT 'type of value: expected string, got double', count(*) FROM events""",
)
def _(t):
    events = t.spark.read.parquet(f"{t.dir}/events.parquet")  # the schema the file itself has
    expected = T.StructType(
        [f if f.name != "value" else T.StructField("value", T.StringType()) for f in SOURCE_TABLES["events"]]
        + [T.StructField("region", T.StringType())]
    )
    issues = quality.schema_issues(events.schema, expected)
    named = F.explode(F.array(*[F.lit(i) for i in issues])).alias("issue")
    return events.agg(F.count("*").alias("rows_affected")).select(named, "rows_affected")


@register(
    "agg43_validate_batch",
    """SELECT 'lineitem' AS table_name, count(*) AS total_records, true AS passed, true AS overall_passed, '' AS schema_issues,
  CASE WHEN count(*) > 100000 THEN 'partition large datasets' ELSE '' END AS recommendations FROM lineitem""",
)
def _(t):
    report = quality.validate_batch(t.raw("lineitem"), "lineitem", SOURCE_TABLES["lineitem"])
    return _text(report, "schema_issues", "recommendations").select(
        "table_name", "total_records", "passed", "overall_passed", "schema_issues", "recommendations"
    )


@register(
    "agg44_key_nulls",
    ctes(
        "ev",
        """SELECT count(*) AS total_records, count(*) - count(event_id) AS event_id_nulls,
  count(*) - count(amount) AS amount_nulls, count(amount) = count(*) AS valid FROM ev""",
    ),
)
def _(t):
    return quality.key_nulls(t.events, ["event_id", "amount", "not_there"])


@register(
    "udf2_named_rules",
    ctes(
        "ev",
        """SELECT count(*) AS total_records, count(*) FILTER (amount < 0) AS negative_amount,
  count(*) FILTER (event_type = 'purchase' AND amount IS NULL) AS purchase_without_amount,
  count(*) FILTER (value > 100) AS large_value FROM ev""",
    ),
)
def _(t):
    rules = [
        quality.Rule("negative_amount", F.col("amount") < 0),
        quality.Rule("purchase_without_amount", (F.col("event_type") == "purchase") & F.col("amount").isNull()),
        quality.Rule("large_value", F.col("value") > 100),
    ]
    row = quality.profile(t.events, rules, duplicates=False)
    return row.select("total_records", *[F.col(f"broken_{i}").alias(r.name) for i, r in enumerate(rules)])
