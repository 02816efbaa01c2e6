"""Windowed gold metrics and re-aggregations of gold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.functions.scalars import ago, as_column, percent, ratio


def _bounds(df: DataFrame, start, end, created_at=None) -> DataFrame:
    return df.withColumns(
        {
            "window_start": as_column(start).cast("timestamp"),
            "window_end": as_column(end).cast("timestamp"),
            "created_at": F.current_timestamp() if created_at is None else as_column(created_at),
        }
    )


def between(df: DataFrame, column: str, start, end) -> DataFrame:
    """Inclusive time range; plain comparisons, so both bounds reach the parquet scan."""
    c = F.col(column)
    return df.filter((c >= as_column(start)) & (c <= as_column(end)))


def first_seen(events: DataFrame) -> DataFrame:
    """Customers with the time of their first event."""
    known = events.filter(F.col("customer_id").isNotNull())
    return known.groupBy("customer_id").agg(F.min("event_ts").alias("first_seen"))


def window_customer_metrics(events: DataFrame, start, end, created_at=None, known: DataFrame | None = None) -> DataFrame:
    """One row for a time window. ``new_customers`` are those never seen before it.

    ``known`` lists the customers seen before the window; then only the window's events
    are read. Without it the history is reduced to one first-seen time per customer, and
    both counts come from that one grouping.
    """
    inside = F.col("event_ts") >= as_column(start)
    history = events.filter(F.col("event_ts") <= as_column(end))
    if known is not None:
        history = history.filter(inside)
    per_customer = history.groupBy("customer_id").agg(
        F.min("event_ts").alias("first_seen"),
        F.count_if(inside).alias("n"),
        F.sum(F.when(inside, F.coalesce("value", F.lit(0.0)))).alias("v"),
    )
    if known is not None:
        earlier = known.select("customer_id").distinct().withColumn("_known", F.lit(True))
        per_customer = per_customer.join(earlier, "customer_id", "left")
        per_customer = per_customer.withColumn("first_seen", F.when(F.col("_known").isNull(), F.col("first_seen")))
    known = F.col("customer_id").isNotNull()
    active = known & (F.col("n") > 0)
    row = per_customer.agg(
        F.count_if(active).alias("total_customers"),
        F.count_if(active & (F.col("first_seen") >= as_column(start))).alias("new_customers"),
        F.count_if(active).alias("active_customers"),
        F.sum(F.when(known, F.col("n"))).alias("total_events"),
        F.sum("v").alias("_value"),
    ).withColumn("avg_customer_value", F.round(ratio(F.col("_value"), F.col("active_customers")), 2))
    return _bounds(row.drop("_value"), start, end, created_at)


def window_campaign_metrics(campaigns: DataFrame, start, end, created_at=None) -> DataFrame:
    grouped = between(campaigns, "event_ts", start, end).groupBy("campaign_id").agg(
        F.sum("impressions").alias("total_impressions"),
        F.sum("clicks").alias("total_clicks"),
        F.sum("conversions").alias("total_conversions"),
        F.sum("spend").alias("total_spend"),
    )
    rates = {
        "ctr": F.round(percent(F.col("total_clicks"), F.col("total_impressions")), 2),
        "conversion_rate": F.round(percent(F.col("total_conversions"), F.col("total_clicks")), 2),
    }
    return _bounds(grouped.withColumns(rates), start, end, created_at)


def window_event_analytics(events: DataFrame, start, end, created_at=None) -> DataFrame:
    grouped = between(events, "event_ts", start, end).groupBy("event_type").agg(
        F.count("*").alias("event_count"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.sum(F.coalesce("value", F.lit(0.0))).alias("total_revenue"),
    )
    average = F.round(ratio(F.col("total_revenue"), F.col("event_count")), 2)
    return _bounds(grouped.withColumn("avg_revenue", average), start, end, created_at)


def window_segment_metrics(events: DataFrame, segments: DataFrame, start, end, created_at=None) -> DataFrame:
    """Customers, orders and revenue per segment in a window.

    ``segments`` is (customer_id, segment). Events are summed per customer first,
    so the join carries one row per customer and no hot key.
    """
    per_customer = between(events, "event_ts", start, end).groupBy("customer_id").agg(
        F.count("event_type").alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("v")
    )
    grouped = per_customer.join(segments.select("customer_id", "segment"), "customer_id", "left").groupBy("segment").agg(
        F.count("customer_id").alias("customer_count"),
        F.sum("n").alias("total_orders"),
        F.sum("v").alias("total_revenue"),
    )
    average = F.round(ratio(F.col("total_revenue"), F.col("total_orders")), 2)
    return _bounds(grouped.withColumn("avg_order_value", average), start, end, created_at)


# --- five-minute gold metrics, batch form -------------------------------------------
def _rounded(column: str, digits: int | None) -> Column:
    return F.col(column) if digits is None else F.round(column, digits).alias(column)


def windowed_customer_metrics(events: DataFrame, width: str = "5 minutes", digits: int | None = 2) -> DataFrame:
    w = F.window("event_ts", width)
    return events.groupBy(w, F.col("event_type").alias("action"), "device_type").agg(
        F.count("customer_id").alias("event_count"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.avg("value").alias("avg_value"),
        F.sum("value").alias("total_value"),
    ).select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "action",
        "device_type",
        "event_count",
        "unique_customers",
        _rounded("avg_value", digits),
        _rounded("total_value", digits),
    )


def windowed_transaction_metrics(transactions: DataFrame, width: str = "5 minutes", digits: int | None = 2) -> DataFrame:
    w = F.window("created_at", width)
    return transactions.groupBy(w, "status", "payment_method").agg(
        F.count("transaction_id").alias("transaction_count"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
        F.count_distinct("customer_id").alias("unique_customers"),
    ).select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "status",
        "payment_method",
        "transaction_count",
        _rounded("total_amount", digits),
        _rounded("avg_amount", digits),
        "unique_customers",
    )


def hourly_customer_rollup(windowed: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Hour x action x device over windowed metrics. Per-window uniques add up to an upper bound, named so."""
    return (
        windowed.filter(F.col("window_start") >= ago(as_of, hours=hours))
        .groupBy(F.date_trunc("hour", "window_start").alias("hour"), "action", "device_type")
        .agg(
            F.sum("event_count").alias("total_events"),
            F.sum("unique_customers").alias("sum_unique_customers"),
            F.avg("avg_value").alias("avg_engagement"),
        )
    )


def hourly_transaction_rollup(windowed: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return (
        windowed.filter(F.col("window_start") >= ago(as_of, hours=hours))
        .groupBy(F.date_trunc("hour", "window_start").alias("hour"), "status")
        .agg(
            F.sum("transaction_count").alias("total_transactions"),
            F.sum("total_amount").alias("total_revenue"),
            F.avg("avg_amount").alias("avg_transaction_value"),
        )
    )


def reaggregate_actions(gold: DataFrame) -> DataFrame:
    return gold.groupBy("action").agg(
        F.sum("event_count").alias("event_count"),
        F.sum("total_value").alias("total_value"),
        F.avg("avg_value").alias("avg_value"),
        F.sum("unique_customers").alias("sum_unique_customers"),
    )


def reaggregate_metrics(gold: DataFrame) -> DataFrame:
    return gold.groupBy("metric_name").agg(
        F.avg("avg_value").alias("avg_value"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.sum("measurement_count").alias("measurement_count"),
    )


def newest_rows(gold: DataFrame, time: Column, since, limit: int, *ties: str) -> DataFrame:
    """Rows since a time, newest first, at most ``limit`` (a bounded top-k, never a full sort)."""
    return gold.filter(time >= as_column(since)).orderBy(time.desc(), *ties).limit(limit)


def minute_dashboard(windowed: DataFrame, value: str = "total_value", average: str = "avg_value") -> DataFrame:
    """Per-minute rollup of windowed metrics."""
    minute = F.window("window_start", "1 minute")
    return windowed.groupBy(minute).agg(
        F.sum("event_count").alias("total_events_per_minute"),
        F.sum("unique_customers").alias("sum_unique_customers"),
        F.sum(value).alias("total_revenue"),
        F.avg(average).alias("avg_event_value"),
        F.count("*").alias("metric_records"),
    ).select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "total_events_per_minute",
        "sum_unique_customers",
        "total_revenue",
        "avg_event_value",
        "metric_records",
        (F.col("total_events_per_minute") / F.lit(60.0)).alias("events_per_second"),
    )


def dashboard_now(dashboard: DataFrame, as_of, minutes: int = 5, rows: int = 10) -> DataFrame:
    """Totals over the newest dashboard rows, with the newest rate."""
    newest = newest_rows(dashboard, F.col("window_end"), ago(as_of, mins=minutes), rows)
    return newest.agg(
        F.coalesce(F.sum("total_events_per_minute"), F.lit(0)).alias("total_events"),
        F.coalesce(F.max_by("events_per_second", "window_end"), F.lit(0.0)).alias("events_per_second"),
        F.coalesce(F.sum("sum_unique_customers"), F.lit(0)).alias("total_customers"),
        F.coalesce(F.sum("total_revenue"), F.lit(0.0)).alias("total_revenue"),
    ).withColumn("avg_event_value", F.coalesce(ratio(F.col("total_revenue"), F.col("total_events")), F.lit(0.0)))


def bronze_now(events: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    """The same numbers straight from bronze, in one aggregation."""
    recent = events.filter(F.col("event_ts") >= ago(as_of, mins=minutes))
    return recent.agg(
        F.count("*").alias("total_events"),
        F.count_distinct("customer_id").alias("total_customers"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("total_revenue"),
    ).withColumns(
        {
            "events_per_second": F.col("total_events") / F.lit(minutes * 60.0),
            "avg_event_value": F.coalesce(ratio(F.col("total_revenue"), F.col("total_events")), F.lit(0.0)),
        }
    )


def trend(dashboard: DataFrame, as_of, hours: int = 1) -> DataFrame:
    return (
        dashboard.filter(F.col("window_end") >= ago(as_of, hours=hours))
        .select(
            "window_end", "total_events_per_minute", "events_per_second", "sum_unique_customers", "total_revenue"
        )
        .orderBy("window_end")
    )
