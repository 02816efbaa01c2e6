"""Batch marts: customer 360, RFM, products, days, devices and the run aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.functions.scalars import as_column, percent, ratio
from eventmill.operators.ordering import ntile_columns
from eventmill.session import stage


def _is(event_type: str) -> Column:
    return F.col("event_type") == event_type


def stamp(df: DataFrame, aggregation_type: str, created_at=None) -> DataFrame:
    """Literal aggregation type and creation time of a gold row."""
    when = F.current_timestamp() if created_at is None else as_column(created_at)
    return df.withColumns({"aggregation_type": F.lit(aggregation_type), "created_at": when})


def customer_360(events: DataFrame, as_of) -> DataFrame:
    """Lifetime behaviour per customer.

    Distinct counts shuffle on (customer, value) pairs after a map-side combine,
    so a hot customer is spread by value. Event ids and devices are counted from
    their own distinct pairs, on narrow scans: in one aggregation every row would
    be expanded once per distinct column, and a set aggregate beside them would
    sort all expanded rows. The parts are few rows per customer; one grouping of
    their union puts them together, NULL customers like all others. A customer's
    devices come as one array: they are classes, not device ids, so it is short.
    """
    as_of = as_column(as_of)
    devices = events.select("customer_id", "device_type").distinct()
    ids = (
        events.filter(F.col("event_type").isin("page_view", "purchase") & F.col("event_id").isNotNull())
        .select("customer_id", "event_type", "event_id")
        .distinct()
        .groupBy("customer_id")
        .agg(F.count_if(_is("page_view")).alias("page_views"), F.count_if(_is("purchase")).alias("purchases"))
    )
    totals = events.groupBy("customer_id").agg(
        F.count("*").alias("total_events"),
        F.count_distinct("session_id").alias("total_sessions"),
        F.sum("amount").alias("total_spent"),
        F.avg("amount").alias("avg_order_value"),
        F.min("event_ts").alias("first_seen"),
        F.max("event_ts").alias("last_seen"),
        F.count_distinct("product_id").alias("unique_products_viewed"),
    )
    parts = totals.unionByName(ids, allowMissingColumns=True).unionByName(devices, allowMissingColumns=True)
    single = [c for c in parts.columns if c not in ("customer_id", "device_type")]
    per_customer = parts.groupBy("customer_id").agg(
        *[F.max(c).alias(c) for c in single], F.array_sort(F.collect_list("device_type")).alias("devices_used")
    )
    return (
        per_customer.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("page_views", "purchases")})
        .withColumn("days_since_first_seen", F.date_diff(as_of, F.col("first_seen")))
        .withColumn("days_since_last_seen", F.date_diff(as_of, F.col("last_seen")))
        .withColumn("purchase_frequency", ratio(F.col("purchases"), F.col("days_since_first_seen") + 1))
        .withColumn("engagement_score", F.col("total_events") * 0.3 + F.col("purchases") * 0.7)
    )


def rfm_base(events: DataFrame, as_of) -> DataFrame:
    return (
        events.filter(_is("purchase"))
        .groupBy("customer_id")
        .agg(
            F.max("event_ts").alias("last_purchase"),
            F.count("*").alias("frequency"),
            F.sum("amount").alias("monetary"),
        )
        .select(
            "customer_id",
            F.date_diff(as_column(as_of), F.col("last_purchase")).alias("recency"),
            "frequency",
            "monetary",
        )
    )


def rfm_segments(base: DataFrame, reference_direction: bool = False) -> DataFrame:
    """Quintile scores and segment.

    Five is best by default. ``reference_direction`` keeps the plain quintile
    number of a best-first order (one is best), with the same thresholds.
    """
    base = stage(base, "rfm")
    best_first = {"recency": False, "frequency": True, "monetary": True}
    tiles = ntile_columns(base, best_first, "customer_id", 5)
    scores = {f"{c[0]}_score": t if reference_direction else F.lit(6) - t for c, t in tiles.items()}
    total = F.col("r_score") + F.col("f_score") + F.col("m_score")
    return (
        base.withColumns(scores)
        .withColumn("rfm_score", total)
        .withColumn(
            "segment",
            F.when(F.col("rfm_score") >= 12, "VIP")
            .when(F.col("rfm_score") >= 9, "Premium")
            .when(F.col("rfm_score") >= 6, "Standard")
            .otherwise("Basic"),
        )
    )


def product_analytics(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(
            F.count("*").alias("total_interactions"),
            F.count_distinct("customer_id").alias("unique_customers"),
            F.count_if(_is("page_view")).alias("views"),
            F.count_if(_is("add_to_cart")).alias("add_to_cart"),
            F.count_if(_is("purchase")).alias("purchases"),
            F.sum("amount").alias("revenue"),
            F.avg("amount").alias("avg_price"),
        )
        .withColumn("conversion_rate", percent(F.col("purchases"), F.col("views")))
        .withColumn("cart_conversion_rate", percent(F.col("purchases"), F.col("add_to_cart")))
    )


def daily_metrics(events: DataFrame) -> DataFrame:
    return (
        events.filter(_is("purchase"))
        .groupBy(F.to_date("event_ts").alias("date"))
        .agg(
            F.count("*").alias("total_orders"),
            F.count_distinct("customer_id").alias("unique_customers"),
            F.sum("amount").alias("revenue"),
            F.avg("amount").alias("avg_order_value"),
        )
        .orderBy("date")
    )


def device_performance(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("device_type", F.to_date("event_ts").alias("date"))
        .agg(
            F.count("*").alias("events"),
            F.count_distinct("customer_id").alias("unique_users"),
            F.count_if(_is("purchase")).alias("conversions"),
            F.sum("amount").alias("revenue"),
        )
        .withColumn("conversion_rate", percent(F.col("conversions"), F.col("events")))
    )


def segment_distribution(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "segment")


def date_range(daily: DataFrame) -> DataFrame:
    return daily.agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("days")
    )


# --- run aggregates --------------------------------------------------------------
def action_summary(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("event_type").alias("action")).agg(
        F.count("*").alias("event_count"),
        F.sum("value").alias("total_value"),
        F.avg("value").alias("avg_value"),
        F.count_distinct("customer_id").alias("unique_customers"),
    )


def _hour(column: str) -> Column:
    return F.date_format(F.date_trunc("hour", column), "yyyy-MM-dd HH:mm:ss")


def hourly_customer_summary(events: DataFrame) -> DataFrame:
    return events.groupBy(_hour("event_ts").alias("hour")).agg(
        F.count("*").alias("event_count"),
        F.sum("value").alias("total_value"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count_distinct("event_type").alias("unique_actions"),
    )


def transaction_status_summary(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("status").agg(
        F.count("*").alias("transaction_count"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
    )


def hourly_revenue(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy(_hour("created_at").alias("hour")).agg(
        F.count("*").alias("transaction_count"),
        F.sum("amount").alias("total_revenue"),
        F.avg("amount").alias("avg_transaction_value"),
        F.count_distinct("customer_id").alias("unique_customers"),
    )


def metric_summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("metric_name").agg(
        F.count("*").alias("measurement_count"),
        F.avg("value").alias("avg_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.stddev_samp("value").alias("stddev_value"),
    )


def metric_timeseries(metrics: DataFrame, minutes: int = 5) -> DataFrame:
    start = F.window("event_ts", f"{minutes} minutes").getField("start")
    return metrics.groupBy(
        F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("time_bucket"), "metric_name"
    ).agg(F.avg("value").alias("avg_value"), F.count("*").alias("measurement_count"))


def run_summary(streams: dict[str, DataFrame], run_id: str, start, end, finished_at) -> DataFrame:
    """One row per run: bounds, duration and the count of each stream.

    Each stream contributes partial counts to one union; nothing is collected.
    """
    tagged = None
    for name, df in streams.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stream"), "n")
        tagged = one if tagged is None else tagged.unionByName(one)
    counts = [F.sum(F.when(F.col("stream") == n, F.col("n"))).alias(f"{n}_count") for n in streams]
    seconds = (F.unix_millis(as_column(finished_at)) - F.unix_millis(as_column(start))) / 1000.0
    return tagged.agg(F.sum("n").alias("total_events_processed"), *counts).select(
        F.lit(run_id).alias("pipeline_run_id"),
        as_column(start).alias("start_time"),
        as_column(end).alias("end_time"),
        seconds.alias("processing_duration_seconds"),
        "total_events_processed",
        *[f"{n}_count" for n in streams],
        F.lit("completed").alias("status"),
    )
