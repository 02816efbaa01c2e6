"""Sessions by inactivity gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessionize(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """One row per session of a customer; a new one starts after more than ``gap_minutes`` idle.

    Events are first combined into buckets as wide as the gap. Two events in one
    bucket can never be further apart than the gap, so a bucket lies in exactly
    one session and the gap test only compares neighbouring buckets. The window
    below therefore sees one row per customer and bucket, however hot a customer
    is, and the combine runs before the shuffle.
    """
    gap = gap_minutes * 60 * 1_000_000
    micros = F.unix_micros("event_ts")
    buckets = (
        events.withColumn("_bucket", F.floor(micros / gap))
        .groupBy("customer_id", "_bucket")
        .agg(
            F.min("event_ts").alias("first_ts"),
            F.max("event_ts").alias("last_ts"),
            F.count("*").alias("events"),
            F.count_if(F.col("event_type") == "page_view").alias("page_views"),
            F.count_if(F.col("event_type") == "purchase").alias("purchases"),
            F.sum("amount").alias("revenue"),
        )
    )
    by_time = Window.partitionBy("customer_id").orderBy("_bucket")
    idle = F.unix_micros("first_ts") - F.unix_micros(F.lag("last_ts").over(by_time))
    numbered = buckets.withColumn("_starts", F.when(idle.isNull() | (idle > gap), 1).otherwise(0)).withColumn(
        "session_no", F.sum("_starts").over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        numbered.groupBy("customer_id", "session_no")
        .agg(
            F.min("first_ts").alias("session_start"),
            F.max("last_ts").alias("session_end"),
            F.sum("events").alias("events"),
            F.sum("page_views").alias("page_views"),
            F.sum("purchases").alias("purchases"),
            F.sum("revenue").alias("revenue"),
        )
        .withColumn(
            "duration_seconds",
            (F.unix_micros("session_end") - F.unix_micros("session_start")) / F.lit(1_000_000.0),
        )
    )
