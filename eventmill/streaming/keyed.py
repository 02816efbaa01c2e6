"""Keyed counters with expiry, and request limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventmill.functions.scalars import ago, as_column
from eventmill.operators.ordering import running_totals
from eventmill.operators.writers import expire_versions, read_current, upsert
from eventmill.streaming.sinks import batch_stream

# Time to live of dashboard values in seconds (fixed values).
TTL_EVENT, TTL_LATEST, TTL_METRICS = 300, 60, 30


def type_counters(events: DataFrame) -> DataFrame:
    """Count and newest event per type. Both combine before the shuffle, so a hot type is one row per task."""
    newest = F.struct("event_ts", "event_id")
    return events.groupBy("event_type").agg(
        F.count("*").alias("count"),
        F.max("event_ts").alias("latest_ts"),
        F.max_by("event_id", newest).alias("latest_event_id"),
        F.max_by("value", newest).alias("latest_value"),
    )


def publish_counters(events: DataFrame, path: str, checkpoint: str, every: str | None) -> StreamingQuery:
    """Counters kept in a small keyed table, one row per type."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            upsert(batch, path, ["event_type"])
            expire_versions(batch.sparkSession, path)

    return batch_stream(type_counters(events), handle, checkpoint, every)


def read_counters(spark, path: str) -> DataFrame:
    """Counters with a total row."""
    rows = read_current(spark, path)
    total = rows.agg(F.lit("total").alias("event_type"), F.sum("count").alias("count"))
    return rows.unionByName(total, allowMissingColumns=True)


def alive(rows: DataFrame, column: str, as_of, ttl_seconds: int) -> DataFrame:
    """Rows whose value has not expired at ``as_of``."""
    return rows.filter(F.col(column) >= ago(as_of, secs=ttl_seconds))


# --- request limits ----------------------------------------------------------------------
# Requests per window by identity and endpoint class (fixed values).
LIMITS = {"anonymous": 100, "authenticated": 1000, "auth": 20, "upload": 10, "ml": 50}
ENDPOINTS = {
    "/api/v1/auth/login": "auth",
    "/api/v1/auth/register": "auth",
    "/api/v1/auth/password-reset": "auth",
    "/api/v1/ml/": "ml",
    "/upload": "upload",
}


@dataclass(frozen=True)
class RequestLimits:
    per_class: dict[str, int]
    window_seconds: int = 60

    def of(self, identifier: Column, path: Column) -> Column:
        """Limit of a request: its identity's, lowered by its endpoint's."""
        base = F.when(identifier.startswith("user:"), self.per_class["authenticated"]).otherwise(self.per_class["anonymous"])
        endpoint = F.lit(None).cast("int")
        for prefix, name in reversed(ENDPOINTS.items()):
            endpoint = F.when(path.startswith(prefix), self.per_class[name]).otherwise(endpoint)
        return F.least(base, endpoint)  # NULL is ignored


def identifier(user_id: Column, ip: Column) -> Column:
    return F.when(user_id.isNotNull(), F.concat(F.lit("user:"), user_id.cast("string"))).otherwise(
        F.concat(F.lit("ip:"), ip)
    )


def _slot(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / seconds)


def check_requests(requests: DataFrame, limits: RequestLimits) -> DataFrame:
    """Verdict per request: position in its fixed window, allowed, remaining, reset time.

    ``requests``: request_id, ts, identifier, path. The position is a running
    count that may span tasks, so one identifier may hold any share of the rows.
    """
    slot = _slot(F.col("ts"), limits.window_seconds)
    rows = running_totals(
        requests.withColumn("_slot", slot),
        ["identifier", "_slot"],
        [F.col("ts"), F.col("request_id")],
        {"n": F.lit(1)},
    )
    limit = limits.of(F.col("identifier"), F.col("path"))
    return rows.withColumns(
        {
            "allowed": F.col("n") <= limit,
            "remaining": F.greatest(F.lit(0), limit - F.col("n")),
            "reset_time": (F.col("_slot") + 1) * limits.window_seconds,
        }
    ).drop("_slot")


def request_counts(requests: DataFrame, limits: RequestLimits, delay: str | None = None) -> DataFrame:
    """Requests per identifier and window; with ``delay`` also on a stream."""
    if delay:
        requests = requests.withWatermark("ts", delay)
    w = F.window("ts", f"{limits.window_seconds} seconds")
    counts = requests.groupBy(w, "identifier").agg(F.count("*").alias("requests"))
    return counts.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "identifier", "requests"
    )


def blocked(counts: DataFrame, limits: RequestLimits) -> DataFrame:
    limit = limits.of(F.col("identifier"), F.lit(""))
    return counts.withColumn("limit", limit).filter(F.col("requests") > F.col("limit"))


def retry_after(reset_time: Column, now) -> Column:
    return F.greatest(F.lit(0), reset_time - F.unix_seconds(as_column(now)))
