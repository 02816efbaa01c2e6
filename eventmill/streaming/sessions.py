"""Sessions and values with a time to live on streams, by the engine's session windows.

A session lasts until a key was idle for the gap; a counter with a time to live is the
same thing: it starts with the first event, every event renews it, and it is gone when
none came for that long. An event that comes in late joins the two sessions it lies between.
Sessions that the watermark has closed are appended to a table; the open ones are read from
the stream's state, so "now" needs no copy of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from eventmill.streaming.sinks import append_stream

SESSION = "_session"


def windowed_sessions(events: DataFrame, keys: list[str], gap: str, aggregates: dict[str, Column], delay: str | None = None) -> DataFrame:
    """One row per key and session with its bounds: first event, and when it ends unless renewed.

    With ``delay`` also on a stream, in append mode. Events of a task combine before the
    shuffle, so a hot key costs a task one row per session.
    """
    if delay:
        events = events.withWatermark("event_ts", delay)
    grouped = events.groupBy(F.session_window("event_ts", gap).alias(SESSION), *keys)
    rows = grouped.agg(*[c.alias(n) for n, c in aggregates.items()])
    return rows.select(*keys, F.col(f"{SESSION}.start").alias("starts"), F.col(f"{SESSION}.end").alias("ends"), *aggregates)


def customer_aggregates() -> dict[str, Column]:
    """What the batch form counts per session of a customer."""
    return {
        "session_end": F.max("event_ts"),
        "events": F.count("*"),
        "page_views": F.count_if(F.col("event_type") == "page_view"),
        "purchases": F.count_if(F.col("event_type") == "purchase"),
        "revenue": F.sum("amount"),
    }


def counter_aggregates() -> dict[str, Column]:
    """Count and newest event of a counter."""
    newest = F.struct("event_ts", "event_id", "value")
    return {"count": F.count("*"), "newest": F.max(newest)}


def publish_sessions(rows: DataFrame, path: str, checkpoint: str, every: str | None, name: str | None = None) -> StreamingQuery:
    """Closed sessions, each appended once."""
    return append_stream(rows, path, checkpoint, every, name=name)


def open_sessions(spark: SparkSession, checkpoint: str, keys: list[str], aggregates: list[str]) -> DataFrame:
    """Sessions that the last batch of a stream left open, from its state.

    ``aggregates`` names the state's buffers in their order: every aggregate of the stream
    that keeps one value (counts, sums of one kind, maxima).
    """
    state = spark.read.format("statestore").load(checkpoint)
    value = state.schema["value"].dataType
    # buffers of one kind share a name, so fields are named by their place
    window = next(i for i, f in enumerate(value) if {"start", "end"} <= set(getattr(f.dataType, "names", [])))
    rest = [i for i, f in enumerate(value) if i != window and f.name not in keys]
    names = dict(zip(rest, aggregates, strict=True)) | {window: SESSION}
    fields = [T.StructField(names.get(i, f.name), f.dataType) for i, f in enumerate(value)]
    rows = state.select(F.col("value").cast(T.StructType(fields)).alias("v")).select("v.*")
    return rows.select(*keys, F.col(f"{SESSION}.start").alias("starts"), F.col(f"{SESSION}.end").alias("ends"), *aggregates)


def as_sessions(rows: DataFrame) -> DataFrame:
    """The columns of the batch form."""
    length = F.unix_micros("session_end") - F.unix_micros("starts")
    return rows.withColumn("duration_seconds", length / F.lit(1_000_000.0)).withColumnRenamed("starts", "session_start").drop("ends")


def as_counters(rows: DataFrame, as_of: Column) -> DataFrame:
    """Lives of counters, and whether each is alive at ``as_of``."""
    return rows.select(
        "event_type", "starts", "ends", "count", F.col("newest.event_id").alias("latest_event_id"),
        F.col("newest.value").alias("latest_value"), (F.col("ends") > as_of).alias("alive"),
    )
