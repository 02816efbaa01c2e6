"""Streaming medallion: message stream to bronze, silver, gold and dashboard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from eventmill.operators import changes
from eventmill.operators.contracts import apply_contract
from eventmill.operators.parse import CORRUPT, envelope_rows, rejected_rows, silver_events, typed_bronze, usable_rows
from eventmill.operators.rollups import minute_dashboard
from eventmill.schemas import (
    BRONZE_TABLES,
    PAYLOADS,
    TOPIC_ANALYTICS,
    TOPIC_CUSTOMER,
    TOPIC_TRANSACTION,
)
from eventmill.sources.files import make_dirs
from eventmill.sources.tables import Lake
from eventmill.streaming import sinks, windows
from eventmill.streaming.sinks import append_stream
from eventmill.streaming.sources import table_stream

SILVER_TABLES = {
    "customer_events": TOPIC_CUSTOMER,
    "transaction_events": TOPIC_TRANSACTION,
    "analytics_events": TOPIC_ANALYTICS,
}
TYPED_TOPICS = {
    "customer_behavior": TOPIC_CUSTOMER,
    "transactions": TOPIC_TRANSACTION,
    "analytics_metrics": TOPIC_ANALYTICS,
}
# Partition columns come last, in folder order, as a scan returns them: a stream that
# starts on an empty folder maps columns by position once files arrive.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("kafka_timestamp", T.TimestampType()),
        T.StructField("raw_data", T.StringType()),
        T.StructField("processing_timestamp", T.TimestampType()),
        T.StructField("date_partition", T.StringType()),
        T.StructField("topic", T.StringType()),
    ]
)
_TYPED_EXTRA = {"event_timestamp", "kafka_timestamp", "ingestion_timestamp"}


def raw_bronze(lake: Lake, envelope: DataFrame, every: str | None = sinks.RAW_BRONZE, processed_at=None) -> StreamingQuery:
    """Every message as text, partitioned by day and topic."""
    return append_stream(
        envelope_rows(envelope, processed_at),
        lake.path("bronze", "raw_events"),
        lake.checkpoint("bronze_raw_events"),
        every,
        ["date_partition", "topic"],
        "bronze_raw_events",
    )


def raw_stream(lake: Lake, files_per_trigger: int | None = None) -> DataFrame:
    return table_stream(lake.spark, lake.path("bronze", "raw_events"), RAW_SCHEMA, files_per_trigger)


def silver_tables(lake: Lake, every: str | None = sinks.SILVER) -> dict[str, StreamingQuery]:
    """One parsed table per topic, partitioned by day, and :func:`rejected` beside them."""
    return {
        table: append_stream(
            usable_rows(silver_events(raw_stream(lake), topic), PAYLOADS[topic]).drop(CORRUPT),
            lake.path("silver", table),
            lake.checkpoint(f"silver_{table}"),
            every,
            ["date_partition"],
            f"silver_{table}",
        )
        for table, topic in SILVER_TABLES.items()
    } | {"rejected": rejected(raw_stream(lake), lake, "silver", every)}


def rejected(raw: DataFrame, lake: Lake, layer: str, every: str | None, payloads: dict | None = None) -> StreamingQuery:
    """Messages that no table of the layer takes, with their text and the reason."""
    payloads = payloads or {topic: PAYLOADS[topic] for topic in SILVER_TABLES.values()}
    rows = rejected_rows(raw, payloads)
    return append_stream(rows, lake.path(layer, "rejected"), lake.checkpoint(f"{layer}_rejected"), every, name=f"{layer}_rejected")


def typed_bronze_tables(
    lake: Lake, envelope: DataFrame, every: str | None = sinks.TYPED_BRONZE, ingested_at=None
) -> dict[str, StreamingQuery]:
    """Parsed straight from the stream, one table per topic, and the messages none of them takes."""
    out, payloads = {}, {}
    for table, topic in TYPED_TOPICS.items():
        schema = BRONZE_TABLES[table]
        payload = payloads[topic] = type(schema)([f for f in schema if f.name not in _TYPED_EXTRA])
        out[table] = append_stream(
            usable_rows(typed_bronze(envelope, topic, payload, ingested_at), payload),
            lake.path("bronze", table),
            lake.checkpoint(f"bronze_{table}"),
            every,
            name=f"bronze_{table}",
        )
    out["rejected"] = rejected(envelope_rows(envelope, ingested_at), lake, "bronze", every, payloads)
    return out


def typed_stream(lake: Lake, table: str) -> DataFrame:
    return table_stream(lake.spark, lake.path("bronze", table), BRONZE_TABLES[table])


def create_folders(lake: Lake, layer: str, tables: list[str]) -> None:
    """Empty folders for downstream streams to watch.

    A folder written by a stream must hold nothing else: readers then follow the
    writer's commit log and never see files of an unfinished batch.
    """
    make_dirs(lake.spark, *[lake.path(layer, t) for t in tables])


def silver_schema(table: str) -> T.StructType:
    before = [
        T.StructField("kafka_timestamp", T.TimestampType()),
        T.StructField("processing_timestamp", T.TimestampType()),
    ]
    after = [
        T.StructField("event_timestamp", T.TimestampType()),
        T.StructField("date_partition", T.StringType()),
    ]
    return T.StructType(before + list(PAYLOADS[SILVER_TABLES[table]].fields) + after)


def silver_stream(lake: Lake, table: str) -> DataFrame:
    return table_stream(lake.spark, lake.path("silver", table), silver_schema(table))


def gold_metrics(lake: Lake, every: str | None = sinks.GOLD) -> dict[str, StreamingQuery]:
    """Five-minute customer and transaction metrics over silver."""
    jobs = {
        "customer_metrics": ("customer_events", windows.customer_metrics()),
        "transaction_metrics": ("transaction_events", windows.transaction_metrics()),
    }
    return {
        name: windows.publish_metrics(
            silver_stream(lake, table), metric, lake.path("gold", name), lake.checkpoint(f"gold_{name}"), every, name=f"gold_{name}"
        )
        for name, (table, metric) in jobs.items()
    }


def event_rates(lake: Lake, every: str | None = sinks.EVENT_RATE) -> StreamingQuery:
    """Messages per 30 seconds and topic, over raw bronze."""
    return windows.publish_metrics(
        raw_stream(lake), windows.event_rate(), lake.path("gold", "event_rates"), lake.checkpoint("gold_event_rates"), every,
        name="gold_event_rates",
    )


def realtime_metrics(
    events: DataFrame, lake: Lake, every: str | None = sinks.SILVER_METRICS, with_minutes: bool = True
) -> StreamingQuery:
    """30-second metrics and, in the same batches, their per-minute totals."""
    silver, minutes = lake.path("silver", "realtime_metrics"), lake.path("gold", "dashboard_metrics")

    def roll_up(touched: DataFrame, batch_id: int) -> None:
        """Minutes that hold a touched window, summed again from all their windows."""
        spark = touched.sparkSession
        minute = F.date_trunc("minute", "window_start")
        wanted = touched.select(minute.alias("_m")).distinct()
        low, high = wanted.agg(F.min("_m"), F.max(F.col("_m") + F.expr("INTERVAL 1 MINUTE"))).first()
        if low is None:
            return
        near = (F.col("window_start") >= F.lit(low)) & (F.col("window_start") < F.lit(high))
        rows = windows.read_gold(spark, silver, windows.realtime_metrics(), near).withColumn("_m", minute)
        totals = minute_dashboard(rows.join(wanted, "_m", "left_semi"))
        changes.upsert(totals, minutes, ["window_start"], key=f"{sinks.stream_id(spark)}-{batch_id}")

    return windows.publish_metrics(
        events, windows.realtime_metrics(), silver, lake.checkpoint("silver_realtime_metrics"), every,
        after=roll_up if with_minutes else None, name="silver_realtime_metrics",
    )


def read_minutes(lake: Lake) -> DataFrame | None:
    return changes.read_merged(lake.spark, lake.path("gold", "dashboard_metrics"), ["window_start"])


def contract_table(
    lake: Lake, values: DataFrame, contract: dict, table: str, every: str | None = "10 seconds", as_of=None
) -> StreamingQuery:
    """Contract rows appended to bronze, partitioned by year, month and day."""
    return append_stream(
        apply_contract(values, contract, as_of),
        lake.path("bronze", table),
        lake.checkpoint(f"bronze_{table}"),
        every,
        ["year", "month", "day"],
        f"bronze_{table}",
    )


def contract_batches(lake: Lake, values: DataFrame, contract: dict, table: str, as_of=None) -> StreamingQuery:
    """The same through foreachBatch over everything available, each batch written once."""
    handle = sinks.append_batches(lake.path("bronze", table), ["year", "month", "day"])
    return sinks.batch_stream(
        apply_contract(values, contract, as_of), handle, lake.checkpoint(f"bronze_{table}"), None, mode="append"
    )
