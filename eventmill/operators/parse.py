"""Envelope and payload parsing: raw stream rows to bronze and silver rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventmill.functions.scalars import as_column, lenient_timestamp
from eventmill.schemas import EVENT_TOPICS, GENERIC_EVENT, PAYLOADS, TOPIC_ANALYTICS

CORRUPT = "_corrupt_record"


def envelope_rows(envelope: DataFrame, processed_at=None) -> DataFrame:
    """Bronze shape: envelope fields, payload as text, processing time and day partition."""
    now = F.current_timestamp() if processed_at is None else as_column(processed_at)
    return envelope.select(
        "topic",
        "partition",
        "offset",
        F.col("timestamp").alias("kafka_timestamp"),
        F.col("value").cast("string").alias("raw_data"),
        now.alias("processing_timestamp"),
        F.date_format("timestamp", "yyyy-MM-dd").alias("date_partition"),
    )


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])


def parse_payload(rows: DataFrame, column: str, schema: T.StructType, keep: list[str]) -> DataFrame:
    """JSON text to columns; a malformed payload gives NULL fields and its text in ``_corrupt_record``."""
    parsed = F.from_json(
        F.col(column), _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    return rows.select(*keep, parsed.alias("_data")).select(*keep, "_data.*")


def unusable(payload: list[str]) -> Column:
    """No field of the payload could be read."""
    return F.coalesce(*[F.col(c).cast("string") for c in payload]).isNull()


def reject_reason(raw: Column, corrupt: Column) -> Column:
    """Why a payload without a usable field was rejected."""
    return (
        F.when(F.length(F.trim(F.coalesce(raw, F.lit("")))) == 0, "empty")
        .when(corrupt.isNotNull(), "malformed_json")
        .otherwise("no_known_field")
    )


REJECTED = ["topic", "partition", "offset", "kafka_timestamp", "raw_data", "processing_timestamp", "date_partition"]


def rejected_rows(bronze: DataFrame, payloads: dict[str, T.StructType]) -> DataFrame:
    """Messages of raw bronze that no typed table takes, as they came, with the reason.

    Together with :func:`usable_rows` of every topic each message is somewhere, once.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    # the random column keeps the filter above the parsing, which it would otherwise repeat by field
    parsed, reason = bronze.select(*REJECTED, F.rand(0).alias("_once")), None
    for i, (topic, schema) in enumerate(payloads.items()):
        mine = F.col("topic") == topic
        # one pass: a message is parsed by its own topic's schema only
        parsed = parsed.withColumn(f"_p{i}", F.when(mine, F.from_json("raw_data", _with_corrupt(schema), options)))
        nothing = F.coalesce(*[F.col(f"_p{i}.`{c}`").cast("string") for c in schema.names]).isNull()
        why = F.when(nothing, reject_reason(F.col("raw_data"), F.col(f"_p{i}.{CORRUPT}")))
        reason = F.when(mine, why) if reason is None else reason.when(mine, why)
    reason = reason.otherwise("unknown_topic")
    return parsed.filter(reason.isNotNull() & (F.col("_once") >= 0)).select(*REJECTED, reason.alias("reason"))


def usable_rows(parsed: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows with a field that could be read."""
    # the random column keeps the filter above the parsing, which it would otherwise repeat by field
    return parsed.withColumn("_once", F.rand(0)).filter(~unusable(schema.names) & (F.col("_once") >= 0)).drop("_once")


def silver_events(bronze: DataFrame, topic: str, schema: T.StructType | None = None) -> DataFrame:
    """One topic of the raw bronze table as typed rows with an event time."""
    rows = bronze.filter(F.col("topic") == topic)
    flat = parse_payload(
        rows, "raw_data", schema or PAYLOADS[topic], ["kafka_timestamp", "processing_timestamp", "date_partition"]
    )
    return flat.withColumn("event_timestamp", lenient_timestamp(F.col("timestamp")))


def typed_bronze(envelope: DataFrame, topic: str, schema: T.StructType, ingested_at=None) -> DataFrame:
    """Payload columns plus event, envelope and ingestion time, straight from the stream."""
    now = F.current_timestamp() if ingested_at is None else as_column(ingested_at)
    rows = envelope.filter(F.col("topic") == topic).select(
        F.col("value").cast("string").alias("_json"), F.col("timestamp").alias("kafka_timestamp")
    )
    flat = parse_payload(rows, "_json", schema, ["kafka_timestamp"])
    return flat.drop(CORRUPT).select(
        *schema.names,
        lenient_timestamp(F.col("timestamp")).alias("event_timestamp"),
        "kafka_timestamp",
        now.alias("ingestion_timestamp"),
    )


def generic_events(envelope: DataFrame) -> DataFrame:
    """Events with a free map payload."""
    rows = envelope.select(F.col("value").cast("string").alias("_json"), F.col("timestamp").alias("processing_time"))
    return parse_payload(rows, "_json", GENERIC_EVENT, ["processing_time"]).drop(CORRUPT)


def split_corrupt(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows)."""
    bad = F.col(CORRUPT).isNotNull()
    return parsed.filter(~bad).drop(CORRUPT), parsed.filter(bad)


def route(event_type: Column, default: str = TOPIC_ANALYTICS) -> Column:
    """Topic of an event type."""
    table = F.create_map(*[F.lit(x) for pair in EVENT_TOPICS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(event_type, F.lit(""))), F.lit(default))


def ui_envelope(events: DataFrame, topic: Column, consumed_at, group: str) -> DataFrame:
    """The event nested in a message for the dashboard."""
    at = F.date_format(as_column(consumed_at), "yyyy-MM-dd'T'HH:mm:ss")
    data = F.struct(*[F.col(c) for c in events.columns], at.alias("kafka_consumed_at"), topic.alias("kafka_topic"))
    return events.select(
        F.lit("kafka_event").alias("type"),
        data.alias("data"),
        F.lit("kafka_consumer").alias("source"),
        topic.alias("kafka_topic"),
        at.alias("processed_timestamp"),
        F.lit(group).alias("consumer_group"),
    )


def to_envelope(payload: DataFrame, key: Column, topic: Column, partition: Column, offset: Column, ts: Column) -> DataFrame:
    """Rows as a message stream: every payload column goes into the JSON value."""
    return payload.select(
        key.cast("string").cast("binary").alias("key"),
        F.to_json(F.struct(*[F.col(c) for c in payload.columns if not c.startswith("_")])).cast("binary").alias("value"),
        topic.alias("topic"),
        partition.cast("int").alias("partition"),
        offset.cast("bigint").alias("offset"),
        ts.alias("timestamp"),
    )
