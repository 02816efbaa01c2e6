"""Nested and message-shaped frames derived row by row from the driver's tables.

Child arrays are generated from their own parent row, so no group is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.operators.parse import to_envelope
from eventmill.schemas import TOPIC_ANALYTICS, TOPIC_CUSTOMER, TOPIC_TRANSACTION
from eventmill.sources.canonical import Tables, _pick

# States of the incident fixture; the last one has no mapping.
STATES = ("Created", "Reviewed", "Exported", "Rejected", "Archived", "Parked")
STATE_MAP = {
    "Created": ("Intake", "Capture"),
    "Reviewed": ("Review", "Manual"),
    "Exported": ("Output", "Export"),
    "Rejected": ("Review", "Manual"),
    "Archived": ("Output", "Archive"),
}


def _list_of(count: Column, make) -> Column:
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1)).cast("int")), make))


def incidents(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    files = _list_of(
        key % 3,
        lambda i: F.struct(
            F.concat_ws("-", F.lit("F"), key.cast("string"), i.cast("string")).alias("FileName"),
            (i * 100).cast("bigint").alias("FileSize"),
        ),
    )
    history = _list_of(
        key % 4,
        lambda i: F.struct(
            _pick((key + i) % 6, STATES).alias("IncidentState"),
            F.concat(F.lit("svc"), (i % 3).cast("string")).alias("ServiceName"),
            F.concat(F.lit("srv"), (F.col("o_custkey") % 10).cast("string")).alias("ServerName"),
            F.when(i % 2 == 1, F.lit("timeout")).alias("FailType"),
        ),
    )
    return t.raw("orders").select(
        F.concat(F.lit("P"), key.cast("string")).alias("PrimaryFileName"),
        key.alias("IncidentId"),
        F.unix_millis("o_orderdate").alias("InsertionTime"),
        F.col("o_orderpriority").alias("OffenceType"),
        F.concat(F.lit("S"), (F.col("o_custkey") % 50).cast("string")).alias("SessionIndex"),
        F.concat(F.lit("D"), (F.col("o_custkey") % 20).cast("string")).alias("DeviceIndex"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("Vendor"),
        files.alias("IncidentFiles"),
        history.alias("incidentHistories"),
    )


def traffic_records(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    hour = F.date_trunc("hour", "ts")

    def text(c: Column) -> Column:
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")

    def passage(i: Column) -> Column:
        kind = (F.col("event_id") + i) % 4
        at = (
            F.when(kind == 0, text(F.col("ts")))
            .when(kind == 1, F.unix_millis("ts").cast("string"))
            .when(kind == 2, F.lit("not a time"))
        )
        return F.struct(
            at.alias("PassageTime"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ImportTime"),
            F.col("event_type").alias("VehicleClass"),
            F.col("value").alias("Speed"),
        )

    header = F.struct(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("SessionIndex"),
        F.concat(F.lit("D"), (k % 20).cast("string")).alias("SystemName"),
        F.concat(F.lit("L"), k.cast("string")).alias("Location0"),
        F.concat(F.lit("Suburb"), (k % 7).cast("string")).alias("Location1"),
        F.when(k % 2 == 0, F.lit("City")).alias("Location2"),
        text(hour).alias("SessionStart"),
        text(hour + F.make_dt_interval(hours=F.lit(1))).alias("SessionEnd"),
    )
    return t.raw("events").select(
        header.alias("headersession"), _list_of(F.col("event_id") % 3, passage).alias("trafficDataList")
    )


def payload_time(event_id: Column, ts: Column) -> Column:
    """The event time as producers write it: ISO, with a blank, with offset or as epoch milliseconds."""
    kind = event_id % 4
    return (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .otherwise(F.unix_millis(ts).cast("string"))
    )


def topic_of(event_type: Column) -> Column:
    return (
        F.when(event_type == "purchase", TOPIC_TRANSACTION)
        .when(event_type == "error", TOPIC_ANALYTICS)
        .otherwise(TOPIC_CUSTOMER)
    )


def envelope(events: DataFrame) -> DataFrame:
    """Canonical events as messages on three topics; every 97th payload is cut off."""
    dims = F.create_map(F.lit("device"), F.col("device_type"), F.lit("category"), F.col("category"))
    status = F.when(F.col("event_id") % 5 == 0, "failed").when(F.col("event_id") % 5 == 1, "pending").otherwise("completed")
    payload = events.select(
        F.col("event_type"),
        payload_time(F.col("event_id"), F.col("event_ts")).alias("timestamp"),
        "customer_id",
        "session_id",
        F.col("event_type").alias("action"),
        "product_id",
        "category",
        "device_type",
        F.col("event_id").cast("string").alias("transaction_id"),
        "amount",
        F.lit("USD").alias("currency"),
        F.col("category").alias("payment_method"),
        status.alias("status"),
        F.array(F.col("product_id").cast("int")).alias("product_ids"),
        F.concat(F.lit("metric."), F.col("event_type")).alias("metric_name"),
        "value",
        F.to_json(dims).alias("dimensions"),
        dims.alias("event_data"),
        F.lit("web").alias("source"),
        F.col("event_id").alias("_event_id"),
        F.col("event_ts").alias("_ts"),
    )
    rows = to_envelope(
        payload,
        F.col("customer_id"),
        topic_of(F.col("event_type")),
        F.col("customer_id") % 8,
        F.col("_event_id"),
        F.col("_ts"),
    )
    cut = F.substring(F.col("value").cast("string"), 1, 10).cast("binary")
    return rows.withColumn("value", F.when(F.col("offset") % 97 == 0, cut).otherwise(F.col("value")))
