"""Declared schemas, topics and the contract-to-schema builder."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


S, I, L, D, B, TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)

# --- topics (fixed values) -------------------------------------------------
TOPIC_CUSTOMER = "customer-events"
TOPIC_TRANSACTION = "transaction-events"
TOPIC_ANALYTICS = "analytics-events"
EVENT_TOPICS = {
    "customer_behavior": TOPIC_CUSTOMER,
    "transaction": TOPIC_TRANSACTION,
    "analytics_metric": TOPIC_ANALYTICS,
}

# --- streams (fixed values: wire columns) -----------------------------------
ENVELOPE = _struct(
    ("key", T.BinaryType()),
    ("value", T.BinaryType()),
    ("topic", S),
    ("partition", I),
    ("offset", L),
    ("timestamp", TS),
)

CUSTOMER_BEHAVIOR = _struct(
    ("event_type", S),
    ("timestamp", S),
    ("customer_id", I),
    ("session_id", S),
    ("action", S),
    ("product_id", I),
    ("category", S),
    ("device_type", S),
    ("location", S),
    ("value", D),
)

TRANSACTION = _struct(
    ("event_type", S),
    ("timestamp", S),
    ("transaction_id", S),
    ("customer_id", I),
    ("amount", D),
    ("currency", S),
    ("payment_method", S),
    ("status", S),
    ("product_ids", T.ArrayType(I)),
    ("discount_applied", D),
)

ANALYTICS_METRIC = _struct(
    ("event_type", S),
    ("timestamp", S),
    ("metric_name", S),
    ("value", D),
    ("dimensions", T.MapType(S, S)),
)

ANALYTICS_METRIC_JSON_DIMENSIONS = _struct(
    ("event_type", S),
    ("timestamp", S),
    ("metric_name", S),
    ("value", D),
    ("unit", S),
    ("dimensions", S),
)

GENERIC_EVENT = _struct(
    ("timestamp", S),
    ("event_type", S),
    ("customer_id", S),
    ("session_id", S),
    ("event_data", T.MapType(S, S)),
    ("value", D),
    ("currency", S),
    ("source", S),
)

PAYLOADS = {
    TOPIC_CUSTOMER: CUSTOMER_BEHAVIOR,
    TOPIC_TRANSACTION: TRANSACTION,
    TOPIC_ANALYTICS: ANALYTICS_METRIC_JSON_DIMENSIONS,
}

# --- typed bronze ----------------------------------------------------------
_BRONZE_META = (("event_timestamp", TS), ("kafka_timestamp", TS), ("ingestion_timestamp", TS))
BRONZE_TABLES = {
    "customer_behavior": T.StructType(CUSTOMER_BEHAVIOR.fields + _struct(*_BRONZE_META).fields),
    "transactions": T.StructType(TRANSACTION.fields + _struct(*_BRONZE_META).fields),
    "analytics_metrics": T.StructType(ANALYTICS_METRIC.fields + _struct(*_BRONZE_META).fields),
}

# --- windowed gold tables (fixed values: columns; aggregates are long) --------
_WINDOW = (("window_start", TS, False), ("window_end", TS, False))
_CREATED = (("created_at", TS, False),)
GOLD_TABLES = {
    "customer_metrics": _struct(
        *_WINDOW,
        ("total_customers", L),
        ("new_customers", L),
        ("active_customers", L),
        ("total_events", L),
        ("avg_customer_value", D),
        *_CREATED,
    ),
    "campaign_metrics": _struct(
        *_WINDOW,
        ("campaign_id", S),
        ("total_impressions", L),
        ("total_clicks", L),
        ("total_conversions", L),
        ("total_spend", D),
        ("ctr", D),
        ("conversion_rate", D),
        *_CREATED,
    ),
    "event_analytics": _struct(
        *_WINDOW,
        ("event_type", S),
        ("event_count", L),
        ("unique_customers", L),
        ("total_revenue", D),
        ("avg_revenue", D),
        *_CREATED,
    ),
    "segment_metrics": _struct(
        *_WINDOW,
        ("segment", S),
        ("customer_count", L),
        ("total_orders", L),
        ("total_revenue", D),
        ("avg_order_value", D),
        *_CREATED,
    ),
}

# --- virtual private cloud records (fixed values: columns) --------------------
VPC_EVENT = _struct(
    ("EventId", S, False),
    ("EventType", S),
    ("EventTime", TS),
    ("VpcId", S),
    ("InstanceId", S),
    ("ResourceId", S),
    ("State", S),
    ("PreviousState", S),
    ("Region", S),
    ("AvailabilityZone", S),
    ("Source", S),
    ("Details", S),
    ("Severity", S),
)
VPC_CLERK = _struct(
    ("ClerkId", S, False),
    ("ClerkName", S),
    ("Status", S),
    ("LastUpdate", TS),
    ("VpcId", S),
    ("Region", S),
    ("IsActive", B),
    ("ProcessingLoad", I),
    ("LastHeartbeat", TS),
)

LOOKUP = _struct(("lookupType", S), ("lookupValue", S))

# --- the driver's parquet tables; declared so that no footer is read to infer,
#     and so that timestamps arrive as instants and push down as such ----------
SOURCE_TABLES = {
    "region": _struct(("r_regionkey", I), ("r_name", S)),
    "nation": _struct(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _struct(
        ("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", D), ("c_mktsegment", S)
    ),
    "supplier": _struct(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": _struct(
        ("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", I), ("p_retailprice", D)
    ),
    "orders": _struct(
        ("o_orderkey", L),
        ("o_custkey", L),
        ("o_orderstatus", S),
        ("o_totalprice", D),
        ("o_orderdate", TS),
        ("o_orderpriority", S),
    ),
    "lineitem": _struct(
        ("l_orderkey", L),
        ("l_partkey", L),
        ("l_suppkey", L),
        ("l_linenumber", I),
        ("l_quantity", D),
        ("l_extendedprice", D),
        ("l_discount", D),
        ("l_tax", D),
        ("l_returnflag", S),
        ("l_linestatus", S),
        ("l_shipdate", TS),
    ),
    "events": _struct(
        ("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S), ("value", D), ("props", S)
    ),
}


def contract_schema(contract: dict, raw: bool = False) -> T.StructType:
    """Contract fields as a StructType.

    ``raw=True`` describes the incoming record: a field with ``ms`` arrives as a
    string and becomes epoch milliseconds later. ``raw=False`` describes the
    stored table, with the partition columns added.
    """
    fields = []
    for spec in contract.get("schema", {}).get("fields", []):
        name = spec.get("name") or spec.get("field")
        if not name:
            continue
        if spec.get("ms") is True:
            kind = S if raw else L
        else:
            kind = {"long": L, "integer": I}.get(spec.get("type", "string"), S)
        fields.append(T.StructField(name, L if name == "InsertionTime" else kind))
    names = {f.name for f in fields}
    extra = [("InsertionTime", L)] if raw else [("InsertionTime", L), ("year", I), ("month", I), ("day", I)]
    fields += [T.StructField(n, t) for n, t in extra if n not in names]
    return T.StructType(fields)
