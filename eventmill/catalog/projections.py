"""Queries: parsing, enrichment, nested records, contracts, joins and set operations."""

from pyspark.sql import functions as F

from eventmill.catalog.registry import ctes, register, rounded
from eventmill.functions import scalars
from eventmill.functions.scalars import ago, latest
from eventmill.operators import contracts, enrich, nested, parse
from eventmill.operators.ordering import page
from eventmill.schemas import (
    ANALYTICS_METRIC_JSON_DIMENSIONS,
    CUSTOMER_BEHAVIOR,
    TOPIC_ANALYTICS,
    TOPIC_CUSTOMER,
    TOPIC_TRANSACTION,
    TRANSACTION,
    contract_schema,
)
from eventmill.sources import nested as fixtures

EVN = "(SELECT max(ts) FROM events)"
TXN = "(SELECT max(o_orderdate) FROM orders)"
TOPIC = """CASE event_type WHEN 'purchase' THEN 'transaction-events' WHEN 'error' THEN 'analytics-events' ELSE 'customer-events' END"""
PARSED_TS = "CASE WHEN event_id % 4 = 3 THEN date_trunc('millisecond', event_ts) ELSE event_ts END"
BAD = "event_id % 97 = 0"


def _now(t):
    return latest(t.raw("events"), "ts")


@register(
    "prj1_envelope_projection",
    ctes(
        "ev",
        f"""SELECT {TOPIC} AS topic, CAST(customer_id % 8 AS INTEGER) AS partition, event_id AS offset, event_ts AS kafka_timestamp,
  strftime(event_ts, '%Y-%m-%d') AS date_partition, {EVN} AS processing_timestamp,
  CASE WHEN {BAD} THEN NULL ELSE customer_id END AS customer_id FROM ev""",
    ),
)
def _(t):
    rows = parse.envelope_rows(fixtures.envelope(t.events), _now(t))
    return rows.withColumn("customer_id", F.get_json_object("raw_data", "$.customer_id").cast("bigint")).drop("raw_data")


def _n(expr):
    return f"CASE WHEN {BAD} THEN NULL ELSE {expr} END"


SILVER = {
    "customer": (
        TOPIC_CUSTOMER,
        CUSTOMER_BEHAVIOR,
        f"""SELECT event_ts AS kafka_timestamp, {_n(PARSED_TS)} AS event_timestamp, {_n('CAST(customer_id AS INTEGER)')} AS customer_id,
  {_n('session_id')} AS session_id, {_n('event_type')} AS action, {_n('CAST(product_id AS INTEGER)')} AS product_id,
  {_n('category')} AS category, {_n('device_type')} AS device_type, {_n('value')} AS value
FROM ev WHERE event_type NOT IN ('purchase', 'error')""",
        ["kafka_timestamp", "event_timestamp", "customer_id", "session_id", "action", "product_id", "category", "device_type", "value"],
    ),
    "transaction": (
        TOPIC_TRANSACTION,
        TRANSACTION,
        f"""SELECT event_ts AS kafka_timestamp, {_n(PARSED_TS)} AS event_timestamp, {_n('CAST(event_id AS VARCHAR)')} AS transaction_id,
  {_n('CAST(customer_id AS INTEGER)')} AS customer_id, {_n('amount')} AS amount, {_n("'USD'")} AS currency,
  {_n("CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'completed' END")} AS status,
  {_n('CAST(product_id AS VARCHAR)')} AS product_ids FROM ev WHERE event_type = 'purchase'""",
        ["kafka_timestamp", "event_timestamp", "transaction_id", "customer_id", "amount", "currency", "status", "product_ids"],
    ),
    "analytics": (
        TOPIC_ANALYTICS,
        ANALYTICS_METRIC_JSON_DIMENSIONS,
        f"""SELECT event_ts AS kafka_timestamp, {_n(PARSED_TS)} AS event_timestamp, {_n("'metric.error'")} AS metric_name, {_n('value')} AS value,
  {_n('device_type')} AS device FROM ev WHERE event_type = 'error'""",
        ["kafka_timestamp", "event_timestamp", "metric_name", "value", "device"],
    ),
}


def _flat(df):
    if "product_ids" in df.columns:
        df = df.withColumn("product_ids", F.when(F.col("product_ids").isNotNull(), F.array_join("product_ids", ",")))
    if "dimensions" in df.columns:
        df = df.withColumn("device", F.from_json("dimensions", "map<string,string>")["device"])
    return df


for _kind, (_topic, _schema, _sql, _cols) in SILVER.items():
    register(f"prj2_silver_{_kind}", ctes("ev", _sql))(
        lambda t, p=_topic, c=_cols: _flat(
            parse.silver_events(parse.envelope_rows(fixtures.envelope(t.events), _now(t)), p)
        ).select(*c)
    )
    register(f"prj3_typed_bronze_{_kind}", ctes("ev", _sql))(
        lambda t, p=_topic, s=_schema, c=_cols: _flat(
            parse.typed_bronze(fixtures.envelope(t.events), p, s, _now(t))
        ).select(*c)
    )


@register(
    "prj2_rejected_payloads",
    ctes("ev", f"SELECT {TOPIC} AS topic, count(*) AS rejected FROM ev WHERE {BAD} GROUP BY 1"),
)
def _(t):
    bronze = parse.envelope_rows(fixtures.envelope(t.events), _now(t))
    parsed = parse.parse_payload(bronze, "raw_data", CUSTOMER_BEHAVIOR, ["topic"])
    return parse.split_corrupt(parsed)[1].groupBy("topic").agg(F.count("*").alias("rejected"))


@register(
    "prj4_generic_events",
    ctes(
        "ev",
        f"""SELECT event_ts AS processing_time, {_n('event_type')} AS event_type, {_n('CAST(customer_id AS VARCHAR)')} AS customer_id,
  {_n('value')} AS value, {_n('device_type')} AS device, {_n('category')} AS category FROM ev""",
    ),
)
def _(t):
    rows = parse.generic_events(fixtures.envelope(t.events))
    return rows.select(
        "processing_time",
        "event_type",
        "customer_id",
        "value",
        F.col("event_data")["device"].alias("device"),
        F.col("event_data")["category"].alias("category"),
    )


ROUTED = """SELECT event_id, CASE event_type WHEN 'view' THEN 'customer-events' WHEN 'purchase' THEN 'transaction-events'
  WHEN 'error' THEN 'analytics-events' ELSE '{}' END AS topic FROM events"""
for _label, _default in (("default_analytics", "analytics-events"), ("default_unknown", "unknown")):
    register(f"prj5_route_{_label}", ROUTED.format(_default))(
        lambda t, d=_default: t.raw("events").select(
            "event_id",
            parse.route(
                F.when(F.col("event_type") == "view", "customer_behavior")
                .when(F.col("event_type") == "purchase", "transaction")
                .when(F.col("event_type") == "error", "analytics_metric")
                .otherwise(F.col("event_type")),
                d,
            ).alias("topic"),
        )
    )


@register(
    "prj7_metadata",
    f"""SELECT event_id, {EVN} AS etl_processed_at, 'batch_1' AS etl_batch_id, '1.0.0' AS etl_version FROM events""",
)
def _(t):
    return enrich.with_metadata(t.raw("events").select("event_id"), "batch_1", processed_at=_now(t))


HOLES = "CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'signup' THEN NULL ELSE event_type END"


def holes(t):
    """Events with empty and missing types and missing times."""
    kind = F.when(F.col("event_type") == "error", "").when(F.col("event_type") != "signup", F.col("event_type"))
    return t.raw("events").select(
        "event_id", kind.alias("event_type"), F.when(F.col("value") > 5, F.col("ts")).alias("timestamp"), "value"
    )


@register(
    "prj8_fill_defaults",
    f"""SELECT event_id, coalesce(nullif({HOLES}, ''), 'unknown') AS event_type,
  CASE WHEN value > 5 THEN ts ELSE {EVN} END AS timestamp, value FROM events""",
)
def _(t):
    return enrich.fill_defaults(holes(t), _now(t))


@register("prj9_required_fields", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'signup') AND value > 5")
def _(t):
    return enrich.require(holes(t), ["event_type", "timestamp", "not_there"]).select("event_id", "event_type")


CONTRACT = {
    "schema": {
        "fields": [
            {"name": "id", "type": "long"},
            {"name": "kind", "type": "string"},
            {"name": "seen", "type": "string", "ms": True},
            {"name": "level", "type": "integer"},
        ]
    },
    "quality_rules": {"required": ["kind", "seen"]},
    "aggregations": [
        {"name": "by_kind", "sql": "select kind, count(*) as n, 'src' as tag from src group by kind"},
        {"name": "daily", "sql": "select year, month, day, count(*) as n from src s group by 1, 2, 3", "target_table": "daily_counts"},
        {"name": "broken", "sql": "select no_such_column from src"},
    ],
}


def contract_rows(t):
    """Contract records: times as ISO text, some unreadable, some kinds missing."""
    text = F.when(F.col("event_id") % 11 == 0, F.lit("n/a")).otherwise(fixtures.payload_time(F.col("event_id"), F.col("ts")))
    return t.raw("events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "signup", "").when(F.col("event_type") != "error", F.col("event_type")).alias("kind"),
        text.alias("seen"),
        (F.col("event_id") % 7).cast("int").alias("level"),
    )


CROWS = """crows AS (SELECT event_id AS id, CASE WHEN event_type = 'signup' THEN '' WHEN event_type <> 'error' THEN event_type END AS kind,
  CASE WHEN event_id % 11 <> 0 THEN epoch_us(ts) // 1000 END AS seen, CAST(event_id % 7 AS INTEGER) AS level FROM events)"""


@register("prj10_contract_required", f"WITH {CROWS} SELECT id, kind, level FROM crows WHERE kind IS NOT NULL AND seen IS NOT NULL")
def _(t):
    rows = contracts.to_epoch_ms(contract_rows(t), CONTRACT)
    return contracts.keep_valid(rows, CONTRACT).select("id", "kind", "level")


@register("prj10_contract_required_not_empty", f"WITH {CROWS} SELECT id, kind, level FROM crows WHERE kind <> '' AND seen IS NOT NULL")
def _(t):
    rows = contracts.to_epoch_ms(contract_rows(t), CONTRACT)
    return contracts.keep_valid(rows, CONTRACT, reject_empty=True).select("id", "kind", "level")


@register("prj11_contract_epoch_ms", f"WITH {CROWS} SELECT id, seen FROM crows")
def _(t):
    return contracts.to_epoch_ms(contract_rows(t), CONTRACT).select("id", "seen")


@register(
    "prj12_contract_partition_columns",
    f"""SELECT event_id AS id, i AS "InsertionTime", CAST(year(make_timestamp(i * 1000)) AS INTEGER) AS year,
  CAST(month(make_timestamp(i * 1000)) AS INTEGER) AS month, CAST(day(make_timestamp(i * 1000)) AS INTEGER) AS day
FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 ELSE epoch_us({EVN}) // 1000 END AS i FROM events)""",
)
def _(t):
    inserted = F.when(F.col("event_id") % 2 == 0, F.unix_millis("ts"))
    rows = t.raw("events").select(F.col("event_id").alias("id"), inserted.alias("InsertionTime"))
    return contracts.with_partition_columns(rows, _now(t))


@register(
    "prj13_contract_schema",
    """SELECT * FROM (VALUES ('id', 'bigint'), ('kind', 'string'), ('seen', 'bigint'), ('level', 'int'),
  ('InsertionTime', 'bigint'), ('year', 'int'), ('month', 'int'), ('day', 'int')) v(name, type), (SELECT count(*) AS rows FROM events)""",
)
def _(t):
    fields = contract_schema(CONTRACT).fields
    entries = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for f in fields])
    return t.raw("events").agg(F.count("*").alias("rows")).select(F.explode(entries).alias("x"), "rows").select("x.*", "rows")


@register(
    "prj14_stringify",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(CASE WHEN event_type <> 'error' THEN event_type END, '') AS event_type,
  CAST(user_id AS VARCHAR) AS user_id FROM events""",
)
def _(t):
    rows = t.raw("events").select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"), "user_id")
    return enrich.stringify(rows)


@register("prj15_clean_names", "SELECT event_id, user_id, event_type FROM events")
def _(t):
    rows = t.raw("events").select("event_id", "user_id", "event_type")
    return enrich.clean_names(rows.toDF(" 'event_id'", '"user_id" ', "'event_type"))


# --- incidents -------------------------------------------------------------------
MAIN = """SELECT 'P' || o_orderkey AS "PrimaryFileName", o_orderkey AS "IncidentId", epoch_ms(o_orderdate) AS "InsertionTime",
  o_orderpriority AS "OffenceType", 'S' || (o_custkey % 50) AS "SessionIndex", 'D' || (o_custkey % 20) AS "DeviceIndex",
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS "Vendor", CAST(o_orderdate AS DATE) AS date FROM orders"""
HIST = """hist AS (
  SELECT 'P' || o_orderkey AS "PrimaryFileName", CAST(i - 1 AS INTEGER) AS ordinal, epoch_ms(o_orderdate) AS "InsertionTime",
    CASE (o_orderkey + i) % 6 WHEN 0 THEN 'Created' WHEN 1 THEN 'Reviewed' WHEN 2 THEN 'Exported' WHEN 3 THEN 'Rejected'
      WHEN 4 THEN 'Archived' ELSE 'Parked' END AS "IncidentState", 'svc' || (i % 3) AS "ServiceName",
    'srv' || (o_custkey % 10) AS "ServerName", CASE WHEN i % 2 = 1 THEN 'timeout' END AS "FailType"
  FROM (SELECT *, unnest(range(1, o_orderkey % 4 + 1)) AS i FROM orders)),
mapped AS (
  SELECT *, CASE "IncidentState" WHEN 'Created' THEN 'Intake' WHEN 'Reviewed' THEN 'Review' WHEN 'Exported' THEN 'Output'
    WHEN 'Rejected' THEN 'Review' WHEN 'Archived' THEN 'Output' ELSE 'UNMAPPED_' || "IncidentState" END AS "Category",
    CASE "IncidentState" WHEN 'Created' THEN 'Capture' WHEN 'Reviewed' THEN 'Manual' WHEN 'Exported' THEN 'Export'
    WHEN 'Rejected' THEN 'Manual' WHEN 'Archived' THEN 'Archive' ELSE 'UNMAPPED_' || "IncidentState" END AS "ProcessType" FROM hist)"""


@register("prj16_incident_main", MAIN)
def _(t):
    return nested.with_insertion_date(nested.incident_main(fixtures.incidents(t)))


@register(
    "prj16_incident_files",
    """SELECT 'P' || o_orderkey AS "PrimaryFileName", epoch_ms(o_orderdate) AS "InsertionTime", CAST(i - 1 AS INTEGER) AS ordinal,
  'F-' || o_orderkey || '-' || i AS "FileName", CAST(i * 100 AS BIGINT) AS "FileSize"
FROM (SELECT *, unnest(range(1, o_orderkey % 3 + 1)) AS i FROM orders)""",
)
def _(t):
    return nested.incident_files(fixtures.incidents(t))


@register("prj17_incident_history_mapped", f"WITH {HIST} SELECT * FROM mapped")
def _(t):
    return nested.incident_history(fixtures.incidents(t), fixtures.STATE_MAP)


@register("jn4_state_map_join", f"WITH {HIST} SELECT * FROM mapped")
def _(t):
    rows = nested.children(fixtures.incidents(t), "incidentHistories", "PrimaryFileName", "InsertionTime")
    # the mapping table comes from the data: the known states that occur in it
    occurring = rows.select("IncidentState").distinct()
    table = nested.map_states(occurring, fixtures.STATE_MAP).filter(~F.col("Category").startswith("UNMAPPED_"))
    return nested.map_states_by_table(rows, table)


# --- traffic -----------------------------------------------------------------------
TREC = """trec AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
hdr AS (SELECT event_id, 'S' || user_id AS "SessionIndex", 'D' || (k % 20) AS dev, 'L' || k AS "Location0", 'Suburb' || (k % 7) AS "Location1",
  CASE WHEN k % 2 = 0 THEN 'City' END AS "Location2", epoch_ms(date_trunc('hour', ts)) AS "SessionStart",
  epoch_ms(date_trunc('hour', ts) + INTERVAL 1 HOUR) AS "SessionEnd", ts, event_type, value FROM trec),
pass0 AS (SELECT *, (event_id + i) % 4 AS kind FROM (SELECT *, unnest(range(1, event_id % 3 + 1)) AS i FROM hdr)),
pass AS (SELECT *, CASE kind WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('millisecond', ts) ELSE (SELECT max(ts) FROM events) END AS pt FROM pass0)"""


@register(
    "prj18_header_sessions",
    f"""WITH {TREC} SELECT "SessionIndex", dev AS "SystemName", "Location0", "Location1", "Location2", "SessionStart", "SessionEnd",
  epoch_us({EVN}) // 1000 AS "InsertionTime" FROM hdr""",
)
def _(t):
    return nested.header_sessions(fixtures.traffic_records(t), _now(t))


PASS = """SELECT "SessionIndex", dev AS "DeviceIndex", "Location0", "Location1", coalesce("Location2", '') AS "Location2", "SessionStart",
  "SessionEnd", event_type AS "VehicleClass", value AS "Speed" FROM pass"""


@register("prj19_passages_enriched", f"WITH {TREC} {PASS}")
def _(t):
    rows = nested.passages(fixtures.traffic_records(t), _now(t))
    return rows.select(
        "SessionIndex", "DeviceIndex", "Location0", "Location1", "Location2", "SessionStart", "SessionEnd", "VehicleClass", "Speed"
    )


@register(
    "jn5_parent_child",
    f"""WITH {TREC} SELECT dev AS "DeviceIndex", event_type AS "VehicleClass", count(*) AS passages, round(sum(value), 6) AS speed FROM pass GROUP BY 1, 2""",
)
def _(t):
    rows = nested.passages(fixtures.traffic_records(t), _now(t))
    return rounded(rows.groupBy("DeviceIndex", "VehicleClass").agg(F.count("*").alias("passages"), F.sum("Speed").alias("speed")))


@register(
    "prj20_passage_time",
    f"""WITH {TREC} SELECT "SessionIndex", epoch_us(pt) // 1000 AS "PassageTime", CAST(year(pt) AS INTEGER) AS year, CAST(month(pt) AS INTEGER) AS month,
  CAST(day(pt) AS INTEGER) AS day, CAST(hour(pt) AS INTEGER) AS hour, CAST(minute(pt) AS INTEGER) AS minute FROM pass""",
)
def _(t):
    rows = nested.passages(fixtures.traffic_records(t), _now(t))
    return rows.select("SessionIndex", "PassageTime", "year", "month", "day", "hour", "minute")


@register(
    "prj21_import_time",
    f"""WITH {TREC} SELECT "SessionIndex", epoch_ms(date_trunc('second', ts)) AS "ImportTime", count(*) AS n FROM pass GROUP BY 1, 2""",
)
def _(t):
    rows = nested.passages(fixtures.traffic_records(t), _now(t))
    return rows.groupBy("SessionIndex", "ImportTime").agg(F.count("*").alias("n"))


@register("prj22_date_of_mixed_times", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def _(t):
    mixed = fixtures.payload_time(F.col("event_id"), F.col("ts"))
    return t.raw("events").select("event_id", enrich.day_of(mixed).alias("day"))


LOOK = f"""WITH {HIST}, main AS ({MAIN}),
pairs AS (SELECT 'OffenceType' AS "lookupType", "OffenceType" AS "lookupValue" FROM main UNION SELECT 'SessionIndex', "SessionIndex" FROM main
  UNION SELECT 'DeviceIndex', "DeviceIndex" FROM main UNION SELECT 'Vendor', "Vendor" FROM main UNION SELECT 'PrimaryFileName', "PrimaryFileName" FROM main
  UNION SELECT 'ServiceName', "ServiceName" FROM hist UNION SELECT 'ServerName', "ServerName" FROM hist UNION SELECT 'FailType', "FailType" FROM hist)"""


@register("prj23_incident_lookups", LOOK + ' SELECT * FROM pairs WHERE "lookupValue" IS NOT NULL')
def _(t):
    return nested.incident_lookups(fixtures.incidents(t))


TLOOK = f"""WITH {TREC}, pairs AS (SELECT 'SessionIndex' AS "lookupType", "SessionIndex" AS "lookupValue" FROM hdr UNION SELECT 'DeviceIndex', dev FROM hdr
  UNION SELECT 'Location0', "Location0" FROM hdr UNION SELECT 'Location1', "Location1" FROM hdr UNION SELECT 'Location2', "Location2" FROM hdr
  UNION SELECT 'VehicleClass', event_type FROM pass)"""


@register("prj23_traffic_lookups", TLOOK + ' SELECT * FROM pairs WHERE "lookupValue" IS NOT NULL')
def _(t):
    return nested.traffic_lookups(fixtures.traffic_records(t))


@register(
    "set3_lookup_union",
    TLOOK + ' SELECT * FROM pairs WHERE "lookupValue" IS NOT NULL UNION SELECT \'Segment\', c_mktsegment FROM customer',
)
def _(t):
    existing = nested.lookup_pairs(t.raw("customer").withColumnRenamed("c_mktsegment", "Segment"), ["Segment"])
    return nested.traffic_lookups(fixtures.traffic_records(t), existing)


register(
    "jn7_existing_lookup_merge",
    """SELECT 'Segment' AS "lookupType", c_mktsegment AS "lookupValue" FROM customer UNION SELECT 'Segment', o_orderpriority FROM orders""",
)(
    lambda t: nested.merge_lookups(
        nested.lookup_pairs(t.raw("customer").select(F.col("c_mktsegment").alias("Segment")), ["Segment"]),
        nested.lookup_pairs(t.raw("orders").select(F.col("o_orderpriority").alias("Segment")), ["Segment"]),
    )
)


@register(
    "agg51_lookup_values",
    TLOOK + """ SELECT "lookupValue" FROM pairs WHERE "lookupType" = 'Location1' ORDER BY 1""",
)
def _(t):
    from eventmill.operators.traffic import lookup_values

    return lookup_values(nested.traffic_lookups(fixtures.traffic_records(t)), "Location1")


# --- rows ---------------------------------------------------------------------------
@register(
    "prj25_ui_envelope",
    f"""SELECT 'kafka_event' AS type, 'kafka_consumer' AS source, {TOPIC} AS kafka_topic, strftime({EVN}, '%Y-%m-%dT%H:%M:%S') AS processed_timestamp,
  'dashboard' AS consumer_group, event_id, {TOPIC} AS data_topic FROM events""",
)
def _(t):
    rows = parse.ui_envelope(t.raw("events").select("event_id", "event_type"), fixtures.topic_of(F.col("event_type")), _now(t), "dashboard")
    return rows.select(
        "type", "source", "kafka_topic", "processed_timestamp", "consumer_group", "data.event_id", F.col("data.kafka_topic").alias("data_topic")
    )


def snapshots(t):
    old = t.raw("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = old.withColumns(
        {
            "c_mktsegment": F.when(F.col("c_custkey") % 3 == 0, "VIP").otherwise(F.col("c_mktsegment")),
            "c_acctbal": F.when(F.col("c_custkey") % 2 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal")),
        }
    ).withColumn("only_new", F.lit(1))
    return old, new


CHANGES = """SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS old_value, 'VIP' AS new_value FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment <> 'VIP'
UNION ALL SELECT c_custkey, 'c_acctbal', CAST(c_acctbal AS VARCHAR), NULL FROM customer WHERE c_custkey % 2 = 0 AND c_acctbal IS NOT NULL"""


@register("prj26_changed_fields", CHANGES)
def _(t):
    diff = enrich.changed_fields(*snapshots(t), "c_custkey")
    return diff.select("c_custkey", F.explode("changes").alias("field", "v")).select("c_custkey", "field", "v.old_value", "v.new_value")


@register(
    "jn6_snapshot_diff",
    f"SELECT c_custkey, string_agg(field, ',' ORDER BY field) AS updated_fields FROM ({CHANGES}) GROUP BY 1",
)
def _(t):
    diff = enrich.changed_fields(*snapshots(t), "c_custkey")
    return diff.select("c_custkey", F.array_join(F.array_sort("updated_fields"), ",").alias("updated_fields"))


@register(
    "prj27_event_identity",
    "SELECT event_id, event_type || '_' || CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS identity FROM events",
)
def _(t):
    return t.raw("events").select("event_id", enrich.event_identity(F.col("event_type"), F.col("ts")).alias("identity"))


@register("prj27_content_ids", "SELECT count(*) AS rows, count(DISTINCT (event_type, user_id)) AS ids, 64 AS width FROM events")
def _(t):
    rows = t.raw("events").select("event_type", "user_id")
    ids = rows.select(enrich.content_id(rows).alias("id"))
    return ids.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.max(F.length("id")).alias("width"))


@register(
    "prj28_mask",
    """SELECT c_custkey, repeat('*', length(c_name) - 4) || right(c_name, 4) AS name,
  CASE WHEN length(CAST(c_custkey AS VARCHAR)) <= 4 THEN repeat('*', length(CAST(c_custkey AS VARCHAR)))
    ELSE repeat('*', length(CAST(c_custkey AS VARCHAR)) - 4) || right(CAST(c_custkey AS VARCHAR), 4) END AS short FROM customer""",
)
def _(t):
    return t.raw("customer").select(
        "c_custkey", scalars.mask(F.col("c_name")).alias("name"), scalars.mask(F.col("c_custkey").cast("string")).alias("short")
    )


@register(
    "prj29_scrub_sensitive",
    """SELECT '***' AS c_custkey, c_name AS name, '***' || right(c_name, 4) AS api_token, c_mktsegment AS segment,
  '***' || right(c_mktsegment, 4) AS session, '***' AS pin_secret, c_mktsegment AS plain FROM customer""",
)
def _(t):
    rows = t.raw("customer").select(
        F.col("c_custkey"),
        F.col("c_name").alias("name"),
        F.col("c_name").alias("api_token"),
        F.struct(
            F.col("c_mktsegment").alias("segment"), F.col("c_mktsegment").alias("session"), F.col("c_nationkey").alias("pin_secret")
        ).alias("inner"),
        F.array(F.col("c_mktsegment")).alias("plain"),
    )
    return scalars.scrub_sensitive(rows).select(
        "c_custkey", "name", "api_token", "inner.segment", "inner.session", "inner.pin_secret", F.col("plain")[0].alias("plain")
    )


@register(
    "prj29_scrub_map",
    """SELECT c_custkey AS id, c_name AS name, '***' || right(c_name, 4) AS password, c_mktsegment AS segment FROM customer""",
)
def _(t):
    data = F.create_map(F.lit("name"), "c_name", F.lit("user_password"), "c_name", F.lit("segment"), "c_mktsegment")
    rows = scalars.scrub_sensitive(t.raw("customer").select(F.col("c_custkey").alias("id"), data.alias("event_data")))
    keys = {"name": "name", "password": "user_password", "segment": "segment"}
    return rows.select("id", *[F.col("event_data")[k].alias(n) for n, k in keys.items()])


@register(
    "prj30_search",
    "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), 'mach') OR contains(lower(c_mktsegment), 'mach')",
)
def _(t):
    return enrich.search(t.raw("customer"), ["c_name", "c_mktsegment"], term="MaCh").select("c_custkey", "c_name", "c_mktsegment")


@register("prj30_search_pattern", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '(?i)customer#0+[0-9]*7$')")
def _(t):
    return enrich.search(t.raw("customer"), ["c_name"], pattern="customer#0+[0-9]*7$").select("c_custkey", "c_name")


@register(
    "prj31_equality_filters",
    ctes("cust", "SELECT customer_id, status, segment FROM cust WHERE status = 'active' AND segment = 'MACHINERY'"),
)
def _(t):
    rows = enrich.equal_to(t.customers, status="active", segment="MACHINERY", lifecycle_stage=None)
    return rows.select("customer_id", "status", "segment")


@register(
    "prj32_audit_filter",
    f"""SELECT event_id AS id, ts AS timestamp, user_id, upper(event_type) AS action, 'resource' || (user_id % 3) AS resource FROM events
WHERE event_type = 'click' AND user_id % 3 = 1 AND ts >= {EVN} - INTERVAL 10 DAY AND ts <= {EVN} - INTERVAL 1 DAY
ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 10""",
)
def _(t):
    logs = t.raw("events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        "user_id",
        F.upper("event_type").alias("action"),
        F.concat(F.lit("resource"), (F.col("user_id") % 3).cast("string")).alias("resource"),
    )
    found = enrich.audit_filter(logs, action="click", resource="resource1", start=ago(_now(t), days=10), end=ago(_now(t), days=1))
    return page(found, [F.desc("timestamp"), F.desc("id")], 10, 50)


@register("prj34_lookup_by_id", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = (SELECT max(o_custkey) FROM orders)")
def _(t):
    wanted = t.raw("orders").agg(F.max("o_custkey")).scalar()
    return enrich.by_id(t.raw("customer"), "c_custkey", wanted).select("c_custkey", "c_name", "c_mktsegment")


@register(
    "prj35_partition_columns",
    """SELECT 'incident' AS name, 'year,month' AS partitions, 'PrimaryFileName,IncidentId' AS clustering, 'bronze' AS layer, count(*) AS rows FROM orders
UNION ALL SELECT 'vpc_silver', 'event_type', 'event_type', 'silver', count(*) FROM events""",
)
def _(t):
    incidents = fixtures.incidents(t)
    events = t.raw("events")

    def line(table, df):
        return df.agg(F.count("*").alias("rows")).select(
            F.lit(table).alias("name"),
            F.lit(",".join(enrich.partition_columns(table, df.columns))).alias("partitions"),
            F.lit(",".join(enrich.clustering_columns(table))).alias("clustering"),
            F.lit(enrich.layer_of(table)).alias("layer"),
            "rows",
        )

    return line("incident", incidents).unionByName(line("vpc_silver", events))


@register(
    "prj36_range_labels",
    """SELECT event_id, CAST(floor(value / 5) * 5 AS BIGINT) || ' - ' || (CAST(floor(value / 5) * 5 AS BIGINT) + 5) AS speed_range,
  printf('%.3fM', event_id * 1000 / 1e6) AS millions FROM events""",
)
def _(t):
    return t.raw("events").select(
        "event_id",
        scalars.range_label(F.col("value"), 5).alias("speed_range"),
        scalars.millions_label(F.col("event_id") * 1000).alias("millions"),
    )


@register(
    "prj37_short_numbers",
    """SELECT l_partkey, CASE WHEN s >= 1000000 THEN printf('%.1fM', s / 1e6) WHEN s >= 1000 THEN printf('%.1fK', s / 1e3)
  ELSE CAST(s AS VARCHAR) END AS label FROM (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS s FROM lineitem GROUP BY 1)""",
)
def _(t):
    totals = t.raw("lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("s"))
    return totals.select("l_partkey", scalars.short_number(F.col("s")).alias("label"))


@register(
    "set1_union_by_name",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier UNION ALL SELECT n_nationkey, n_name, NULL, NULL FROM nation""",
)
def _(t):
    return enrich.union_all(
        [
            t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
            t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
            t.raw("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name")),
        ]
    )


@register("set2_distinct_rows", "SELECT DISTINCT event_type, user_id FROM events")
def _(t):
    return t.raw("events").select("event_type", "user_id").distinct()


@register("udf1_processor_chain", "SELECT event_type, count(*) AS n, 'batch_1' AS etl_batch_id FROM events WHERE value > 5 GROUP BY 1")
def _(t):
    rows = enrich.run_chain(
        t.raw("events"),
        [lambda df: enrich.with_metadata(df, "batch_1", processed_at=_now(t))],
        [lambda df: df.filter("value > 5")],
        [lambda df: df.groupBy("event_type", "etl_batch_id").agg(F.count("*").alias("n"))],
    )
    return rows


@register(
    "udf3_contract_sql",
    f"WITH {CROWS} SELECT kind, count(*) AS n, 'src' AS tag FROM crows WHERE kind IS NOT NULL AND seen IS NOT NULL GROUP BY 1",
)
def _(t):
    src = contracts.apply_contract(contract_rows(t), CONTRACT, _now(t))
    return contracts.run_aggregation(src, CONTRACT["aggregations"][0]["sql"])
