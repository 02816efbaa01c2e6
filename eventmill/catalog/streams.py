"""Queries: streams run to the end of the available data, then their tables are read."""

from dataclasses import replace

from pyspark.sql import functions as F

from eventmill.catalog.marts import SESSIONS
from eventmill.catalog.projections import BAD, CONTRACT, CROWS, PARSED_TS, TOPIC, contract_rows
from eventmill.catalog.registry import ctes, more, register, rounded
from eventmill.catalog.rollups import DASH
from eventmill.functions.scalars import latest
from eventmill.operators import changes, writers
from eventmill.schemas import ENVELOPE, SOURCE_TABLES, TOPIC_ANALYTICS, TOPIC_CUSTOMER, TOPIC_TRANSACTION
from eventmill.session import shared_dir
from eventmill.sources import nested as fixtures
from eventmill.sources.canonical import Tables
from eventmill.sources.tables import Lake
from eventmill.streaming import keyed, medallion, sessions, sinks, sources, windows

EVN = "(SELECT max(ts) FROM events)"


def lake(t, label):
    return Lake(t.spark, shared_dir(t.spark, label))


def raw_stream(t):
    return sources.table_stream(t.spark, t.path("events"), SOURCE_TABLES["events"])


def events_stream(t):
    return Tables.to_events(raw_stream(t))


def behavior_stream(t):
    return events_stream(t).withColumn("event_timestamp", F.col("event_ts")).withColumn("action", F.col("event_type"))


def unrounded(metric):
    """The metric without its two-decimal rounding, which depends on the order of additions."""
    return replace(metric, round_to={})


def done(*queries):
    for q in queries:
        q.awaitTermination()


def envelope_files(t, label):
    """The whole events table as message files."""
    path = shared_dir(t.spark, label)
    fixtures.envelope(t.events).write.parquet(path)
    return path


for _name in ("str1_raw_bronze", "snk1_raw_bronze_append"):

    @register(
        _name,
        ctes("ev", f"SELECT {TOPIC} AS topic, strftime(event_ts, '%Y-%m-%d') AS date_partition, count(*) AS n, min(event_id) AS first_offset FROM ev GROUP BY 1, 2"),
    )
    def _(t):
        lk = lake(t, "str1")
        done(medallion.raw_bronze(lk, fixtures.envelope(events_stream(t)), None))
        rows = t.spark.read.parquet(lk.path("bronze", "raw_events"))
        return rows.groupBy("topic", F.col("date_partition").cast("string").alias("date_partition")).agg(
            F.count("*").alias("n"), F.min("offset").alias("first_offset")
        )


@register("src1_multi_topic_stream", ctes("ev", f"SELECT {TOPIC} AS topic, count(*) AS n FROM ev GROUP BY 1"))
def _(t):
    path = shared_dir(t.spark, "src1")
    stream = sources.event_stream(t.spark, "files", envelope_files(t, "src1in"))
    done(sinks.append_stream(stream, f"{path}/out", f"{path}/cp", None))
    return t.spark.read.schema(ENVELOPE).parquet(f"{path}/out").groupBy("topic").agg(F.count("*").alias("n"))


@register("src2_stream_per_topic", ctes("ev", f"SELECT {TOPIC} AS topic, count(*) AS n FROM ev GROUP BY 1"))
def _(t):
    path = shared_dir(t.spark, "src2")
    streams = sources.topic_streams(t.spark, envelope_files(t, "src2in"))
    done(*[sinks.append_stream(s, f"{path}/{k}", f"{path}/cp/{k}", None) for k, s in streams.items()])
    outs = [t.spark.read.schema(ENVELOPE).parquet(f"{path}/{k}") for k in streams]
    return outs[0].union(outs[1]).union(outs[2]).groupBy("topic").agg(F.count("*").alias("n"))


FILE_ROWS = 250_000


def batch_files(rows, path, batches, most=FILE_ROWS):
    """Messages as files of about ``most`` rows, as many for each of ``batches``; how many that are."""
    each = max(1, -(-rows.count() // (batches * most)))
    rows.repartition(batches * each, "offset").write.parquet(path)
    return each


@register("src3_rate_capped_stream", "SELECT count(*) AS n, 4 AS batches FROM events")
def _(t):
    path = shared_dir(t.spark, "src3")
    each = batch_files(fixtures.envelope(t.events), f"{path}/in", 4)
    stream = sources.event_stream(t.spark, "files", f"{path}/in", files_per_trigger=each)
    done(sinks.batch_stream(stream, sinks.append_batches(f"{path}/out", ["topic"]), f"{path}/cp", None, mode="append"))
    out = t.spark.read.parquet(f"{path}/out")
    return out.agg(F.count("*").alias("n"), F.count_distinct("batch_id").cast("int").alias("batches"))


@register("src4_source_by_type", "SELECT 'files' AS kind, true AS accepted, count(*) AS n FROM events UNION ALL SELECT 'socket', false, 0")
def _(t):
    path, out = shared_dir(t.spark, "src4"), None
    files = envelope_files(t, "src4in")
    for kind in ("files", "socket"):
        try:
            stream = sources.event_stream(t.spark, kind, files)
            done(sinks.append_stream(stream, f"{path}/{kind}", f"{path}/cp/{kind}", None))
            n, ok = t.spark.read.schema(ENVELOPE).parquet(f"{path}/{kind}"), True
        except ValueError:
            n, ok = t.raw("events").limit(0), False
        line = n.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(ok).alias("accepted"), "n")
        out = line if out is None else out.unionByName(line)
    return out


@register("src5_layer_table_stream", "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def _(t):
    path = shared_dir(t.spark, "src5")
    done(sinks.append_stream(raw_stream(t), f"{path}/out", f"{path}/cp", None))
    out = t.spark.read.schema(SOURCE_TABLES["events"]).parquet(f"{path}/out")
    return rounded(out.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


SILVER_COUNTS = f"""SELECT CASE {TOPIC} WHEN 'customer-events' THEN 'customer_events' WHEN 'transaction-events' THEN 'transaction_events'
  ELSE 'analytics_events' END AS table_name, strftime(event_ts, '%Y-%m-%d') AS day, count(*) AS n,
  max({PARSED_TS}) AS newest FROM ev WHERE NOT {BAD} GROUP BY 1, 2"""

for _name in ("str2_silver_parse", "snk3_silver_append"):

    @register(_name, ctes("ev", SILVER_COUNTS))
    def _(t):
        lk = lake(t, "str2")
        done(medallion.raw_bronze(lk, fixtures.envelope(events_stream(t)), None))
        done(*medallion.silver_tables(lk, None).values())
        out = None
        for table in medallion.SILVER_TABLES:
            rows = t.spark.read.parquet(lk.path("silver", table))
            line = rows.groupBy(F.lit(table).alias("table_name"), F.col("date_partition").cast("string").alias("day")).agg(
                F.count("*").alias("n"), F.max("event_timestamp").alias("newest")
            )
            out = line if out is None else out.unionByName(line)
        return out


def spoiled(rows):
    """The message stream with a tenth each of cut, empty, foreign and unknown messages."""
    text, k = F.col("value").cast("string"), F.col("offset") % 10
    value = F.when(k == 1, F.expr("left(string(value), length(string(value)) div 2)")).when(k == 2, F.lit("  "))
    value = value.when(k == 3, F.lit('{"unknown": 1}')).otherwise(text)
    topic = F.when(k == 4, F.lit("other-topic")).otherwise(F.col("topic"))
    return rows.withColumns({"value": value.cast("binary"), "topic": topic})


REJECTS = f"""SELECT CASE event_id % 10 WHEN 1 THEN 'rejected:malformed_json' WHEN 2 THEN 'rejected:empty' WHEN 3 THEN 'rejected:no_known_field'
    WHEN 4 THEN 'rejected:unknown_topic' ELSE CASE WHEN {BAD} THEN 'rejected:malformed_json' ELSE CASE {TOPIC} WHEN 'customer-events' THEN 'CUST' WHEN 'transaction-events' THEN 'TRANS' ELSE 'METRIC' END END END AS kind,
  count(*) AS n, min(event_id) AS first_offset FROM ev GROUP BY 1"""


def _kept_and_rejected(t, lk, layer, tables):
    out = t.spark.read.parquet(lk.path(layer, "rejected")).groupBy(F.concat(F.lit("rejected:"), "reason").alias("kind"))
    out = out.agg(F.count("*").alias("n"), F.min("offset").alias("first_offset"))
    return out, {name: t.spark.read.parquet(lk.path(layer, table)) for name, table in tables.items()}


@register("str2_rejected_payloads", ctes("ev", f"SELECT kind, n, CASE WHEN kind LIKE 'rejected%' THEN first_offset END AS first_offset FROM ({REJECTS})"))
def _(t):
    lk = lake(t, "str2r")
    done(medallion.raw_bronze(lk, spoiled(fixtures.envelope(events_stream(t))), None))
    done(*medallion.silver_tables(lk, None).values())
    out, kept = _kept_and_rejected(t, lk, "silver", {"CUST": "customer_events", "TRANS": "transaction_events", "METRIC": "analytics_events"})
    for name, rows in kept.items():
        line = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n", F.lit(None).cast("long").alias("first_offset"))
        out = out.unionByName(line)
    return out


@register("str6_rejected_payloads", ctes("ev", f"SELECT kind, n, CASE WHEN kind LIKE 'rejected%' THEN first_offset END AS first_offset FROM ({REJECTS})"))
def _(t):
    lk = lake(t, "str6r")
    medallion.create_folders(lk, "bronze", list(medallion.TYPED_TOPICS))
    done(*medallion.typed_bronze_tables(lk, spoiled(fixtures.envelope(events_stream(t))), None).values())
    out, kept = _kept_and_rejected(t, lk, "bronze", {"CUST": "customer_behavior", "TRANS": "transactions", "METRIC": "analytics_metrics"})
    for name, rows in kept.items():
        line = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n", F.lit(None).cast("long").alias("first_offset"))
        out = out.unionByName(line)
    return out


CUSTOMER_METRICS = """SELECT time_bucket(INTERVAL 5 MINUTE, event_ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, event_ts) + INTERVAL 5 MINUTE AS window_end,
  event_type AS action, device_type, count(customer_id) AS event_count, count(DISTINCT customer_id) AS unique_customers,
  round(avg(value), 6) AS avg_value, round(sum(value), 6) AS total_value FROM ev GROUP BY 1, 2, 3, 4"""


for _name in ("str3_customer_metrics", "snk4_update_mode_upsert"):

    @register(_name, ctes("ev", CUSTOMER_METRICS))
    def _(t):
        lk = lake(t, "str3")
        path = lk.path("gold", "customer_metrics")
        metric = unrounded(windows.customer_metrics())
        done(windows.publish_metrics(behavior_stream(t), metric, path, lk.checkpoint("m"), None))
        return rounded(windows.read_gold(t.spark, path, metric))


@register("str3_customer_metrics_batch_twin", ctes("ev", CUSTOMER_METRICS))
def _(t):
    rows = t.events.withColumn("event_timestamp", F.col("event_ts")).withColumn("action", F.col("event_type"))
    return rounded(windows.batch_metrics(rows, unrounded(windows.customer_metrics())))


@register(
    "str4_transaction_metrics",
    ctes(
        "tx",
        """SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS window_start, time_bucket(INTERVAL 5 MINUTE, created_at) + INTERVAL 5 MINUTE AS window_end,
  status, payment_method, count(transaction_id) AS transaction_count, round(sum(amount), 6) AS total_amount, round(avg(amount), 6) AS avg_amount,
  count(DISTINCT customer_id) AS unique_customers FROM tx GROUP BY 1, 2, 3, 4""",
    ),
)
def _(t):
    lk = lake(t, "str4")
    path = lk.path("gold", "transaction_metrics")
    raw = sources.table_stream(t.spark, t.path("orders"), SOURCE_TABLES["orders"])
    rows = Tables.to_transactions(raw).withColumn("event_timestamp", F.col("created_at"))
    metric = unrounded(windows.transaction_metrics())
    done(windows.publish_metrics(rows, metric, path, lk.checkpoint("m"), None))
    return rounded(windows.read_gold(t.spark, path, metric))


@register(
    "str5_event_rate",
    ctes(
        "ev",
        f"""SELECT time_bucket(INTERVAL 30 SECOND, event_ts) AS window_start, time_bucket(INTERVAL 30 SECOND, event_ts) + INTERVAL 30 SECOND AS window_end,
  {TOPIC} AS topic, count(*) AS event_count, round(count(*) / 30.0::DOUBLE, 6) AS events_per_second FROM ev GROUP BY 1, 2, 3""",
    ),
)
def _(t):
    lk = lake(t, "str5")
    path = lk.path("gold", "event_rates")
    rows = fixtures.envelope(events_stream(t)).withColumn("processing_timestamp", F.col("timestamp"))
    done(windows.publish_metrics(rows, windows.event_rate(), path, lk.checkpoint("m"), None))
    return rounded(windows.read_gold(t.spark, path, windows.event_rate()))


TYPED = f"""SELECT CASE {TOPIC} WHEN 'customer-events' THEN 'customer_behavior' WHEN 'transaction-events' THEN 'transactions'
  ELSE 'analytics_metrics' END AS table_name, count(*) AS n, max(event_ts) AS newest FROM ev WHERE NOT {BAD} GROUP BY 1"""

for _name in ("str6_typed_bronze", "snk2_typed_bronze_append"):

    @register(_name, ctes("ev", TYPED))
    def _(t):
        lk = lake(t, "str6")
        medallion.create_folders(lk, "bronze", list(medallion.TYPED_TOPICS))
        done(*medallion.typed_bronze_tables(lk, fixtures.envelope(events_stream(t)), None).values())
        out = None
        for table in medallion.TYPED_TOPICS:
            rows = t.spark.read.parquet(lk.path("bronze", table))
            line = rows.agg(F.count("*").alias("n"), F.max("kafka_timestamp").alias("newest")).withColumn("table_name", F.lit(table))
            out = line if out is None else out.unionByName(line)
        return out


REALTIME = """SELECT window_start, window_start + INTERVAL 30 SECOND AS window_end, action, category, event_count, unique_customers,
  round(total_value, 6) AS total_value, round(avg_value, 6) AS avg_value FROM silver"""
MINUTES = """SELECT window_start, window_end, total_events_per_minute, sum_unique_customers, round(total_revenue, 6) AS total_revenue,
  round(avg_event_value, 6) AS avg_event_value, metric_records, round(events_per_second, 6) AS events_per_second FROM dash"""


@register("str7_realtime_metrics", more("ev", DASH, REALTIME))
def _(t):
    lk = lake(t, "str7")
    done(medallion.realtime_metrics(behavior_stream(t), lk, None, with_minutes=False))
    return rounded(windows.read_gold(t.spark, lk.path("silver", "realtime_metrics"), windows.realtime_metrics()))


@register("str8_minute_dashboard", more("ev", DASH, MINUTES))
def _(t):
    lk = lake(t, "str8")
    done(medallion.realtime_metrics(behavior_stream(t), lk, None))
    return rounded(medallion.read_minutes(lk))


FIVE = """SELECT time_bucket(INTERVAL 5 SECOND, event_ts) AS window_start, time_bucket(INTERVAL 5 SECOND, event_ts) + INTERVAL 5 SECOND AS window_end,
  event_type, count(*) AS event_count, count(DISTINCT customer_id) AS unique_customers, round(sum(value), 6) AS total_value,
  min(event_ts) AS first_seen FROM ev GROUP BY 1, 2, 3"""


def _five(t, after=None):
    lk = lake(t, "str9")
    path = lk.path("gold", "five_seconds")
    rows = events_stream(t).withColumn("processing_time", F.col("event_ts"))
    done(windows.publish_metrics(rows, windows.five_second_counts(), path, lk.checkpoint("m"), None, after=after))
    return windows.read_gold(t.spark, path, windows.five_second_counts())


register("str9_five_second_counts", ctes("ev", FIVE))(lambda t: rounded(_five(t)))


@register(
    "snk6_snapshot",
    more(
        "ev",
        f"five AS ({FIVE})",
        """SELECT CAST(sum(event_count) AS BIGINT) AS total_events, CAST(sum(unique_customers) AS BIGINT) AS total_customers,
  round(sum(total_value), 4) AS total_revenue, round(sum(event_count) / 5.0::DOUBLE, 4) AS events_per_second,
  count(*) AS window_count, 'stream' AS data_source FROM five""",
    ),
)
def _(t):
    path = shared_dir(t.spark, "snk6")
    _five(t, sinks.snapshot_writer(path, 5.0, "stream"))
    return rounded(writers.read_current(t.spark, path).drop("batch_id", "timestamp"), 4)


for _name in ("str10_contract_stream", "snk22_contract_append"):

    @register(
        _name,
        f"""WITH {CROWS} SELECT kind, CAST(year(n) AS INTEGER) AS year, CAST(month(n) AS INTEGER) AS month, CAST(day(n) AS INTEGER) AS day, count(*) AS rows,
  CAST(sum(level) AS BIGINT) AS level FROM crows, (SELECT max(ts) AS n FROM events) WHERE kind IS NOT NULL AND seen IS NOT NULL GROUP BY 1, 2, 3, 4""",
    )
    def _(t):
        lk = lake(t, "str10")
        done(medallion.contract_table(lk, _values(t), CONTRACT, "records", None, t.raw("events").agg(F.max("ts")).first()[0]))
        return _contract_counts(t.spark.read.parquet(lk.path("bronze", "records")))


def _values(t):
    """Contract records as JSON values on a stream."""
    class _Stream(Tables):
        def raw(self, name):
            return sources.table_stream(self.spark, self.path(name), SOURCE_TABLES[name])

    return contract_rows(_Stream(t.spark, t.dir)).select(F.to_json(F.struct("id", "kind", "seen", "level")).alias("value"))


def _contract_counts(rows):
    return rows.groupBy("kind", "year", "month", "day").agg(F.count("*").alias("rows"), F.sum("level").alias("level"))


for _name in ("snk23_contract_batches", "udf4_foreach_batch"):

    @register(
        _name,
        f"""WITH {CROWS} SELECT kind, count(*) AS rows, CAST(sum(level) AS BIGINT) AS level FROM crows
  WHERE kind IS NOT NULL AND seen IS NOT NULL GROUP BY 1""",
    )
    def _(t):
        lk = lake(t, "snk23")
        done(medallion.contract_batches(lk, _values(t), CONTRACT, "records"))
        rows = t.spark.read.parquet(lk.path("bronze", "records"))
        return rows.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("level").alias("level"))


@register("snk5_console", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    path = shared_dir(t.spark, "snk5")
    counts = raw_stream(t).groupBy("event_type").agg(F.count("*").alias("n"))
    done(sinks.console_stream(counts, None, name=f"debug_{path[-8:]}"))
    done(sinks.batch_stream(counts, lambda df, i: writers.upsert(df, path, ["event_type"]) and None, f"{path}-cp", None))
    return writers.read_current(t.spark, path)


@register("str11_size_triggered_batches", "SELECT 8 AS batches, count(*) AS rows, true AS balanced FROM events")
def _(t):
    path = shared_dir(t.spark, "str11")
    t.raw("events").repartition(8, "event_id").write.parquet(f"{path}/in")
    stream = sources.table_stream(t.spark, f"{path}/in", SOURCE_TABLES["events"], files_per_trigger=1)
    done(sinks.batch_stream(stream, sinks.append_batches(f"{path}/out", []), f"{path}/cp", None, mode="append"))
    sizes = t.spark.read.parquet(f"{path}/out").groupBy("stream_id", "batch_id").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").cast("int").alias("batches"), F.sum("n").alias("rows"), (F.max("n") < 2 * F.min("n")).alias("balanced")
    )


COUNTERS = """SELECT event_type, count(*) AS count, max(event_ts) AS latest_ts, max_by(event_id, (event_ts, event_id)) AS latest_event_id,
  max_by(value, (event_ts, event_id)) AS latest_value FROM ev GROUP BY 1"""


def _counters(t):
    lk = lake(t, "str12")
    path = lk.path("gold", "counters")
    done(keyed.publish_counters(events_stream(t), path, lk.checkpoint("c"), None))
    return keyed.read_counters(t.spark, path)


register("str12_keyed_counters", ctes("ev", COUNTERS + " UNION ALL SELECT 'total', count(*), NULL, NULL, NULL FROM ev"))(_counters)
register(
    "str12_latest_alive",
    more("ev", f"c AS ({COUNTERS})", f"SELECT event_type, latest_event_id FROM c WHERE latest_ts >= {EVN} - INTERVAL 3600 SECOND"),
)(lambda t: keyed.alive(_counters(t), "latest_ts", latest(t.raw("events"), "ts"), 3600).select("event_type", "latest_event_id"))

LIVES = f"""marked AS (SELECT *, CASE WHEN event_ts - lag(event_ts) OVER w <= INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS fresh
  FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY event_ts, event_id)),
lives AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY event_ts, event_id) AS life FROM marked)
SELECT event_type, min(event_ts) AS starts, max(event_ts) + INTERVAL 3600 SECOND AS ends, count(*) AS count,
  max_by(event_id, (event_ts, event_id)) AS latest_event_id, max_by(value, (event_ts, event_id)) AS latest_value,
  max(event_ts) + INTERVAL 3600 SECOND > {EVN} AS alive FROM lives GROUP BY event_type, life"""


@register("str12_counter_lives", more("ev", *LIVES.split("\nSELECT event_type", 1)[:1], "SELECT event_type" + LIVES.split("\nSELECT event_type", 1)[1]))
def _(t):
    """Counters that expire after an hour without an event: those that did, and those still in the state."""
    path, keys, made = shared_dir(t.spark, "str12l"), ["event_type"], sessions.counter_aggregates()
    rows = sessions.windowed_sessions(events_stream(t), keys, "3600 seconds", made, "1 hour")
    done(sessions.publish_sessions(rows, f"{path}/out", f"{path}/cp", None))
    gone = t.spark.read.schema(rows.schema).parquet(f"{path}/out")
    here = sessions.open_sessions(t.spark, f"{path}/cp", keys, list(made))
    return sessions.as_counters(gone.unionByName(here), latest(t.raw("events"), "ts"))


@register(
    "agg53_stream_sessions",
    more(
        "ev",
        SESSIONS,
        """SELECT customer_id, session_start, session_end, events::BIGINT AS events, page_views::BIGINT AS page_views,
  purchases::BIGINT AS purchases, round(revenue, 6) AS revenue, round(duration_seconds, 6) AS duration_seconds FROM sess""",
    ),
)
def _(t):
    path, keys, made = shared_dir(t.spark, "agg53s"), ["customer_id"], sessions.customer_aggregates()
    rows = sessions.windowed_sessions(events_stream(t), keys, "30 minutes", made, "1 hour")
    done(sessions.publish_sessions(rows, f"{path}/out", f"{path}/cp", None))
    closed = t.spark.read.schema(rows.schema).parquet(f"{path}/out")
    live = sessions.open_sessions(t.spark, f"{path}/cp", keys, list(made))
    return rounded(sessions.as_sessions(closed.unionByName(live)))


# A day instead of a minute and lower limits: the test table has few events per minute.
DAY_LIMITS = {"anonymous": 2, "authenticated": 3, "auth": 1, "upload": 2, "ml": 2}
REQ = """req AS (SELECT event_id AS request_id, ts, CASE WHEN user_id % 3 = 0 THEN 'ip:10.0.0.' || (user_id % 7) ELSE 'user:' || user_id END AS identifier,
  CASE event_type WHEN 'signup' THEN '/api/v1/auth/register' WHEN 'error' THEN '/upload/file' WHEN 'click' THEN '/api/v1/ml/predict' ELSE '/api/v1/data' END AS path FROM events)"""


def requests(raw):
    path = (
        F.when(F.col("event_type") == "signup", "/api/v1/auth/register")
        .when(F.col("event_type") == "error", "/upload/file")
        .when(F.col("event_type") == "click", "/api/v1/ml/predict")
        .otherwise("/api/v1/data")
    )
    who = F.when(F.col("user_id") % 3 != 0, F.col("user_id"))
    ip = F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string"))
    return raw.select(
        F.col("event_id").alias("request_id"), "ts", keyed.identifier(who, ip).alias("identifier"), path.alias("path")
    )


def day_limits():
    return keyed.RequestLimits(DAY_LIMITS, 86400)


@register(
    "str13_request_limits",
    f"""WITH {REQ}, lim AS (SELECT *, least(CASE WHEN identifier LIKE 'user:%' THEN 3 ELSE 2 END,
    CASE path WHEN '/api/v1/auth/register' THEN 1 WHEN '/upload/file' THEN 2 WHEN '/api/v1/ml/predict' THEN 2 END) AS lim,
  row_number() OVER (PARTITION BY identifier, CAST(ts AS DATE) ORDER BY ts, request_id) AS n,
  (epoch_us(CAST(ts AS DATE)::TIMESTAMP) // 1000000 + 86400) AS reset_time FROM req)
SELECT request_id, identifier, CAST(n AS BIGINT) AS n, n <= lim AS allowed, CAST(greatest(0, lim - n) AS BIGINT) AS remaining, reset_time FROM lim""",
)
def _(t):
    checked = keyed.check_requests(requests(t.raw("events")), day_limits())
    return checked.select("request_id", "identifier", "n", "allowed", "remaining", "reset_time")


@register(
    "str13_request_counts_stream",
    f"""WITH {REQ} SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, identifier, count(*) AS requests FROM req GROUP BY 1, 2""",
)
def _(t):
    path = shared_dir(t.spark, "str13")
    counts = keyed.request_counts(requests(raw_stream(t)), day_limits(), "1 minute")
    done(
        sinks.batch_stream(
            counts,
            lambda df, i: changes.publish(df, path, f"{sinks.stream_id(t.spark)}-{i}") and None,
            f"{path}-cp",
            None,
        )
    )
    rows = changes.read_merged(t.spark, path, ["window_start", "identifier"])
    return rows.select("window_start", "identifier", "requests")


@register(
    "str14_query_registry",
    ctes("ev", f"SELECT CASE {TOPIC} WHEN 'customer-events' THEN 'customer' WHEN 'transaction-events' THEN 'transaction' ELSE 'analytics' END AS name, false AS active, count(*) AS rows FROM ev GROUP BY 1"),
)
def _(t):
    path = shared_dir(t.spark, "str14")
    files = envelope_files(t, "str14in")
    registry = sinks.QueryRegistry(t.spark)
    for name, topic in (("customer", TOPIC_CUSTOMER), ("transaction", TOPIC_TRANSACTION), ("analytics", TOPIC_ANALYTICS)):
        stream = sources.event_stream(t.spark, "files", files, [topic])
        registry.add(name, sinks.append_stream(stream, f"{path}/{name}", f"{path}/cp/{name}", None))
    registry.wait()
    registry.stop()
    out = None
    for name, state in registry.status().items():
        rows = t.spark.read.schema(ENVELOPE).parquet(f"{path}/{name}").agg(F.count("*").alias("rows"))
        line = rows.select(F.lit(name).alias("name"), F.lit(state["active"]).alias("active"), "rows")
        out = line if out is None else out.unionByName(line)
    return out
