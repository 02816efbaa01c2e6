"""Queries: scans and sinks. Each writes whole tables and reads them back."""

from datetime import date

from pyspark.sql import functions as F

from eventmill.catalog.marts import CUSTOMER_360, DAILY, DEVICE, PRODUCT, c360
from eventmill.catalog.registry import ctes, more, register, rounded
from eventmill.catalog.rollups import GOLD, day_window
from eventmill.functions.scalars import ago, latest
from eventmill.operators import changes, documents, marts, rollups, writers
from eventmill.schemas import BRONZE_TABLES, GOLD_TABLES, SOURCE_TABLES
from eventmill.session import shared_dir
from eventmill.sources import tables
from eventmill.sources.tables import Lake

EVN = "(SELECT max(ts) FROM events)"


def lake(t, label):
    return Lake(t.spark, shared_dir(t.spark, label))


@register("src6_layer_scan", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _(t):
    lk = lake(t, "src6")
    writers.write_table(t.raw("events"), lk.path("bronze", "events"))
    return lk.read("bronze", "events", SOURCE_TABLES["events"])


@register(
    "src7_guarded_scan",
    """SELECT 'present' AS state, count(*) AS rows FROM customer UNION ALL SELECT 'missing', 0 UNION ALL SELECT 'empty', 0""",
)
def _(t):
    lk = lake(t, "src7")
    writers.write_table(t.raw("customer"), lk.path("gold", "present"))
    writers.write_table(t.raw("customer").limit(0), lk.path("gold", "empty"))
    out = None
    for state in ("present", "missing", "empty"):
        df = tables.read_if_present(t.spark, lk.path("gold", state))
        if df is None:
            df = tables.read_or_empty(t.spark, lk.path("gold", "missing"), SOURCE_TABLES["customer"])
        line = df.agg(F.count("*").alias("rows")).select(F.lit(state).alias("state"), "rows")
        out = line if out is None else out.unionByName(line)
    return out


@register(
    "src8_time_range_scan",
    ctes("ev", f"SELECT event_id, event_ts, value FROM ev WHERE event_ts BETWEEN {EVN} - INTERVAL 10 DAY AND {EVN} - INTERVAL 3 DAY"),
)
def _(t):
    now = latest(t.raw("events"), "ts")
    return tables.read_time_range(t.events, ago(now, days=10), ago(now, days=3)).select("event_id", "event_ts", "value")


@register(
    "src9_gold_window_scan",
    more(
        "ev tx",
        GOLD,
        f"""SELECT window_start, action, device_type, event_count FROM gold_c
WHERE window_start >= {EVN} - INTERVAL 2 DAY AND window_start + INTERVAL 5 MINUTE <= {EVN} - INTERVAL 1 DAY""",
    ),
)
def _(t):
    now = latest(t.raw("events"), "ts")
    gold = rollups.windowed_customer_metrics(t.events)
    return tables.read_gold_window(gold, ago(now, days=2), ago(now, days=1)).select(
        "window_start", "action", "device_type", "event_count"
    )


@register(
    "src10_date_folder_scan",
    """SELECT CAST(ts AS DATE) AS day, count(*) AS rows, CAST(count(CASE WHEN day(ts) = 5 THEN 1 END) AS BIGINT) AS extra_values FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-06' AND day(ts) <> 4 GROUP BY 1""",
)
def _(t):
    base = shared_dir(t.spark, "src10")
    # one folder per day: padded and unpadded names, one day missing, one day with a further column
    for name, day, more_columns in (("2024-01-03", 3, {}), ("2024-1-5", 5, {"extra": F.lit(1)}), ("2024-01-06", 6, {}), ("2024-01-09", 9, {})):
        rows = t.raw("events").filter(F.to_date("ts") == F.lit(date(2024, 1, day)))
        writers.write_table(rows.withColumns(more_columns) if more_columns else rows, f"{base}/{name}/windows")
    df = tables.read_date_folders(t.spark, base, "windows", date(2024, 1, 3), date(2024, 1, 7))
    return df.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("rows"), F.count("extra").alias("extra_values"))


@register(
    "src11_bronze_by_partition",
    "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) = DATE '2024-01-10'",
)
def _(t):
    path = lake(t, "src11").path("bronze", "events")
    rows = t.raw("events").withColumn("partition_date", F.to_date("ts"))
    writers.write_table(rows, path, partition_by=["partition_date", "event_type"])
    bronze = tables.read_table(t.spark, path)
    return tables.read_bronze(bronze, "purchase", "2024-01-10").select("event_id", "user_id", "value")


@register("lim4_plain_limit", "SELECT least(count(*), 1000) AS rows, 'purchase' AS event_type FROM events WHERE event_type = 'purchase'")
def _(t):
    path = lake(t, "lim4").path("bronze", "events")
    writers.write_table(t.raw("events").withColumn("partition_date", F.to_date("ts")), path, partition_by=["event_type"])
    rows = tables.read_bronze(tables.read_table(t.spark, path), "purchase", limit=1000)
    return rows.agg(F.count("*").alias("rows"), F.max("event_type").alias("event_type"))


@register(
    "src12_json_folder_scan",
    """SELECT event_type, count(*) AS rows, count(*) FILTER (event_id % 97 <> 0) AS good,
  count(*) FILTER (event_id % 97 = 0) AS corrupt FROM events GROUP BY 1""",
)
def _(t):
    path = shared_dir(t.spark, "src12")
    line = F.to_json(F.struct("event_id", "user_id", "value"))
    torn = F.when(F.col("event_id") % 97 == 0, F.substring(line, 1, 9)).otherwise(line)
    rows = t.raw("events").select(torn.alias("value"), "event_type", F.date_format("ts", "yyyy-MM-dd").alias("date"))
    writers.rebalanced(rows, ["event_type", "date"]).write.partitionBy("event_type", "date").text(path)
    fields = [f for f in SOURCE_TABLES["events"] if f.name in ("event_id", "user_id", "value")]
    df = tables.read_json_folders(t.spark, path, type(SOURCE_TABLES["events"])(fields))
    return df.groupBy("event_type").agg(
        F.count("*").alias("rows"), F.count("event_id").alias("good"), F.count("_corrupt_record").alias("corrupt")
    )


@register("src13_xml_scan", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(t):
    path = shared_dir(t.spark, "src13")
    rows = t.raw("customer").select("c_custkey", "c_name", "c_mktsegment")
    rows.write.format("xml").option("rowTag", "customer").option("rootTag", "customers").save(path)
    return tables.read_xml(t.spark, path, "customer", rows.schema)


@register("src14_records_frame", "SELECT event_id, user_id, event_type, value FROM events")
def _(t):
    path = shared_dir(t.spark, "src14")
    rows = t.raw("events").select("event_id", "user_id", "event_type", "value")
    rows.write.json(path)
    return tables.records_frame(t.spark, path, rows.schema)


for _label, _parts, _interval in (
    ("minutes", {"mins": 90}, "90 MINUTE"),
    ("hours", {"hours": 24}, "24 HOUR"),
    ("days", {"days": 7}, "7 DAY"),
):
    register(f"src15_last_{_label}", f"SELECT event_id, event_type, value FROM events WHERE ts >= {EVN} - INTERVAL {_interval}")(
        lambda t, p=_parts: tables.since(t.raw("events"), "ts", latest(t.raw("events"), "ts"), **p).select(
            "event_id", "event_type", "value"
        )
    )


# --- sinks -------------------------------------------------------------------------
def _stored(t, label, df):
    path = lake(t, label).path("gold", label)
    writers.write_table(df, path)
    return tables.read_table(t.spark, path, df.schema)


register("snk7_mart_customer_360", ctes("ev", CUSTOMER_360))(lambda t: _stored(t, "customer_360", c360(t)))
register("snk7_mart_products", ctes("ev", PRODUCT))(
    lambda t: _stored(t, "product_analytics", rounded(marts.product_analytics(t.events)))
)
register("snk7_mart_daily", ctes("ev", DAILY))(lambda t: _stored(t, "daily", rounded(marts.daily_metrics(t.events))))
register("snk7_mart_devices", ctes("ev", DEVICE))(
    lambda t: _stored(t, "devices", rounded(marts.device_performance(t.events)))
)


@register("snk8_single_file", "SELECT 1::BIGINT AS files, count(DISTINCT event_type) AS rows FROM events")
def _(t):
    path = lake(t, "snk8").path("gold", "actions")
    writers.write_table(marts.action_summary(t.events), path, single_file=True)
    files = writers.files_of(t.spark, path).filter(F.col("path").endswith(".parquet"))
    return files.agg(F.count("*").alias("files")).withColumn(
        "rows", tables.read_table(t.spark, path).agg(F.count("*")).scalar()
    )


@register("snk9_append_gold", "SELECT event_type AS action, 2 * count(*) AS event_count FROM events GROUP BY 1")
def _(t):
    path = lake(t, "snk9").path("gold", "actions")
    counts = t.raw("events").groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("event_count"))
    for df in (counts, None, counts.filter("1 = 0"), counts):
        writers.append_if_any(df, path)
    return tables.read_table(t.spark, path).groupBy("action").agg(F.sum("event_count").alias("event_count"))


UPSERT = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders
UNION ALL SELECT -1 - c_custkey, 'N', c_acctbal FROM customer"""


def upsert_updates(t):
    """A third of the orders changed, each update sent twice, and new keys from the customers."""
    changed = t.raw("orders").filter("o_orderkey % 3 = 0").select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(2).alias("seq")
    )
    stale = changed.withColumns({"o_orderstatus": F.lit("stale"), "seq": F.lit(1)})
    new = t.raw("customer").select(
        (-1 - F.col("c_custkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.col("c_acctbal").alias("o_totalprice"), F.lit(1).alias("seq")
    )
    return changed.unionByName(stale).unionByName(new)


def _upserted(t):
    path = lake(t, "snk10").path("silver", "orders")
    base = t.raw("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(0).alias("seq"))
    changes.publish(base, path)
    for _ in range(2):  # the second time must change nothing
        changes.upsert(upsert_updates(t), path, ["o_orderkey"], ["seq"])
    return changes.read_merged(t.spark, path, ["o_orderkey"])


register("snk10_upsert", UPSERT)(lambda t: rounded(_upserted(t).drop("seq"), 2))
register("jn3_equi_merge", f"SELECT o_orderstatus, count(*) AS rows FROM ({UPSERT}) GROUP BY 1")(
    lambda t: _upserted(t).groupBy("o_orderstatus").agg(F.count("*").alias("rows"))
)


@register(
    "snk10_partitioned_upsert",
    """SELECT CAST(ts AS DATE) AS day, event_type, CASE WHEN day(ts) BETWEEN 10 AND 12 THEN count(*) * 10 ELSE count(*) END AS n
FROM events GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY CAST(ts AS DATE), event_type, day(ts)"),
)
def _(t):
    path = lake(t, "snk10p").path("gold", "daily_types")
    daily = t.raw("events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    writers.upsert_partitions(daily, path, ["day", "event_type"], "day")
    fix = daily.filter(F.dayofmonth("day").between(10, 12)).withColumn("n", F.col("n") * 10)
    for _ in range(2):
        writers.upsert_partitions(fix, path, ["day", "event_type"], "day")
    return t.spark.read.parquet(path).select("day", "event_type", "n")


@register(
    "snk11_append_evolving",
    "SELECT event_type, count(*) * 2 AS rows, count(*) AS with_day FROM events GROUP BY 1",
)
def _(t):
    path = lake(t, "snk11").path("bronze", "events")
    writers.append_evolving(t.raw("events").select("event_id", "event_type"), path)
    writers.append_evolving(t.raw("events").select("event_id", "event_type", F.to_date("ts").alias("day")), path)
    merged = writers.read_evolving(t.spark, path)
    return merged.groupBy("event_type").agg(F.count("*").alias("rows"), F.count("day").alias("with_day"))


for _name in ("snk12_validated_write", "snk13_safe_write"):

    @register(_name, "SELECT count(*) AS rows, false AS accepted_bad, true AS accepted_good FROM events")
    def _(t, name=_name):
        path = lake(t, name).path("bronze", "events")
        good = t.raw("events")
        bad = good.withColumn("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id")))

        def no_nulls(df):
            return (F.count_if(F.col("event_id").isNull()) == 0) & (F.count("*") > 0)

        refused = writers.validated_write(bad, path, valid=no_nulls)
        accepted = writers.validated_write(good, path, valid=no_nulls)
        rows = writers.read_evolving(t.spark, path).agg(F.count("*").alias("rows"))
        return rows.withColumns({"accepted_bad": F.lit(refused), "accepted_good": F.lit(accepted)})


@register("snk14_format_choice", "SELECT fmt, event_type AS action, count(*) AS n FROM events, (VALUES ('parquet'), ('json')) f(fmt) GROUP BY 1, 2")
def _(t):
    lk = lake(t, "snk14")
    counts = t.raw("events").groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("n"))
    out = None
    for fmt in ("parquet", "json"):
        path = lk.path("gold", f"actions_{fmt}")
        writers.write_table(counts, path, fmt=fmt)
        back = t.spark.read.schema(counts.schema).format(fmt).load(path).withColumn("fmt", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


@register("snk15_registered_table", "SELECT CAST(ts AS DATE) AS partition_date, event_type, count(*) AS n, 'job_1' AS job_id FROM events GROUP BY 1, 2")
def _(t):
    path = lake(t, "snk15").path("bronze", "events")
    name = "bronze_events_" + path.rsplit("-", 1)[1].split("/")[0]
    rows = t.raw("events").withColumns({"partition_date": F.to_date("ts"), "job_id": F.lit("job_1")})
    writers.register_table(rows, path, name, ["partition_date", "event_type"])
    return t.spark.table(name).groupBy("partition_date", "event_type", "job_id").agg(F.count("*").alias("n"))


@register("snk16_json_by_type", "SELECT event_type, count(*) AS event_count, true AS has_bytes FROM events GROUP BY 1")
def _(t):
    path = shared_dir(t.spark, "snk16")
    rows = t.raw("events").select("event_id", "event_type", "user_id", "value")
    writers.write_json_by_type(rows, path, "job_1", latest(t.raw("events"), "ts"))
    report = writers.json_report(t.spark, path, rows.schema)
    return report.select("event_type", "event_count", (F.col("file_size_bytes") > 0).alias("has_bytes"))


@register("snk17_generated_documents", "SELECT count(*) AS rows, count(*) AS ids FROM customer")
def _(t):
    path = shared_dir(t.spark, "snk17")
    documents.append_documents(t.raw("customer"), path, latest(t.raw("events"), "ts"))
    back = t.spark.read.schema("doc_id string, c_custkey bigint").json(path)
    return back.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"))


EVENT_DOCS = f"""SELECT epoch_us(date_trunc('second', {EVN} - INTERVAL 1 DAY)) // 1000000 || '_' || event_type AS doc_id, event_type,
  strftime({EVN} - INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ') AS window_start, strftime({EVN}, '%Y-%m-%dT%H:%M:%SZ') AS window_end,
  count(*) AS event_count, count(DISTINCT customer_id) AS unique_customers
FROM ev WHERE event_ts >= {EVN} - INTERVAL 1 DAY AND event_ts <= {EVN} GROUP BY event_type"""
_DOC = ["doc_id", "event_type", "window_start", "window_end", "event_count", "unique_customers"]


def _event_docs(t):
    gold = rollups.window_event_analytics(t.events, *day_window(t))
    return documents.documents(gold.drop("created_at"), "event_analytics")


register("prj24_documents", ctes("ev", EVENT_DOCS))(lambda t: _event_docs(t).select(*_DOC))


@register("snk18_document_upsert", ctes("ev", EVENT_DOCS))
def _(t):
    path = lake(t, "snk18").path("gold", "event_documents")
    for _ in range(2):
        documents.upsert_documents(_event_docs(t), path)
    return documents.read_documents(t.spark, path).select(*_DOC)


@register("snk19_document_replace", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    path = shared_dir(t.spark, "snk19")
    counts = t.raw("events").groupBy("event_type").agg(F.count("*").alias("n"))
    for _ in range(2):
        documents.replace_documents(counts, path)
    return t.spark.read.schema(counts.schema).json(path)


@register(
    "snk20_bulk_lines",
    """SELECT value, count(*) AS n FROM (SELECT '{"index":{"_index":"customers"}}' AS value FROM customer
UNION ALL SELECT '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' FROM customer) GROUP BY 1""",
)
def _(t):
    path = shared_dir(t.spark, "snk20")
    documents.write_bulk(t.raw("customer").select("c_custkey", "c_mktsegment"), "customers", path)
    return t.spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


@register(
    "snk21_ensure_tables",
    """SELECT 'gold' AS layer, 4 AS tables, 4 AS created_first, 0 AS created_again, count(*) AS events FROM events
UNION ALL SELECT 'bronze', 3, 3, 0, count(*) FROM events""",
)
def _(t):
    lk = lake(t, "snk21")
    out = None
    for layer, schemas in (("gold", GOLD_TABLES), ("bronze", BRONZE_TABLES)):
        paths = {lk.path(layer, n): s for n, s in schemas.items()}
        first, again = (len(writers.ensure_tables(t.spark, paths)) for _ in range(2))
        line = t.raw("events").agg(F.count("*").alias("events")).select(
            F.lit(layer).alias("layer"),
            F.lit(len(paths)).alias("tables"),
            F.lit(first).alias("created_first"),
            F.lit(again).alias("created_again"),
            "events",
        )
        out = line if out is None else out.unionByName(line)
    return out


@register("snk24_compaction", "SELECT count(*) AS rows, 1::BIGINT AS files_after, true AS fewer FROM orders")
def _(t):
    path = lake(t, "snk24").path("silver", "orders")
    writers.write_version(t.raw("orders").repartition(8, "o_orderkey"), path)
    report = writers.compact(t.spark, path, ["o_orderdate", "o_custkey"])
    return report.select("rows", "files_after", (F.col("files_after") < F.col("files_before")).alias("fewer"))


@register("snk25_retention", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
def _(t):
    path = lake(t, "snk25").path("bronze", "events")
    rows = t.raw("events").withColumn("day", F.to_date("ts"))
    writers.write_table(rows, path, partition_by=["day"])
    writers.drop_old_partitions(t.spark, path, "day", "2024-01-15")
    return tables.read_table(t.spark, path).groupBy("day").agg(F.count("*").alias("n"))


@register("snk26_table_health", "SELECT CAST(ts AS DATE) AS day, 1::BIGINT AS files, count(*) AS rows, NULL::VARCHAR AS issue FROM events GROUP BY 1")
def _(t):
    path = lake(t, "snk26").path("bronze", "events")
    rows = t.raw("events").withColumn("day", F.to_date("ts"))
    writers.write_table(rows, path, partition_by=["day"])
    return writers.table_health(t.spark, path, "day").select("day", "files", "rows", "issue")
