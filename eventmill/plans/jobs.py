"""The jobs users run: thin compositions of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.functions.scalars import as_column
from eventmill.operators import (
    changes,
    contracts,
    documents,
    enrich,
    marts,
    nested,
    rollups,
    service,
    writers,
)
from eventmill.schemas import BRONZE_TABLES, GOLD_TABLES, VPC_CLERK, VPC_EVENT
from eventmill.session import stage
from eventmill.sources import tables
from eventmill.sources.tables import Lake
from eventmill.streaming import medallion, sinks


# --- streaming medallion ---------------------------------------------------------------
def start_medallion(lake: Lake, envelope: DataFrame, continuous: bool = True) -> sinks.QueryRegistry:
    """Bronze, silver, gold and event-rate streams, and the real-time chain beside them: typed
    bronze, its 30-second metrics and their minute dashboard.

    ``continuous=False`` runs each layer to the end of the available data.
    """
    registry = sinks.QueryRegistry(lake.spark)

    def layer(start) -> None:
        for name, query in start().items():
            registry.add(name, query)
        if not continuous:
            registry.wait()

    def every(interval: str) -> str | None:
        return interval if continuous else None

    # downstream streams need a folder to watch, not rows
    medallion.create_folders(lake, "bronze", ["raw_events"])
    medallion.create_folders(lake, "silver", list(medallion.SILVER_TABLES))
    layer(lambda: {"raw_events": medallion.raw_bronze(lake, envelope, every(sinks.RAW_BRONZE))})
    layer(lambda: medallion.silver_tables(lake, every(sinks.SILVER)))
    layer(lambda: medallion.gold_metrics(lake, every(sinks.GOLD)))
    layer(lambda: {"event_rates": medallion.event_rates(lake, every(sinks.EVENT_RATE))})
    medallion.create_folders(lake, "bronze", list(medallion.TYPED_TOPICS))
    typed = medallion.typed_bronze_tables(lake, envelope, every(sinks.TYPED_BRONZE))
    layer(lambda: {f"typed_{name}": query for name, query in typed.items()})
    behavior = medallion.typed_stream(lake, "customer_behavior")
    layer(lambda: {"realtime_metrics": medallion.realtime_metrics(behavior, lake, every(sinks.SILVER_METRICS))})
    return registry


# --- batch marts -----------------------------------------------------------------------
def customer_marts(lake: Lake, events: DataFrame, as_of) -> dict[str, str]:
    """Five marts off one event table. Each scan reads only the columns its mart needs."""
    results = {
        "customer_360": marts.customer_360(events, as_of),
        "customer_segments": marts.rfm_segments(marts.rfm_base(events, as_of)),
        "product_analytics": marts.product_analytics(events),
        "daily_metrics": marts.daily_metrics(events),
        "device_performance": marts.device_performance(events),
    }
    return {name: _overwrite(lake, name, df) for name, df in results.items()}


def _overwrite(lake: Lake, name: str, df: DataFrame, **kw) -> str:
    path = lake.path("gold", name)
    writers.write_table(df, path, **kw)
    return path


def _earliest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("customer_id").agg(F.min("first_seen").alias("first_seen"), F.max("until").alias("until"))


def first_seen_table(lake: Lake) -> DataFrame | None:
    """Customers with the time of their first event, as far as the window jobs have read."""
    return changes.read_totals(lake.spark, lake.path("gold", "customer_first_seen"), _earliest)


def _learn_first_seen(lake: Lake, events: DataFrame, ingested: str | None) -> DataFrame:
    """Bring ``customer_first_seen`` up to date; returns the customers whose first event changed, with the
    old time (NULL for new ones).

    ``ingested`` names the column with the time an event came in: then only events since the
    newest one read before are grouped, however early or late they happened. Without it the
    whole history is.
    """
    path = lake.path("gold", "customer_first_seen")
    before = first_seen_table(lake)
    until = F.max(ingested) if ingested else F.lit(None).cast("timestamp")
    since = before.agg(F.max("until")).first()[0] if before is not None and ingested else None
    fresh = events.filter(F.col(ingested) >= F.lit(since)) if since is not None else events
    fresh = fresh.filter(F.col("customer_id").isNotNull()).groupBy("customer_id")
    found = fresh.agg(F.min("event_ts").alias("first_seen"), until.alias("until"))
    if before is None:
        found = found.withColumn("was", F.lit(None).cast("timestamp"))
    else:
        old = before.select("customer_id", F.col("first_seen").alias("was"))
        found = found.join(old, "customer_id", "left").filter(F.col("was").isNull() | (F.col("first_seen") < F.col("was")))
    found = stage(found, "first-seen")
    if not found.isEmpty():
        changes.publish(found.drop("was"), path)
        changes.fold(lake.spark, path, totals=_earliest, at_least=FOLD_AFTER)
    return found


def _days(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.to_date(start), F.to_date(end)))


def _mend_new_customers(lake: Lake, moved: DataFrame) -> None:
    """Count ``new_customers`` again in earlier windows that hold an old or new first event of ``moved``."""
    path = lake.path("gold", "customer_metrics")
    gold = tables.read_if_present(lake.spark, path)
    if gold is None:
        return
    stored = gold.select("window_start", "window_end", _days(F.col("window_start"), F.col("window_end")).alias("_day"))
    times = moved.select(F.explode(F.array("first_seen", "was")).alias("_at")).filter("_at IS NOT NULL")
    inside = F.col("_at").between(F.col("window_start"), F.col("window_end"))
    touched = stored.join(times.withColumn("_day", F.to_date("_at")), "_day").filter(inside)
    touched = touched.select("window_start", "window_end").distinct()
    spread = touched.select("*", _days(F.col("window_start"), F.col("window_end")).alias("_day"))
    firsts = first_seen_table(lake).select(F.col("first_seen").alias("_at"), F.to_date("first_seen").alias("_day"))
    counted = spread.join(firsts, "_day").filter(inside).groupBy("window_start", "window_end").agg(F.count("*").alias("_new"))
    windows = touched.join(counted, ["window_start", "window_end"], "left")
    again = gold.join(windows, ["window_start", "window_end"]).withColumn("new_customers", F.coalesce("_new", F.lit(0)))
    again = stage(again.select(*gold.columns), "mended")
    if not again.isEmpty():
        writers.upsert_partitions(again, path, ["window_start", "window_end"], "window_date", unique=True)


def window_aggregation(
    lake: Lake, events: DataFrame, campaigns: DataFrame, segments: DataFrame, start, end, created_at=None, ingested: str | None = None
):
    """Four metric tables for one window. Running a window again replaces its rows.

    ``customer_first_seen`` is a keyed minimum, so that an event that comes in after its window
    was run still counts: its customer isn't new any more in later windows, and
    earlier windows that took the customer for new are counted again. See
    :func:`_learn_first_seen` for ``ingested``.
    """
    moved = _learn_first_seen(lake, events, ingested)
    known = first_seen_table(lake)
    known = moved.select("customer_id") if known is None else known.filter(F.col("first_seen") < as_column(start))
    results = {
        "customer_metrics": rollups.window_customer_metrics(events, start, end, created_at, known),
        "campaign_metrics": rollups.window_campaign_metrics(campaigns, start, end, created_at),
        "event_analytics": rollups.window_event_analytics(events, start, end, created_at),
        "segment_metrics": rollups.window_segment_metrics(events, segments, start, end, created_at),
    }
    for name, df in results.items():
        keys = ["window_start", "window_end"] + [c for c in (documents.DIMENSION[name],) if c]
        dated = df.withColumn("window_date", F.to_date("window_start"))
        writers.upsert_partitions(dated, lake.path("gold", name), keys, "window_date")
    _mend_new_customers(lake, moved)


def range_aggregation(
    lake: Lake, events: DataFrame, transactions: DataFrame, metrics: DataFrame, start, end, run_id: str, fmt: str = "parquet"
) -> dict[str, str]:
    """Seven run aggregates over a time range, bounds included."""
    e = rollups.between(events, "event_ts", start, end)
    x = rollups.between(transactions, "created_at", start, end)
    m = rollups.between(metrics, "event_ts", start, end)
    results = {
        "customer_action_aggregations": marts.stamp(marts.action_summary(e), "customer_actions", end),
        "customer_hourly_aggregations": marts.stamp(marts.hourly_customer_summary(e), "customer_hourly", end),
        "transaction_status_aggregations": marts.stamp(marts.transaction_status_summary(x), "transaction_status", end),
        "revenue_hourly_aggregations": marts.stamp(marts.hourly_revenue(x), "revenue_hourly", end),
        "system_metrics_summary": marts.stamp(marts.metric_summary(m), "system_metrics", end),
        "system_metrics_timeseries": marts.stamp(marts.metric_timeseries(m), "metrics_timeseries", end),
        "pipeline_run_summary": marts.run_summary(
            {"customer_events": e, "transaction_events": x, "system_metrics": m}, run_id, start, end, end
        ),
    }
    return {name: _overwrite(lake, name, df, fmt=fmt) for name, df in results.items()}


def hourly_rollup(lake: Lake, customer_windows: DataFrame, transaction_windows: DataFrame, customer_now, transaction_now) -> dict:
    """Last-day hourly tables; small, so one file each."""
    results = {
        "customer_hourly": marts.stamp(
            rollups.hourly_customer_rollup(customer_windows, customer_now), "customer_behavior", customer_now
        ),
        "transaction_hourly": marts.stamp(
            rollups.hourly_transaction_rollup(transaction_windows, transaction_now), "transaction_summary", transaction_now
        ),
    }
    return {name: _overwrite(lake, name, df, single_file=True) for name, df in results.items()}


# --- export -----------------------------------------------------------------------------
def export_windows(lake: Lake, out: str, start, end) -> list[str]:
    """Windowed gold tables as documents, upserted by their id; missing or empty tables are skipped."""
    written = []
    for name in documents.DIMENSION:
        gold = tables.read_if_present(lake.spark, lake.path("gold", name))
        if gold is None:
            continue
        rows = tables.read_gold_window(gold.drop("window_date"), start, end)
        documents.upsert_documents(documents.documents(rows, name), f"{out}/{name}")
        written.append(name)
    return written


def export_generated(lake: Lake, out: str, names: list[str], ingested_at=None) -> list[str]:
    """Gold tables without a natural id, appended with a content id."""
    written = []
    for name in names:
        gold = tables.read_if_present(lake.spark, lake.path("gold", name))
        if gold is not None:
            documents.append_documents(gold, f"{out}/{name}", ingested_at)
            written.append(name)
    return written


RUN_TABLES = (
    "customer_action_aggregations", "customer_hourly_aggregations", "transaction_status_aggregations",
    "revenue_hourly_aggregations", "system_metrics_summary", "system_metrics_timeseries", "pipeline_run_summary",
)
HOURLY_TABLES = ("customer_hourly", "transaction_hourly")


def document_export(lake: Lake, out: str, start, end, ingested_at=None) -> list[str]:
    """All gold tables that exist: windows by their id, run and hourly tables by content."""
    return export_windows(lake, out, start, end) + export_generated(lake, out, [*RUN_TABLES, *HOURLY_TABLES], ingested_at)


def export_lookups(lookups: dict[str, DataFrame], out: str) -> None:
    for name, df in lookups.items():
        documents.replace_documents(df, f"{out}/{name}")


# --- ingest ----------------------------------------------------------------------------
def contract_ingest(lake: Lake, rows: DataFrame, contract: dict, domain: str, product: str, as_of, aggregate: bool = True) -> dict:
    """Contract rows to bronze, then its SQL aggregations over all of bronze to gold, each replacing its last result."""
    table = f"{domain}_{product}".replace("-", "_")
    path = lake.path("bronze", table)
    clean = contracts.apply_contract(rows, contract, as_of)
    ok = writers.validated_write(clean, path, partition_by=["year", "month", "day"])
    results = []
    if ok and aggregate:
        src = writers.read_evolving(lake.spark, path)

        def write(target: str, df: DataFrame) -> None:
            out = contracts.with_partition_columns(df, as_of)
            writers.write_table(out, lake.path("gold", target), partition_by=["year", "month", "day"])

        results = contracts.run_aggregations(src, table, contract, write)
    return {"success": ok, "table": table, "aggregations": results}


#: Batches of a merged table before they are folded into a new base.
FOLD_AFTER = 24

INCIDENT_KEYS = {
    "Incident": ["PrimaryFileName"],
    "IncidentFiles": ["PrimaryFileName", "ordinal"],
    "IncidentHistory": ["PrimaryFileName", "ordinal"],
}


def incident_tables(incidents: DataFrame, states: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    flat = {
        "Incident": nested.incident_main(incidents),
        "IncidentFiles": nested.incident_files(incidents),
        "IncidentHistory": nested.incident_history(incidents, states),
    }
    return {name: nested.with_insertion_date(enrich.clean_names(df)) for name, df in flat.items()}


def incident_ingest(
    lake: Lake, incidents: DataFrame, states: dict[str, tuple[str, str]], partition_unit: str = "day"
) -> None:
    """Bronze append, silver merge by key and the lookup table.

    Bronze is partitioned by insertion date, or by month where days hold few rows.
    """
    for name, df in incident_tables(incidents, states).items():
        dated = df
        if partition_unit != "day":
            dated = df.withColumn("date", F.date_trunc(partition_unit, "date").cast("date"))
        writers.write_table(dated, lake.path("bronze", name), "append", partition_by=["date"])
        changes.upsert(df, lake.path("silver", name), INCIDENT_KEYS[name], ["InsertionTime"])
        changes.fold(lake.spark, lake.path("silver", name), INCIDENT_KEYS[name], at_least=FOLD_AFTER)
    lookup = lake.path("silver", "IncidentLookup")
    existing = writers.read_current(lake.spark, lookup)
    writers.write_version(nested.incident_lookups(incidents, existing), lookup)
    writers.expire_versions(lake.spark, lookup)


def traffic_ingest(lake: Lake, records: DataFrame, as_of) -> None:
    """Header sessions and passages to bronze; their values join those of earlier deliveries in the lookup."""
    writers.append_evolving(nested.header_sessions(records, as_of), lake.path("bronze", "TrafficHeaderSession"))
    passages = nested.passages(records, as_of)
    writers.write_table(passages, lake.path("bronze", "TrafficData"), "append", partition_by=["year", "month", "day"])
    lookup = lake.path("bronze", "TrafficLookup")
    existing = writers.read_current(lake.spark, lookup)
    writers.write_version(nested.traffic_lookups(records, existing), lookup)
    writers.expire_versions(lake.spark, lookup)


def vpc_ingest(lake: Lake, events: DataFrame, clerks: DataFrame, batch_id: str, processed_at) -> dict[str, bool]:
    """Typed event and clerk rows with batch metadata; an empty or keyless batch is refused."""
    out = {}
    for name, df, schema, key in (
        ("VpcEvent", events, VPC_EVENT, "EventId"),
        ("VpcClerks", clerks, VPC_CLERK, "ClerkId"),
    ):
        typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        rows = enrich.with_metadata(typed, batch_id, processed_at=processed_at).drop("etl_version")

        def usable(_, key=key):
            return (F.count("*") > 0) & (F.count_if(F.col(key).isNull()) == 0)

        out[name] = writers.validated_write(rows, lake.path("bronze", name), valid=usable)
    return out


def event_ingest(lake: Lake, events: DataFrame, batch_id: str, as_of) -> DataFrame:
    """Metadata, defaults, required fields, bronze by day and type; returns counts per type."""
    rows = enrich.run_chain(
        events,
        [lambda df: enrich.with_metadata(df, batch_id, processed_at=as_of)],
        [lambda df: enrich.fill_defaults(df, as_of), lambda df: enrich.require(df, ["event_type"])],
    ).withColumns({"partition_date": F.to_date(as_column(as_of)), "job_id": F.lit(batch_id)})
    path = lake.path("bronze", "events")
    writers.write_table(rows, path, "append", partition_by=["partition_date", "event_type"])
    day = F.to_date(as_column(as_of))
    stored = lake.spark.read.parquet(path).filter((F.col("partition_date") == day) & (F.col("job_id") == batch_id))
    return service.event_type_counts(stored)


def check_tables(lake: Lake) -> DataFrame:
    return tables.table_counts(lake, "bronze", BRONZE_TABLES).unionByName(tables.table_counts(lake, "gold", GOLD_TABLES))
