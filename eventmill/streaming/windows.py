"""Windowed stream metrics with exact distinct counts.

Spark rejects distinct aggregates on streams, and a set per window would pile
all customers of a hot window up in one state row. Here the state has one small
row per (window, dimensions, customer), spread by the shuffle.

Two ways to publish:

* ``append_metrics`` chains the second aggregation in the stream itself and emits
  a window once the watermark has passed it.
* ``publish_metrics`` writes what each batch adds: counts and sums of its events, and how
  many customers its windows had not seen, which the engine's deduplication state tells.
  Readers add the batches up, so what a batch writes doesn't grow with what came before,
  and there is no copy of the state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventmill.operators import changes
from eventmill.streaming.sinks import batch_stream, stream_id

#: 1 for an event; the customer on a row that says it is new in its window; newest event time of a batch
EVENT, FIRST, LATEST = "_event", "_first", "_latest"


@dataclass(frozen=True)
class WindowMetric:
    """``partial`` aggregates ``inputs`` of events, or ``_event`` for their number; ``merge`` puts partial
    rows together (sums unless named) and ``final`` is computed from merged columns. ``distinct``
    names the exact count of ``unit`` values, None where there is none."""

    time: str
    width: str
    delay: str
    dims: list[str]
    inputs: list[str]
    partial: dict[str, Column]
    final: dict[str, Column]
    unit: str | None = "customer_id"
    distinct: str = "unique_customers"
    merge: dict[str, Callable] = field(default_factory=dict)
    round_to: dict[str, int] = field(default_factory=dict)

    @property
    def unit_columns(self) -> list[str]:
        return [self.unit] if self.unit else []

    def partials(self) -> list[Column]:
        return [c.alias(n) for n, c in self.partial.items()]

    def merged(self) -> list[Column]:
        return [self.merge.get(n, F.sum)(n).alias(n) for n in self.partial]


def _finish(grouped: DataFrame, metric: WindowMetric) -> DataFrame:
    """Final columns from merged partial ones."""
    keys = [c for c in grouped.columns if c not in metric.partial and c not in (FIRST, LATEST)]
    last = [*([F.col(FIRST).alias(metric.distinct)] if metric.unit else []), *[c.alias(n) for n, c in metric.final.items()]]
    out = grouped.select(*keys, *last)
    return out.withColumns({c: F.round(F.col(c), d) for c, d in metric.round_to.items()}) if metric.round_to else out


def _events(events: DataFrame, metric: WindowMetric) -> DataFrame:
    inputs = dict.fromkeys([*metric.dims, *metric.inputs, *metric.unit_columns])
    window = F.window(metric.time, metric.width).alias("window")
    return events.select(window, *inputs, F.lit(1).alias(EVENT), F.col(metric.time).alias(LATEST))


def partial_rows(events: DataFrame, metric: WindowMetric, watermark: bool = True) -> DataFrame:
    """State rows: one per window, dimensions and unit."""
    if watermark:
        events = events.withWatermark(metric.time, metric.delay)
    return _events(events, metric).groupBy("window", *metric.dims, *metric.unit_columns).agg(*metric.partials())


def _merged(rows: DataFrame, metric: WindowMetric) -> DataFrame:
    """State rows put together by window and dimensions."""
    units = [F.count(metric.unit).alias(FIRST)] if metric.unit else []
    return rows.groupBy("window", *metric.dims).agg(*metric.merged(), *units)


def batch_metrics(events: DataFrame, metric: WindowMetric) -> DataFrame:
    """The same result over a finite table."""
    return _finish(_bounds(_merged(partial_rows(events, metric, watermark=False), metric)), metric)


def append_metrics(events: DataFrame, metric: WindowMetric) -> DataFrame:
    """Streaming frame for append mode."""
    return _finish(_bounds(_merged(partial_rows(events, metric), metric)), metric)


def _bounds(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest)


def with_first_seen(events: DataFrame, metric: WindowMetric) -> DataFrame:
    """Events and, for every unit that a window and its dimensions hold for the first time, one row
    more that names it in ``_first``. The state is the engine's, and goes with the watermark."""
    rows = _events(events.withWatermark(metric.time, metric.delay), metric)
    if not metric.unit:
        return rows
    place = ["window", *metric.dims]
    once = rows.filter(F.col(metric.unit).isNotNull()).select(*place, F.col(metric.unit).alias(FIRST)).dropDuplicates([*place, FIRST])
    return rows.unionByName(once, allowMissingColumns=True)


def increments(batch: DataFrame, metric: WindowMetric) -> DataFrame:
    """What a batch adds to each window it touches; combined before the shuffle."""
    units = [F.count(FIRST).alias(FIRST)] if metric.unit else []
    return _bounds(batch.groupBy("window", *metric.dims).agg(*metric.partials(), *units, F.max(LATEST).alias(LATEST)))


def add_up(rows: DataFrame, metric: WindowMetric) -> DataFrame:
    units = [F.sum(FIRST).alias(FIRST)] if metric.unit else []
    return rows.groupBy("window_start", "window_end", *metric.dims).agg(*metric.merged(), *units, F.max(LATEST).alias(LATEST))


def publish_metrics(
    events: DataFrame,
    metric: WindowMetric,
    path: str,
    checkpoint: str,
    every: str | None,
    after: Callable[[DataFrame, int], None] | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Update-mode publication: every batch adds its increments below ``path``.

    A batch is published once under the id of its stream and its own, so a repeated
    batch changes nothing. Read with :func:`read_gold`. ``after`` receives the gold rows
    of the windows the batch touched. Events of windows behind the watermark are dropped: its
    newest event time is read once at the start and then from each batch's own rows.
    """
    newest: dict[str, object] = {}

    def latest(rows: DataFrame | None):
        return None if rows is None else rows.agg(F.max(LATEST)).first()[0]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key = f"{stream_id(spark)}-{batch_id}"
        if "time" not in newest:
            newest["time"] = latest(changes.read_published(spark, path))
        if newest["time"] is not None:
            batch = batch.filter(F.col("window.end") > F.lit(newest["time"]) - F.expr(f"INTERVAL {metric.delay}"))
        changes.publish(increments(batch, metric), path, key)
        newest["time"] = max(filter(None, (newest["time"], latest(changes.read_batch(spark, path, key)))), default=None)
        if after is not None:
            after(touched_gold(spark, path, metric, key), batch_id)

    return batch_stream(with_first_seen(events, metric), handle, checkpoint, every, mode="append", name=name)


def touched_gold(spark: SparkSession, path: str, metric: WindowMetric, key: str) -> DataFrame:
    """Gold rows of the windows that batch ``key`` touched; its time range prunes the scans."""
    windows = changes.read_batch(spark, path, key).select("window_start").distinct()
    low, high = windows.agg(F.min("window_start"), F.max("window_start")).first()
    near = F.col("window_start").between(F.lit(low), F.lit(high))
    rows = changes.read_published(spark, path).filter(near).join(windows, "window_start", "left_semi")
    return _finish(add_up(rows, metric), metric)


def read_gold(spark: SparkSession, path: str, metric: WindowMetric, where: Column | None = None) -> DataFrame:
    """The metrics so far; ``where`` on the window's bounds or dimensions reaches the scans."""
    return _finish(changes.read_totals(spark, path, lambda rows: add_up(rows, metric), where), metric)


def fold_metrics(spark: SparkSession, path: str, metric: WindowMetric, at_least: int = 1) -> bool:
    """Put the batches so far into one base by day; a maintenance job, beside readers and between batches."""

    def by_day(rows: DataFrame) -> DataFrame:
        return add_up(rows, metric).withColumn("window_date", F.to_date("window_start"))

    return changes.fold(spark, path, totals=by_day, partition_by=["window_date"], at_least=at_least)


# --- the metrics of the jobs ------------------------------------------------------------
def customer_metrics() -> WindowMetric:
    return WindowMetric(
        time="event_timestamp",
        width="5 minutes",
        delay="10 minutes",
        dims=["action", "device_type"],
        inputs=["customer_id", "value"],
        partial={"n": F.count("customer_id"), "v": F.sum("value"), "nv": F.count("value")},
        final={"event_count": F.col("n"), "avg_value": F.try_divide(F.col("v"), F.col("nv")), "total_value": F.col("v")},
        round_to={"avg_value": 2, "total_value": 2},
    )


def transaction_metrics() -> WindowMetric:
    return WindowMetric(
        time="event_timestamp",
        width="5 minutes",
        delay="10 minutes",
        dims=["status", "payment_method"],
        inputs=["transaction_id", "amount"],
        partial={"n": F.count("transaction_id"), "v": F.sum("amount"), "nv": F.count("amount")},
        final={"transaction_count": F.col("n"), "total_amount": F.col("v"), "avg_amount": F.try_divide(F.col("v"), F.col("nv"))},
        round_to={"total_amount": 2, "avg_amount": 2},
    )


def event_rate(width_seconds: int = 30) -> WindowMetric:
    """Messages per topic; no distinct, so the state is one row per window and topic."""
    return WindowMetric(
        time="processing_timestamp",
        width=f"{width_seconds} seconds",
        delay="30 seconds",
        dims=["topic"],
        inputs=[],
        partial={"n": F.count(EVENT)},
        final={"event_count": F.col("n"), "events_per_second": F.col("n") / F.lit(float(width_seconds))},
        unit=None,
    )


def realtime_metrics() -> WindowMetric:
    return WindowMetric(
        time="event_timestamp",
        width="30 seconds",
        delay="30 seconds",
        dims=["action", "category"],
        inputs=["value"],
        partial={"n": F.count(EVENT), "v": F.sum(F.coalesce("value", F.lit(0.0)))},
        final={"event_count": F.col("n"), "total_value": F.col("v"), "avg_value": F.try_divide(F.col("v"), F.col("n"))},
    )


def five_second_counts() -> WindowMetric:
    return WindowMetric(
        time="processing_time",
        width="5 seconds",
        delay="30 seconds",
        dims=["event_type"],
        inputs=["value", "processing_time"],
        partial={"n": F.count(EVENT), "v": F.sum("value"), "f": F.min("processing_time")},
        final={"event_count": F.col("n"), "total_value": F.col("v"), "first_seen": F.col("f")},
        merge={"f": F.min},
    )


def minute_totals(metrics: DataFrame) -> DataFrame:
    """Per-minute totals over append-mode real-time metrics, in the same stream.

    The time of a finished window drives the second window, so both share the
    watermark.
    """
    return metrics.groupBy(F.window(F.window_time("window"), "1 minute")).agg(
        F.sum("event_count").alias("total_events_per_minute"),
        F.sum("unique_customers").alias("sum_unique_customers"),
        F.sum("total_value").alias("total_revenue"),
        F.avg("avg_value").alias("avg_event_value"),
        F.count("*").alias("metric_records"),
    )


def append_minute_totals(events: DataFrame, metric: WindowMetric | None = None) -> DataFrame:
    """Events to real-time metrics to minutes, chained in one append-mode query."""
    metric = metric or realtime_metrics()
    silver = _finish(_merged(partial_rows(events, metric), metric), metric)
    minutes = _bounds(minute_totals(silver))
    return minutes.withColumn("events_per_second", F.col("total_events_per_minute") / F.lit(60.0))
