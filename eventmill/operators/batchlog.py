"""Processing statistics over a batch log, and rates over metric samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventmill.functions.scalars import ago, as_column, percent, ratio
from eventmill.operators.ordering import running_totals, trailing_rows, trailing_seconds


def _seconds() -> Column:
    """Processing time; NULL while a batch has not ended."""
    return (F.unix_micros("processing_end") - F.unix_micros("processing_start")) / F.lit(1_000_000.0)


def _summary(log: DataFrame, *keys: str) -> DataFrame:
    return log.groupBy(*keys).agg(
        F.count("*").alias("total_batches"),
        F.count("processing_end").alias("successful_batches"),
        F.sum("record_count").alias("total_records"),
        F.coalesce(F.sum(_seconds()), F.lit(0.0)).alias("total_seconds"),
    ).withColumns(
        {
            "avg_records_per_batch": ratio(F.col("total_records"), F.col("total_batches")),
            "avg_seconds": F.coalesce(ratio(F.col("total_seconds"), F.col("successful_batches")), F.lit(0.0)),
            "records_per_second": ratio(F.col("total_records"), F.col("total_seconds")),
        }
    )


def processing_summary(log: DataFrame, as_of=None, minutes: int | None = None, by_table: bool = False) -> DataFrame:
    if minutes is not None:
        log = log.filter(F.col("processing_start") >= ago(as_of, mins=minutes))
    return _summary(log, "table_name") if by_table else _summary(log)


def metric_state(samples: DataFrame, prefix: str | None = None) -> DataFrame:
    """Current, average and extremes per metric name."""
    if prefix:
        samples = samples.filter(F.col("metric_name").startswith(prefix))
    return samples.groupBy("metric_name").agg(
        F.max_by("value", F.struct("event_ts", "sample_id")).alias("current"),
        F.avg("value").alias("average"),
        F.max("value").alias("max"),
        F.min("value").alias("min"),
        F.count("*").alias("samples"),
    )


def batch_statistics(log: DataFrame) -> DataFrame:
    """Totals and averages of the finished batches, and the number that failed."""
    done = F.col("processing_end").isNotNull()
    return log.agg(
        F.count_if(done).alias("batches_processed"),
        F.count_if(~done).alias("batches_failed"),
        F.sum(F.when(done, F.col("record_count"))).alias("items_processed"),
        F.avg(F.when(done, F.col("record_count"))).alias("average_batch_size"),
        F.avg(_seconds()).alias("average_processing_seconds"),
    )


def success_rates(log: DataFrame) -> DataFrame:
    """Records received and lost, success and error rate, mean processing milliseconds."""
    lost = F.col("processing_end").isNull()
    return log.agg(
        F.sum("record_count").alias("received"),
        F.coalesce(F.sum(F.when(lost, F.col("record_count"))), F.lit(0)).alias("errors"),
        (F.avg(_seconds()) * 1000).alias("avg_processing_ms"),
    ).withColumns(
        {
            "success_rate_percent": F.coalesce(percent(F.col("received") - F.col("errors"), F.col("received")), F.lit(0.0)),
            "error_rate_percent": F.coalesce(percent(F.col("errors"), F.col("received")), F.lit(0.0)),
        }
    )


def running_batch_averages(log: DataFrame) -> DataFrame:
    """Average batch size and time per table after each batch."""
    done = log.filter("processing_end is not null")
    totals = {"_n": F.lit(1), "_r": F.col("record_count"), "_s": _seconds()}
    run = running_totals(done, ["table_name"], [F.col("processing_start"), F.col("batch_id")], totals)
    return run.select(
        "batch_id",
        "table_name",
        F.col("_n").alias("batches_processed"),
        ratio(F.col("_r"), F.col("_n")).alias("average_batch_size"),
        ratio(F.col("_s"), F.col("_n")).alias("average_processing_seconds"),
    )


def sample_rate(samples: DataFrame, rows: int = 12) -> DataFrame:
    """Value difference over time difference of the last samples of a metric, not below zero."""

    def build(frame):
        first_value, last_value = F.first("value").over(frame), F.last("value").over(frame)
        first_ts, last_ts = F.first("event_ts").over(frame), F.last("event_ts").over(frame)
        seconds = (F.unix_micros(last_ts) - F.unix_micros(first_ts)) / F.lit(1_000_000.0)
        rate = ratio(last_value - first_value, seconds)
        return {"rate": F.when(rate.isNotNull(), F.greatest(rate, F.lit(0.0)))}

    return trailing_rows(samples, ["metric_name"], [F.col("event_ts"), F.col("sample_id")], rows, build)


def trailing_mean(samples: DataFrame, rows: int = 100) -> DataFrame:
    """Mean of the last timers of a metric."""

    def build(frame):
        return {"trailing_mean": F.avg("value").over(frame), "measurements": F.count("*").over(frame)}

    return trailing_rows(samples, ["metric_name"], [F.col("event_ts"), F.col("sample_id")], rows, build)


def trailing_rate(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Events of the last minute over the span they cover, at every second that has events."""
    per_second = events.groupBy(F.unix_seconds("event_ts").alias("second")).agg(F.count("*").alias("n"))

    def build(frame):
        span = F.greatest(F.lit(1), F.col("second") - F.min("second").over(frame))
        total = F.sum("n").over(frame)
        return {"recent_events": total, "events_per_second": ratio(total, span)}

    return trailing_seconds(per_second, [], "second", seconds, build).drop("n")


def current_rate(events: DataFrame, as_of, seconds: int = 5, idle_seconds: int = 2) -> DataFrame:
    """Rate over the last seconds, zero when nothing arrived for ``idle_seconds``."""
    now = as_column(as_of)
    recent = events.filter((F.col("event_ts") >= ago(now, secs=seconds)) & (F.col("event_ts") <= now))
    idle = F.max("event_ts") < ago(now, secs=idle_seconds)
    rate = F.count("*") / F.lit(float(seconds))
    return recent.agg(
        F.count("*").alias("recent_events"),
        F.when(idle, 0.0).otherwise(rate).alias("events_per_second"),
    )


def newest_events(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("event_ts"), F.desc("event_id")).limit(n)


def newest_per_group(events: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The last n events per key.

    The rank filter becomes a limit inside every task before the shuffle, so a
    hot key sends at most n rows per task.
    """
    newest_first = Window.partitionBy(*keys).orderBy(F.desc("event_ts"), F.desc("event_id"))
    return events.withColumn("rank", F.row_number().over(newest_first)).filter(F.col("rank") <= n)
