"""Stream sinks and the registry of running queries."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from eventmill.operators.writers import expire_versions, write_version
from eventmill.session import micros

# Trigger intervals of the reference jobs (fixed values).
RAW_BRONZE, TYPED_BRONZE, SILVER, GOLD = "30 seconds", "10 seconds", "60 seconds", "60 seconds"
SILVER_METRICS, GOLD_DASHBOARD, EVENT_RATE, FAST, CONSOLE = "15 seconds", "30 seconds", "10 seconds", "2 seconds", "5 seconds"

# Partitions that a task of a batch writes side by side; rows of further ones are sorted first, as Spark does without.
OPEN_PARTITIONS, WRITERS = 4, "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def side_by_side(spark: SparkSession):
    """Partitioned writes inside don't sort a task's rows by partition, so these needn't fit its memory."""
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, OPEN_PARTITIONS)
    try:
        yield
    finally:
        spark.conf.set(WRITERS, before)


def triggered(writer: DataStreamWriter, every: str | None) -> DataStreamWriter:
    """A processing-time trigger, or everything available now and stop when ``every`` is None."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def append_stream(
    df: DataFrame, path: str, checkpoint: str, every: str | None, partition_by: list[str] = (), name: str | None = None
) -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if name:
        writer = writer.queryName(name)
    with micros(df.sparkSession):  # a stream keeps the settings it starts with
        return triggered(writer, every).start(path)


def batch_stream(
    df: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None,
    mode: str = "update",
    name: str | None = None,
) -> StreamingQuery:
    """foreachBatch; state larger than memory needs the RocksDB store of ``session.build_session``."""
    writer = df.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return triggered(writer, every).start()


def console_stream(df: DataFrame, every: str | None = CONSOLE, mode: str = "update", name: str = "debug") -> StreamingQuery:
    writer = df.writeStream.format("console").outputMode(mode).option("truncate", False).queryName(name)
    return triggered(writer, every).start()


def stream_id(spark: SparkSession) -> str:
    """Id of the stream whose batch is being handled; ``none`` outside a stream."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def append_batches(path: str, partition_by: list[str]) -> Callable[[DataFrame, int], None]:
    """Batch handler that appends once per stream and batch: a repeated batch replaces its own folders.

    Batch ids start again with every new checkpoint, so folders carry the id of the
    stream, which its checkpoint keeps. They lie below the other partitions.
    """

    def handle(df: DataFrame, batch_id: int) -> None:
        rows = df.withColumns({"stream_id": F.lit(stream_id(df.sparkSession)), "batch_id": F.lit(batch_id)})
        with micros(df.sparkSession), side_by_side(df.sparkSession):
            (
                rows.write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(*partition_by, "stream_id", "batch_id")
                .parquet(path)
            )

    return handle


def snapshot_writer(path: str, window_seconds: float, source: str) -> Callable[[DataFrame, int], None]:
    """Batch handler that keeps one row of totals over the batch's groups."""

    def handle(df: DataFrame, batch_id: int) -> None:
        row = df.agg(
            F.sum("event_count").alias("total_events"),
            F.sum("unique_customers").alias("total_customers"),
            F.sum(F.coalesce("total_value", F.lit(0.0))).alias("total_revenue"),
            F.count("*").alias("window_count"),
        ).filter("window_count > 0")
        row = row.withColumns(
            {
                "events_per_second": F.col("total_events") / F.lit(window_seconds),
                "batch_id": F.lit(batch_id),
                "data_source": F.lit(source),
                "timestamp": F.current_timestamp(),
            }
        )
        if not row.isEmpty():
            write_version(row.coalesce(1), path)
            expire_versions(df.sparkSession, path)

    return handle


class QueryRegistry:
    """Running queries by name: status, waiting and stopping."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.queries: dict[str, StreamingQuery] = {}

    def add(self, name: str, query: StreamingQuery) -> StreamingQuery:
        self.queries[name] = query
        return query

    def status(self) -> dict[str, dict]:
        out = {}
        for name, q in self.queries.items():
            progress = q.lastProgress
            out[name] = {
                "id": str(q.id),
                "active": q.isActive,
                "batch": progress["batchId"] if progress else None,
            }
        return out

    def wait(self) -> None:
        """Until all queries have ended; the first that fails raises at once."""
        while running := [q for q in self.queries.values() if q.isActive]:
            for q in self.queries.values():
                if q.exception() is not None:
                    q.awaitTermination()  # raises; other queries of the session don't matter here
            running[0].awaitTermination(1)
        for q in self.queries.values():
            q.awaitTermination()

    def stop(self) -> None:
        for q in self.queries.values():
            if q.isActive:
                q.stop()
