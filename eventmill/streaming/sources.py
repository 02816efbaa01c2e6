"""Stream sources with one envelope contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventmill.schemas import ENVELOPE, EVENT_TOPICS
from eventmill.sources.files import is_file

# Rate caps and consumer options of the reference jobs (fixed values).
RECORDS_PER_TRIGGER = 1_000
FAST_RECORDS_PER_TRIGGER = 10_000
FAST_OPTIONS = {
    "kafka.session.timeout.ms": "30000",
    "kafka.request.timeout.ms": "40000",
}


def kafka_options(servers: str, topics: list[str], per_trigger: int = RECORDS_PER_TRIGGER, **extra: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": "latest",
        "maxOffsetsPerTrigger": str(per_trigger),
        **extra,
    }


def table_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Stream over a layer table; the file cap is the rate cap of a file source.

    A table that is one file is picked by name from its folder.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if is_file(spark, path):
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def event_stream(
    spark: SparkSession,
    kind: str,
    path: str | None = None,
    topics: list[str] | None = None,
    servers: str | None = None,
    files_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """Envelope stream from ``kafka``, ``files`` (same columns) or ``rate``."""
    if kind == "kafka":
        return spark.readStream.format("kafka").options(**kafka_options(servers, topics or [], **options)).load()
    if kind == "files":
        rows = table_stream(spark, path, ENVELOPE, files_per_trigger)
        return rows.filter(F.col("topic").isin(topics)) if topics else rows
    if kind == "rate":
        ticks = spark.readStream.format("rate").options(**options).load()
        return ticks.select(
            F.lit(None).cast("binary").alias("key"),
            F.to_json(F.struct("value")).cast("binary").alias("value"),
            F.lit((topics or ["rate"])[0]).alias("topic"),
            F.lit(0).alias("partition"),
            F.col("value").alias("offset"),
            "timestamp",
        )
    raise ValueError(f"unsupported stream source {kind}")


def topic_streams(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> dict[str, DataFrame]:
    """One stream per topic."""
    return {t: event_stream(spark, "files", path, [t], files_per_trigger=files_per_trigger) for t in EVENT_TOPICS.values()}
