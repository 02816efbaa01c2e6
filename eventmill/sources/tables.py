"""Layer tables: paths and guarded, pruned scans."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventmill.functions.scalars import ago, as_column
from eventmill.sources.files import child_dirs, exists, has_data

LAYERS = ("bronze", "silver", "gold")


class Lake:
    """Layer folders below one base path."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")

    def path(self, layer: str, table: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer}")
        return f"{self.base}/{layer}/{table}"

    def checkpoint(self, name: str) -> str:
        return f"{self.base}/_checkpoints/{name}"

    def read(self, layer: str, table: str, schema: T.StructType | None = None) -> DataFrame:
        return read_table(self.spark, self.path(layer, table), schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_if_present(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The table, or None when it is missing or has no rows."""
    if not has_data(spark, path):
        return None
    try:
        df = read_table(spark, path, schema)
    except AnalysisException:
        return None
    return None if df.isEmpty() else df


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or a typed empty frame."""
    if has_data(spark, path):
        return read_table(spark, path, schema)
    return spark.createDataFrame([], schema)


def read_time_range(df: DataFrame, start, end) -> DataFrame:
    """Inclusive range on the event time, else on the processing time."""
    for name in ("event_timestamp", "event_ts", "processing_timestamp"):
        if name in df.columns:
            return df.filter((F.col(name) >= as_column(start)) & (F.col(name) <= as_column(end)))
    raise ValueError("no time column to filter on")


def read_gold_window(df: DataFrame, start, end) -> DataFrame:
    return df.filter((F.col("window_start") >= as_column(start)) & (F.col("window_end") <= as_column(end)))


def date_folders(spark: SparkSession, base: str, table: str, start: date, end: date) -> list[str]:
    """Existing ``<base>/<day>/<table>`` folders, with padded and unpadded day names."""
    present = set(child_dirs(spark, base))
    paths = []
    for n in range((end - start).days + 1):
        day = start + timedelta(days=n)
        names = (day.isoformat(), f"{day.year}-{day.month}-{day.day}")
        found = next((x for x in names if x in present and has_data(spark, f"{base}/{x}/{table}")), None)
        if found:
            paths.append(f"{base}/{found}/{table}")
    return paths


def read_date_folders(spark: SparkSession, base: str, table: str, start: date, end: date) -> DataFrame | None:
    """All days of a range as one scan; columns a day lacks are NULL."""
    paths = date_folders(spark, base, table, start, end)
    if not paths:
        return None
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def read_bronze(
    df: DataFrame, event_type: str | None = None, day: str | None = None, limit: int | None = None
) -> DataFrame:
    """Bronze rows by partition; plain comparisons, so only matching folders are listed."""
    if event_type is not None:
        df = df.filter(F.col("event_type") == event_type)
    if day is not None:
        df = df.filter(F.col("partition_date") == F.lit(day).cast("date"))
    return df if limit is None else df.limit(limit)


def read_json_folders(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines below ``event_type=/date=`` folders; an unreadable line keeps its text aside."""
    with_corrupt = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    return (
        spark.read.schema(with_corrupt)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """XML rows; malformed ones are dropped."""
    return spark.read.format("xml").schema(schema).option("rowTag", row_tag).option("mode", "DROPMALFORMED").load(path)


def records_frame(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Record files with a declared schema; how they are split is left to the scan and AQE."""
    return spark.read.schema(schema).json(path)


def since(df: DataFrame, column: str, as_of, **parts) -> DataFrame:
    """Rows of the last minutes, hours or days before ``as_of``."""
    return df.filter(F.col(column) >= ago(as_of, **parts))


def table_counts(lake: Lake, layer: str, schemas: dict[str, T.StructType]) -> DataFrame:
    """Availability and row count per table, missing ones included."""
    spark = lake.spark
    out = None
    for name, schema in schemas.items():
        path = lake.path(layer, name)
        rows = read_or_empty(spark, path, schema).agg(F.count("*").alias("rows"))
        line = rows.select(F.lit(name).alias("table_name"), F.lit(exists(spark, path)).alias("available"), "rows")
        out = line if out is None else out.unionByName(line)
    return out
