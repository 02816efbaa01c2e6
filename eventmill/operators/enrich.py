"""Row enrichment, filters, lookups and record diffs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventmill.functions.scalars import as_column, contains_any, lenient_timestamp, matches_any, present

Transform = Callable[[DataFrame], DataFrame]


def run_chain(df: DataFrame, *stages: list[Transform]) -> DataFrame:
    """Pre, main and post processors in order."""
    for stage in stages:
        for fn in stage:
            df = df.transform(fn)
    return df


def with_metadata(df: DataFrame, batch_id: str, version: str = "1.0.0", processed_at=None, prefix: str = "etl") -> DataFrame:
    now = F.current_timestamp() if processed_at is None else as_column(processed_at)
    return df.withColumns(
        {f"{prefix}_processed_at": now, f"{prefix}_batch_id": F.lit(batch_id), f"{prefix}_version": F.lit(version)}
    )


def fill_defaults(df: DataFrame, as_of, timestamp: str = "timestamp") -> DataFrame:
    return df.withColumns(
        {
            "event_type": F.coalesce(F.nullif(F.col("event_type"), F.lit("")), F.lit("unknown")),
            timestamp: F.coalesce(F.col(timestamp), as_column(as_of)),
        }
    )


def require(df: DataFrame, columns: list[str], allow_empty: bool = False) -> DataFrame:
    """Keep rows where every required column that exists is present."""
    kinds = {f.name: f.dataType for f in df.schema}
    tests = [F.col(c).isNotNull() if allow_empty else present(c, kinds[c]) for c in columns if c in kinds]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def stringify(df: DataFrame) -> DataFrame:
    """Every column as text, NULL as empty text, nested values as JSON."""

    def one(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        nested = isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))
        return F.coalesce(F.to_json(c) if nested else c.cast("string"), F.lit("")).alias(field.name)

    return df.select(*[one(f) for f in df.schema])


def clean_names(df: DataFrame) -> DataFrame:
    """Column names without blanks around them or surrounding quotes."""
    return df.toDF(*[c.strip().strip("'\"").strip() or c for c in df.columns])


def event_identity(event_type: Column, ts: Column) -> Column:
    """Type and epoch seconds, as the producers name events."""
    return F.concat_ws("_", event_type, F.unix_seconds(ts).cast("string"))


def content_id(df: DataFrame) -> Column:
    """Identifier that depends only on the row's content."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256)


def changed_fields(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Fields present in both snapshots whose value differs, as a map of (old, new).

    One row per record that changed. The comparison is NULL-safe.
    """
    shared = [c for c in new.columns if c in old.columns and c != key]
    pairs = [
        F.when(
            ~F.col(f"n.`{c}`").eqNullSafe(F.col(f"o.`{c}`")),
            F.struct(
                F.lit(c).alias("key"),
                F.struct(
                    F.col(f"o.`{c}`").cast("string").alias("old_value"),
                    F.col(f"n.`{c}`").cast("string").alias("new_value"),
                ).alias("value"),
            ),
        )
        for c in shared
    ]
    joined = new.alias("n").join(old.alias("o"), F.col(f"n.{key}") == F.col(f"o.{key}"))
    changed = joined.select(F.col(f"n.{key}").alias(key), F.array_compact(F.array(*pairs)).alias("_pairs"))
    return changed.filter(F.size("_pairs") > 0).select(
        key,
        F.map_from_entries("_pairs").alias("changes"),
        F.transform("_pairs", lambda p: p["key"]).alias("updated_fields"),
    )


def search(df: DataFrame, columns: list[str], term: str | None = None, pattern: str | None = None) -> DataFrame:
    if term:
        df = df.filter(contains_any(columns, term))
    if pattern:
        df = df.filter(matches_any(columns, pattern))
    return df


def equal_to(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters; an argument left out (None) does not filter."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == as_column(value))
    return df


def audit_filter(
    logs: DataFrame, user_id=None, action: str | None = None, resource: str | None = None, start=None, end=None
) -> DataFrame:
    """``logs``: id, timestamp, user_id, action, resource. The action is matched in upper case."""
    logs = equal_to(logs, user_id=user_id, action=action.upper() if action else None, resource=resource)
    if start is not None:
        logs = logs.filter(F.col("timestamp") >= as_column(start))
    if end is not None:
        logs = logs.filter(F.col("timestamp") <= as_column(end))
    return logs


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """First match of a key."""
    return df.filter(F.col(key) == as_column(value)).limit(1)


def day_of(column: Column) -> Column:
    """Date of epoch milliseconds or of text with or without an offset."""
    return F.to_date(lenient_timestamp(column))


# Column choices per domain (fixed values).
_DOMAIN_PARTITIONS = {"incident": "PrimaryFileName", "traffic": "region", "vpc": "event_type"}
_DOMAIN_CLUSTERING = {
    "incident": ["PrimaryFileName", "IncidentId"],
    "traffic": ["PassageTime", "DeviceIndex"],
    "vpc": ["event_type"],
}


def partition_columns(table: str, columns: list[str]) -> list[str]:
    """Partition columns of a table by what it contains."""
    if "InsertionTime" in columns or "timestamp" in columns:
        return ["year", "month"]
    if "date" in columns:
        return ["date"]
    for domain, column in _DOMAIN_PARTITIONS.items():
        if domain in table.lower() and column in columns:
            return [column]
    return []


def clustering_columns(table: str) -> list[str]:
    for domain, columns in _DOMAIN_CLUSTERING.items():
        if domain in table.lower():
            return columns
    return []


def layer_of(table: str) -> str:
    return "silver" if "silver" in table.lower() else "bronze"


def add_partition_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Year and month from the insertion time or timestamp when a table is partitioned by them."""
    if "year" not in columns or {"year", "month"} <= set(df.columns):
        return df
    source = F.timestamp_millis("InsertionTime") if "InsertionTime" in df.columns else lenient_timestamp(F.col("timestamp"))
    return df.withColumns({"year": F.year(source), "month": F.month(source)})


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
