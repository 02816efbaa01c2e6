"""Contract-driven rows: epoch conversion, partition columns, required fields, SQL aggregations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventmill.functions.scalars import as_column, epoch_ms, lenient_timestamp
from eventmill.operators.parse import parse_payload
from eventmill.schemas import contract_schema


def _fields(contract: dict) -> list[dict]:
    return contract.get("schema", {}).get("fields", [])


def to_epoch_ms(df: DataFrame, contract: dict) -> DataFrame:
    """Fields marked ``ms`` from text to epoch milliseconds; NULL and unreadable text give NULL."""
    wanted = [f.get("name") or f.get("field") for f in _fields(contract) if f.get("ms") is True]
    kinds = {f.name: f.dataType for f in df.schema}
    changes = {
        n: epoch_ms(lenient_timestamp(F.col(n))) for n in wanted if n in kinds and isinstance(kinds[n], T.StringType)
    }
    return df.withColumns(changes) if changes else df


def with_partition_columns(df: DataFrame, as_of) -> DataFrame:
    """Insertion time (default ``as_of``) and the calendar columns derived from it."""
    now = epoch_ms(as_column(as_of).cast("timestamp"))
    inserted = F.coalesce("InsertionTime", now) if "InsertionTime" in df.columns else now
    df = df.withColumn("InsertionTime", inserted)
    at = F.timestamp_millis("InsertionTime")
    return df.withColumns({"year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at)})


def keep_valid(df: DataFrame, contract: dict, reject_empty: bool = False) -> DataFrame:
    """Drop rows lacking a required field, in one predicate."""
    rules = contract.get("quality_rules")
    required = rules.get("required", []) if isinstance(rules, dict) else []
    tests = []
    for name in required:
        if name in df.columns:
            tests.append(F.col(name).isNotNull())
            if reject_empty:
                tests.append(F.col(name).cast("string") != "")
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def apply_contract(df: DataFrame, contract: dict, as_of=None, reject_empty: bool = False) -> DataFrame:
    """Parse (when the rows are message values), convert, partition, validate. Works on streams too."""
    if df.columns == ["value"]:
        df = parse_payload(df.select(F.col("value").cast("string")), "value", contract_schema(contract, raw=True), [])
        df = df.drop("_corrupt_record")
    now = F.current_timestamp() if as_of is None else as_of
    return keep_valid(with_partition_columns(to_epoch_ms(df, contract), now), contract, reject_empty)


_PIECES = re.compile(r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`)")


def bind_source(sql: str) -> str:
    """Replace the table name ``src`` by a parameter marker, outside quoted text."""
    parts = _PIECES.split(sql.replace("{", "{{").replace("}", "}}"))
    return "".join(p if i % 2 else re.sub(r"\bsrc\b(?!\s*\.)", "{src}", p) for i, p in enumerate(parts))


def run_aggregation(src: DataFrame, sql: str) -> DataFrame:
    """A contract's SQL over its bronze table, bound per call: no shared view to clash on.

    The parameter keeps ``src`` as alias so that qualified columns resolve.
    """
    return src.sparkSession.sql(bind_source(sql), src=src)


def run_aggregations(src: DataFrame, table: str, contract: dict, write) -> list[dict]:
    """Run every aggregation and hand its result to ``write(target, df)``; a failing one is reported, not raised."""
    results = []
    for spec in contract.get("aggregations", []):
        name = spec.get("name") or "agg"
        sql = spec.get("sql") or spec.get("query")
        if not sql:
            continue
        target = spec.get("target_table") or f"{table}_{name}"
        try:
            write(target, run_aggregation(src, sql))
            results.append({"name": name, "target": target, "status": "success"})
        except PySparkException as e:
            results.append({"name": name, "target": target, "status": "error", "error": str(e).splitlines()[0]})
    return results
