"""Data quality: profiles, scores, rules and schema checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Thresholds and score factors (fixed values).
MAX_NULL_SHARE = 0.95
MAX_DUPLICATE_SHARE = 0.10
MIN_RECORDS = 1
WARN_NULL_PERCENT = 50
FACTOR_TOO_FEW, FACTOR_NULLS, FACTOR_DUPLICATES, FACTOR_RULES = 0.5, 0.9, 0.8, 0.85
MIN_SCORE = 0.7
CRITICAL_SCORE = 0.5
LARGE_BATCH = 100_000


@dataclass(frozen=True)
class Rule:
    """A named rule; ``violation`` is true for a row that breaks it."""

    name: str
    violation: Column


def _groupable(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    nested = isinstance(field.dataType, (T.MapType, T.StructType, T.ArrayType))
    return (F.to_json(column) if nested else column).alias(field.name)


def profile(df: DataFrame, rules: list[Rule] = (), duplicates: bool = True) -> DataFrame:
    """One row: total, distinct rows, NULLs per column and violations per rule.

    Equal rows are first combined into one row with a count. That gives the exact
    number of duplicates, collapses hot copies before the shuffle, and the NULL
    and rule counts ride on the same pass. Without ``duplicates`` nothing is
    shuffled but one partial row per task.
    """
    broken = [r.violation.cast("boolean").alias(f"_rule{i}") for i, r in enumerate(rules)]
    flat = df.select(*[_groupable(f) for f in df.schema], *broken)
    if duplicates:
        flat = flat.groupBy(*[f"`{c}`" for c in flat.columns]).agg(F.count("*").alias("_n"))
    else:
        flat = flat.withColumn("_n", F.lit(1).cast("bigint"))

    def counted(flag: Column) -> Column:
        return F.coalesce(F.sum(F.when(flag, F.col("_n"))), F.lit(0))

    aggregates = [
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_records"),
        *[counted(F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in enumerate(df.columns)],
        *[counted(F.col(f"_rule{i}")).alias(f"broken_{i}") for i in range(len(rules))],
    ]
    if duplicates:
        aggregates.append(F.count("*").alias("distinct_records"))
    return flat.agg(*aggregates)


def column_nulls(df: DataFrame) -> DataFrame:
    """NULL count and percentage per column, as rows."""
    row = profile(df, duplicates=False)
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"null_{i}").alias("null_count")) for i, c in enumerate(df.columns)]
    return row.select("total_records", F.explode(F.array(*entries)).alias("x")).select(
        "x.column", "x.null_count", _percent(F.col("x.null_count"), F.col("total_records")).alias("null_percentage")
    )


def _percent(part: Column, total: Column) -> Column:
    return F.try_divide(part.cast("double") * 100, total.cast("double"))


def _product(factors: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, factors, F.lit(1.0))


def quality_report(df: DataFrame, table_name: str, rules: list[Rule] = (), duplicates: bool = True) -> DataFrame:
    """Score, issues and warnings of a table in one row, from one pass."""
    row = profile(df, rules, duplicates)
    total = F.col("total_records")
    filled = total > 0
    factors: list[Column] = [F.when(filled & (total < MIN_RECORDS), FACTOR_TOO_FEW).otherwise(1.0)]
    issues: list[Column] = [F.when(filled & (total < MIN_RECORDS), F.lit("too few records"))]
    warnings: list[Column] = [F.when(~filled, F.lit("empty dataset"))]
    for i, name in enumerate(df.columns):
        share = _percent(F.col(f"null_{i}"), total)
        high = share > MAX_NULL_SHARE * 100
        factors.append(F.when(high, FACTOR_NULLS).otherwise(1.0))
        issues.append(F.when(high, F.lit(f"high null percentage: {name}")))
        warnings.append(F.when(~high & (share > WARN_NULL_PERCENT), F.lit(f"moderate null percentage: {name}")))
    if duplicates:
        row = row.withColumn("duplicate_count", total - F.col("distinct_records"))
        row = row.withColumn("duplicate_percentage", _percent(F.col("duplicate_count"), total))
        many = F.coalesce(F.col("duplicate_percentage") > MAX_DUPLICATE_SHARE * 100, F.lit(False))
        factors.append(F.when(many, FACTOR_DUPLICATES).otherwise(1.0))
        issues.append(F.when(many, F.lit("high duplicate percentage")))
    if rules:
        failed = [F.col(f"broken_{i}") > 0 for i in range(len(rules))]
        factors.append(F.when(reduce(lambda a, b: a | b, failed), FACTOR_RULES).otherwise(1.0))
        issues += [F.when(f, F.lit(f"rule failed: {r.name}")) for f, r in zip(failed, rules, strict=True)]
    report = row.withColumns(
        {
            "quality_score": F.coalesce(_product(factors), F.lit(1.0)),
            "issues": F.array_compact(F.array(*issues)),
            "warnings": F.array_compact(F.array(*warnings)),
        }
    ).withColumn("passed", (F.size("issues") == 0) & (F.col("quality_score") >= MIN_SCORE))
    extra = ["duplicate_count", "duplicate_percentage"] if duplicates else []
    return report.select(
        F.lit(table_name).alias("table_name"),
        "total_records",
        F.lit(len(df.columns)).alias("total_columns"),
        *extra,
        "quality_score",
        "issues",
        "warnings",
        "passed",
    )


def schema_issues(actual: T.StructType, expected: T.StructType) -> list[str]:
    """Differences between two schemas: count, missing, type, nullability, extra."""
    have = {f.name: f for f in actual}
    want = {f.name: f for f in expected}
    issues = []
    if len(have) != len(want):
        issues.append(f"field count: expected {len(want)}, got {len(have)}")
    for name, field in want.items():
        other = have.get(name)
        if other is None:
            issues.append(f"missing field: {name}")
            continue
        if other.dataType != field.dataType:
            issues.append(f"type of {name}: expected {field.dataType.simpleString()}, got {other.dataType.simpleString()}")
        if other.nullable and not field.nullable:
            issues.append(f"nullability of {name}: expected not null")
    issues += [f"unexpected field: {name}" for name in have if name not in want]
    return issues


def validate_batch(
    df: DataFrame,
    table_name: str,
    expected: T.StructType | None = None,
    rules: list[Rule] = (),
    duplicates: bool = False,
) -> DataFrame:
    """Quality report with the schema verdict and recommendations.

    ``duplicates`` adds their share, at the price of a shuffle of whole rows.
    """
    differences = schema_issues(df.schema, expected) if expected is not None else []
    advice = [
        F.lit("fix the schema before processing" if differences else None).cast("string"),
        F.when(~F.col("passed") & (F.col("quality_score") < CRITICAL_SCORE), "quality critically low: clean the data").when(
            ~F.col("passed"), "address the quality issues"
        ),
        F.when(F.col("total_records") > LARGE_BATCH, "partition large datasets"),
    ]
    return quality_report(df, table_name, rules, duplicates).withColumns(
        {
            "schema_issues": F.array(*[F.lit(d) for d in differences]).cast("array<string>"),
            "overall_passed": F.col("passed") & F.lit(not differences),
            "recommendations": F.array_compact(F.array(*advice)),
        }
    )


# Required columns per domain (fixed values).
REQUIRED = {"incident": ("PrimaryFileName", "IncidentId"), "traffic": (), "vpc": ()}


def key_nulls(df: DataFrame, required: list[str]) -> DataFrame:
    """NULLs in the required columns that exist, and whether the batch may be written."""
    present = [c for c in required if c in df.columns]
    row = df.agg(F.count("*").alias("total_records"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in present])
    good = reduce(lambda a, b: a & b, [F.col(f"{c}_nulls") == 0 for c in present], F.col("total_records") > 0)
    return row.withColumn("valid", good)
