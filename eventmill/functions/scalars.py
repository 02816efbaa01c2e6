"""Column expressions shared by the operators. All run inside codegen."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# Column-name fragments that mark a value as sensitive (fixed values).
SENSITIVE_WORDS = (
    "password", "token", "secret", "key", "auth", "authorization",
    "cookie", "session", "ssn", "social_security", "credit_card",
    "api_key", "access_token", "refresh_token", "jwt", "bearer",
)


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def latest(df: DataFrame, column: str) -> Column:
    """The newest value of a column as a scalar subquery: no driver round trip."""
    found = df.agg(F.max(column)).scalar()
    found.newest_of = df, column
    return found


def shifted(as_of, change: Callable[[Column], Column]) -> Column:
    """``change(as_of)``. The newest value of a column is changed inside its subquery.

    A comparison with a bare subquery reaches the scan, one with an expression over a
    subquery doesn't.
    """
    source = vars(as_of).get("newest_of") if isinstance(as_of, Column) else None
    if source is None:
        return change(as_column(as_of))
    df, column = source
    return df.agg(change(F.max(column))).scalar()


def ago(as_of, **parts) -> Column:
    """``as_of`` minus days/hours/mins/secs."""
    args = {k: F.lit(v) for k, v in parts.items()}
    return shifted(as_of, lambda now: now - F.make_dt_interval(**args))


def ratio(numerator, denominator) -> Column:
    """Division that yields NULL for a zero divisor."""
    return F.try_divide(as_column(numerator).cast("double"), as_column(denominator).cast("double"))


def percent(numerator, denominator) -> Column:
    return ratio(numerator, denominator) * 100


def lenient_timestamp(column: Column) -> Column:
    """ISO text with ``T`` or a space, with or without offset, or epoch milliseconds as digits."""
    text = column.cast("string")
    millis = F.when(text.rlike(r"^-?\d{9,}$"), F.timestamp_millis(text.try_cast("bigint")))
    return F.coalesce(millis, F.try_to_timestamp(text))


def epoch_ms(column: Column) -> Column:
    return F.unix_millis(column)


def iso_utc(column: Column) -> Column:
    return F.date_format(column, ISO_UTC)


def range_label(column: Column, step: int) -> Column:
    """``lo - hi`` label of the step-wide bucket a value falls in."""
    low = (F.floor(column / step) * step).cast("bigint")
    return F.concat(low.cast("string"), F.lit(" - "), (low + step).cast("string"))


def millions_label(count: Column) -> Column:
    return F.format_string("%.3fM", count / 1e6)


def millions_range_label(count: Column) -> Column:
    """Two-decimal floor in millions up to that floor plus 0.005."""
    low = F.floor(count / 1e6 * 100).cast("double") / 100
    return F.concat(F.format_string("%.2fM", low), F.lit(" - "), F.format_string("%.3fM", low + 0.005))


def short_number(column: Column) -> Column:
    """1.2M / 3.4K / plain with thousands separators."""
    return (
        F.when(column >= 1_000_000, F.format_string("%.1fM", column / 1e6))
        .when(column >= 1_000, F.format_string("%.1fK", column / 1e3))
        .otherwise(F.format_number(column, 0))
    )


def mask(column: Column, mask_char: str = "*", show_last: int = 4) -> Column:
    """Hide all but the last characters; a short value is hidden whole."""
    size = F.length(column)
    hidden = F.repeat(F.lit(mask_char), size - show_last)
    return F.when(size <= show_last, F.repeat(F.lit(mask_char), size)).otherwise(
        F.concat(hidden, F.right(column, F.lit(show_last)))
    )


def _hide(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.when(F.length(column) > 4, F.concat(F.lit("***"), F.right(column, F.lit(4)))).otherwise("***")
    return F.lit("***")


def _scrub(column: Column, name: str, kind: T.DataType, words: tuple[str, ...]) -> Column:
    sensitive = any(w in name.lower() for w in words)
    if isinstance(kind, T.StructType):
        inner = [_scrub(column.getField(f.name), f.name, f.dataType, words).alias(f.name) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*inner))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _scrub(x, name, kind.elementType, words))
    if isinstance(kind, T.MapType) and not sensitive:
        return _scrub_map(column, kind, words)
    return _hide(column, kind) if sensitive else column


def _scrub_map(column: Column, kind: T.MapType, words: tuple[str, ...]) -> Column:
    """Map values by their keys: text is masked, other values under a sensitive key become NULL."""

    def value(k: Column, v: Column) -> Column:
        text = isinstance(kind.valueType, T.StringType)
        hidden = _hide(v, kind.valueType) if text else F.lit(None).cast(kind.valueType)
        inner = _scrub(v, "", kind.valueType, words)
        name = F.lower(k.cast("string"))
        sensitive = reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in words], F.lit(False))
        return F.when(sensitive & v.isNotNull(), hidden).when(~sensitive, inner)

    return F.transform_values(column, value)


def scrub_sensitive(df: DataFrame, words: tuple[str, ...] = SENSITIVE_WORDS) -> DataFrame:
    """Mask every column, at any depth, whose name (in a map, whose key) contains a sensitive word."""
    return df.select(*[_scrub(F.col(f"`{f.name}`"), f.name, f.dataType, words).alias(f.name) for f in df.schema])


def contains_any(columns: list[str], term: str) -> Column:
    """Case-insensitive substring search over several columns."""
    needle = F.lit(term.lower())
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), needle) for c in columns])


def matches_any(columns: list[str], pattern: str) -> Column:
    """Case-insensitive regular-expression search over several columns."""
    return reduce(lambda a, b: a | b, [F.col(c).rlike(f"(?i){pattern}") for c in columns])


def present(name: str, kind: T.DataType | None = None) -> Column:
    """Not null and, for text, not empty."""
    column = F.col(name)
    if kind is None or isinstance(kind, T.StringType):
        return column.isNotNull() & (column.cast("string") != "")
    return column.isNotNull()
