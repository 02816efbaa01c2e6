"""Traffic mart and KPI family.

The KPIs are unweighted averages of window averages over the mart, without any
cap on the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.functions.scalars import (
    epoch_ms,
    millions_label,
    millions_range_label,
    range_label,
)
from eventmill.operators.ordering import top_k

SPEED_STEP = 5


def windowed_traffic(passages: DataFrame, width: str = "1 hour") -> DataFrame:
    """Speed, vehicle and violation counts per window, class, place and device."""
    w = F.window("passage_time", width)
    dims = ["VehicleClass", "Location0", "DeviceIndex", "Region", "SpeedLimit"]
    return passages.groupBy(w, *dims).agg(
        F.avg("speed").alias("avg_speed"),
        F.count("*").alias("vehicle_count"),
        F.count_if(F.col("speed") > F.col("SpeedLimit")).alias("violation_count"),
    ).select(
        epoch_ms(F.col("window.start")).alias("window_start"),
        epoch_ms(F.col("window.end")).alias("window_end"),
        F.date_format("window.start", "yyyy-MM-dd").alias("processing_date"),
        *dims,
        "avg_speed",
        "vehicle_count",
        "violation_count",
    )


def select_traffic(
    mart: DataFrame, start: str = "ALL", end: str = "ALL", region: str = "ALL", vehicle_class: str = "ALL"
) -> DataFrame:
    """Day range, region and class; ALL switches a filter off. Days are ISO text, so they compare as text."""
    if start.upper() != "ALL" and end.upper() != "ALL":
        if end < start:
            raise ValueError("end before start")
        mart = mart.filter(F.col("processing_date").between(start, end))
    if region.upper() != "ALL":
        mart = mart.filter(F.col("Region") == region)
    if vehicle_class.upper() != "ALL":
        mart = mart.filter(F.col("VehicleClass") == vehicle_class)
    return mart


def _start() -> Column:
    return F.timestamp_millis("window_start")


def _day() -> Column:
    return F.to_date("processing_date")


def _hour() -> Column:
    return F.hour(_start()).alias("hour")


def _speed(column: str = "avg_speed") -> Column:
    return F.avg(column).alias("avg_speed")


def _range(column: str = "avg_speed") -> Column:
    return range_label(F.col(column), SPEED_STEP)


def _all_hours(by_hour: DataFrame) -> DataFrame:
    hours = by_hour.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(by_hour, "hour", "left").na.fill(0)


def speed_by_hour(mart: DataFrame) -> DataFrame:
    return _all_hours(mart.groupBy(_hour()).agg(_speed()))


def speed_by_month(mart: DataFrame) -> DataFrame:
    return mart.groupBy(F.year(_day()).alias("year"), F.date_format(_day(), "MMMM").alias("month")).agg(_speed())


def speed_by_class(mart: DataFrame) -> DataFrame:
    return mart.groupBy("VehicleClass").agg(_speed()).withColumn("speed_range", _range())


def vehicles_by_hour(mart: DataFrame) -> DataFrame:
    return _all_hours(mart.groupBy(_hour()).agg(F.sum("vehicle_count").alias("vehicle_count")))


def vehicles_by_month(mart: DataFrame) -> DataFrame:
    return mart.groupBy(F.year(_day()).alias("year"), F.date_format(_day(), "MMMM").alias("month")).agg(
        F.sum("vehicle_count").alias("vehicle_count")
    )


def _class() -> Column:
    return F.lower("VehicleClass").alias("vehicle_class")


def violations_by_class(mart: DataFrame) -> DataFrame:
    return mart.groupBy(_class()).agg(F.sum("violation_count").alias("case_count"))


def violations_by_hour_class(mart: DataFrame) -> DataFrame:
    return mart.groupBy(F.format_string("%02d", F.hour(_start())).alias("hour"), _class()).agg(
        F.sum("violation_count").alias("case_count")
    )


def violations_by_month_class(mart: DataFrame) -> DataFrame:
    """Month names, years merged."""
    return mart.groupBy(F.date_format(_start(), "MMMM").alias("month"), _class()).agg(
        F.sum("violation_count").alias("case_count")
    )


def overall_speed(mart: DataFrame) -> DataFrame:
    return mart.agg(_speed()).withColumn("speed_range", _range())


def speed_by_location(mart: DataFrame) -> DataFrame:
    return mart.groupBy("Location0").agg(_speed()).withColumn("speed_range", _range())


def peak_hour(mart: DataFrame) -> DataFrame:
    by_hour = mart.groupBy(_hour()).agg(F.sum("vehicle_count").alias("vehicle_count"))
    return top_k(by_hour, [F.desc("vehicle_count"), F.asc("hour")], 1)


def _by_location(mart: DataFrame, column: str) -> DataFrame:
    return mart.groupBy("Location0").agg(F.sum(column).alias(column))


def top_violation_locations(mart: DataFrame, k: int = 5) -> DataFrame:
    return top_k(_by_location(mart, "violation_count"), [F.desc("violation_count"), F.asc("Location0")], k)


def top_volume_locations(mart: DataFrame, k: int = 5) -> DataFrame:
    top = top_k(_by_location(mart, "vehicle_count"), [F.desc("vehicle_count"), F.asc("Location0")], k)
    return top.withColumn("count_range", millions_range_label(F.col("vehicle_count")))


def extreme_speed_locations(mart: DataFrame, k: int = 5, highest: bool = True) -> DataFrame:
    by_location = speed_by_location(mart)
    first = F.desc("avg_speed") if highest else F.asc("avg_speed")
    return top_k(by_location, [first, F.asc("Location0")], k)


def best_location_per_hour(mart: DataFrame, k: int = 5) -> DataFrame:
    """Busiest location of every hour, then the k busiest of these."""
    by_both = mart.groupBy(_hour(), "Location0").agg(F.sum("vehicle_count").alias("n"))
    best = by_both.groupBy("hour").agg(F.min(F.struct((-F.col("n")).alias("n"), "Location0")).alias("b"))
    rows = best.select("hour", F.col("b.Location0").alias("Location0"), (-F.col("b.n")).alias("case_count"))
    return top_k(rows, [F.desc("case_count"), F.asc("hour")], k)


def total_kpi(mart: DataFrame) -> DataFrame:
    return mart.agg(_speed(), F.sum("vehicle_count").alias("n")).select(
        "avg_speed", millions_label(F.col("n")).alias("vehicle_count")
    )


def vehicles_by_class(mart: DataFrame) -> DataFrame:
    counts = mart.groupBy(_class()).agg(F.sum("vehicle_count").alias("vehicle_count"))
    return counts.withColumn("count_range", millions_range_label(F.col("vehicle_count")))


def top_dates(mart: DataFrame, k: int = 5) -> DataFrame:
    by_day = mart.groupBy("processing_date").agg(F.sum("vehicle_count").alias("vehicle_count"))
    return top_k(by_day, [F.desc("vehicle_count"), F.asc("processing_date")], k)


def device_locations(mart: DataFrame) -> DataFrame:
    return mart.filter(F.col("DeviceIndex").isNotNull() & (F.col("DeviceIndex") != "")).select(
        "DeviceIndex", F.coalesce("Location0", F.lit("")).alias("Location0")
    ).distinct()


def device_hours(mart: DataFrame) -> DataFrame:
    """Hours per day between a device's first and last window, as one array per month.

    A device is reduced to its span before the days are unfolded, and a month
    holds at most 31 of them.
    """
    spans = (
        mart.filter("DeviceIndex is not null and DeviceIndex <> '' and window_start is not null and window_end is not null")
        .groupBy("DeviceIndex", F.coalesce("Location0", F.lit("")).alias("Location0"))
        .agg(
            F.timestamp_millis(F.min("window_start")).alias("s"),
            F.timestamp_millis(F.max("window_end")).alias("e"),
        )
    )
    days = spans.withColumn("day", F.explode(F.sequence(F.to_date("s"), F.to_date("e"))))
    midnight, next_midnight = F.col("day").cast("timestamp"), F.date_add("day", 1).cast("timestamp")
    seconds = (
        F.unix_micros(F.least("e", next_midnight)) - F.unix_micros(F.greatest("s", midnight))
    ) / F.lit(1_000_000.0)
    hours = days.withColumn("hours", F.round(seconds / 3600, 2))
    monthly = hours.groupBy("DeviceIndex", "Location0", F.trunc("day", "month").alias("m")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.dayofmonth("day").alias("d"), "hours"))).alias("by_day")
    )
    last = F.dayofmonth(F.last_day("m"))
    graph = F.transform(F.sequence(F.lit(1), last), lambda d: F.coalesce(F.col("by_day")[d], F.lit(0.0)))
    return monthly.select(
        "DeviceIndex", "Location0", F.year("m").alias("year"), F.month("m").alias("month"), graph.alias("graph")
    )


def lookup_values(lookup: DataFrame, lookup_type: str) -> DataFrame:
    return lookup.filter(F.col("lookupType") == lookup_type).select("lookupValue").distinct().orderBy("lookupValue")
