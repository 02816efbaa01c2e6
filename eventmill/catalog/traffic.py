"""Queries: traffic mart and KPIs."""

from pyspark.sql import functions as F

from eventmill.catalog.registry import ctes, register, rounded
from eventmill.operators import traffic
from eventmill.operators.ordering import page

HOUR = "hour(make_timestamp(window_start * 1000))"
MONTH = "monthname(CAST(processing_date AS DATE))"
YEAR = "year(CAST(processing_date AS DATE))"
RANGE = "CAST(floor({0} / 5) * 5 AS BIGINT) || ' - ' || (CAST(floor({0} / 5) * 5 AS BIGINT) + 5)"
MRANGE = "printf('%.2fM', floor({0} / 1e6 * 100) / 100) || ' - ' || printf('%.3fM', floor({0} / 1e6 * 100) / 100 + 0.005)"
SPEED = "round(avg(avg_speed), 6) AS avg_speed"
VEH = "CAST(sum(vehicle_count) AS BIGINT) AS vehicle_count"
VIO = "CAST(sum(violation_count) AS BIGINT) AS case_count"


def mart(t):
    return traffic.windowed_traffic(t.passages)


def q(name, body, fn):
    register(name, ctes("trf", body))(lambda t: rounded(fn(mart(t))))


q(
    "trf1_speed_by_hour",
    f"""SELECT CAST(h AS INTEGER) AS hour, coalesce(s, 0) AS avg_speed FROM range(24) r(h)
LEFT JOIN (SELECT {HOUR} AS hh, round(avg(avg_speed), 6) AS s FROM trf GROUP BY 1) ON hh = h""",
    traffic.speed_by_hour,
)
q(
    "trf2_speed_by_month",
    f"SELECT CAST({YEAR} AS INTEGER) AS year, {MONTH} AS month, {SPEED} FROM trf GROUP BY 1, 2",
    traffic.speed_by_month,
)
q(
    "trf3_speed_by_class",
    f"SELECT VehicleClass, {SPEED}, {RANGE.format('avg(avg_speed)')} AS speed_range FROM trf GROUP BY 1",
    traffic.speed_by_class,
)
q(
    "trf4_vehicles_by_hour",
    f"""SELECT CAST(h AS INTEGER) AS hour, CAST(coalesce(s, 0) AS BIGINT) AS vehicle_count FROM range(24) r(h)
LEFT JOIN (SELECT {HOUR} AS hh, sum(vehicle_count) AS s FROM trf GROUP BY 1) ON hh = h""",
    traffic.vehicles_by_hour,
)
q(
    "trf5_vehicles_by_month",
    f"SELECT CAST({YEAR} AS INTEGER) AS year, {MONTH} AS month, {VEH} FROM trf GROUP BY 1, 2",
    traffic.vehicles_by_month,
)
q("trf6_violations_by_class", f"SELECT lower(VehicleClass) AS vehicle_class, {VIO} FROM trf GROUP BY 1", traffic.violations_by_class)
q(
    "trf7_violations_by_hour_class",
    f"SELECT printf('%02d', {HOUR}) AS hour, lower(VehicleClass) AS vehicle_class, {VIO} FROM trf GROUP BY 1, 2",
    traffic.violations_by_hour_class,
)
q(
    "trf8_violations_by_month_class",
    f"SELECT monthname(make_timestamp(window_start * 1000)) AS month, lower(VehicleClass) AS vehicle_class, {VIO} FROM trf GROUP BY 1, 2",
    traffic.violations_by_month_class,
)
q("trf9_overall_speed", f"SELECT {SPEED}, {RANGE.format('avg(avg_speed)')} AS speed_range FROM trf", traffic.overall_speed)
q(
    "trf10_speed_by_location",
    f"SELECT Location0, {SPEED}, {RANGE.format('avg(avg_speed)')} AS speed_range FROM trf GROUP BY 1",
    traffic.speed_by_location,
)
q(
    "trf11_peak_hour",
    f"SELECT CAST({HOUR} AS INTEGER) AS hour, {VEH} FROM trf GROUP BY 1 ORDER BY vehicle_count DESC, hour LIMIT 1",
    traffic.peak_hour,
)
_TOPV = "SELECT Location0, CAST(sum(violation_count) AS BIGINT) AS violation_count FROM trf GROUP BY 1 ORDER BY violation_count DESC, Location0 LIMIT {}"
q("trf12_top_violation_location", _TOPV.format(1), lambda m: traffic.top_violation_locations(m, 1))
_TOPN = f"""SELECT Location0, {VEH}, {MRANGE.format('sum(vehicle_count)')} AS count_range FROM trf GROUP BY 1
ORDER BY vehicle_count DESC, Location0 LIMIT %d"""
q("trf13_top_vehicle_location", _TOPN.replace("%d", "1"), lambda m: traffic.top_volume_locations(m, 1))
for _n, _d, _h in (("trf14_fastest_locations", "DESC", True), ("trf14_slowest_locations", "ASC", False)):
    q(
        _n,
        f"""SELECT Location0, {SPEED}, {RANGE.format('avg(avg_speed)')} AS speed_range FROM trf GROUP BY 1
ORDER BY avg(avg_speed) {_d}, Location0 LIMIT 5""",
        lambda m, h=_h: traffic.extreme_speed_locations(m, 5, h),
    )
q("trf15_top_violation_locations", _TOPV.format(5), traffic.top_violation_locations)
q("trf16_top_volume_locations", _TOPN.replace("%d", "5"), traffic.top_volume_locations)
_BEST = f"""SELECT hour, Location0, case_count FROM (
  SELECT *, row_number() OVER (PARTITION BY hour ORDER BY case_count DESC, Location0) AS rn FROM (
    SELECT CAST({HOUR} AS INTEGER) AS hour, Location0, CAST(sum(vehicle_count) AS BIGINT) AS case_count FROM trf GROUP BY 1, 2))
WHERE rn = 1 ORDER BY case_count DESC, hour LIMIT """
q("trf17_best_location_per_hour", _BEST + "5", traffic.best_location_per_hour)
q("win2_arg_max_per_hour", _BEST + "24", lambda m: traffic.best_location_per_hour(m, 24))
q("trf18_total_kpi", f"SELECT {SPEED}, printf('%.3fM', sum(vehicle_count) / 1e6) AS vehicle_count FROM trf", traffic.total_kpi)
q(
    "trf19_vehicles_by_class",
    f"SELECT lower(VehicleClass) AS vehicle_class, {VEH}, {MRANGE.format('sum(vehicle_count)')} AS count_range FROM trf GROUP BY 1",
    traffic.vehicles_by_class,
)
q(
    "trf20_top_dates",
    f"SELECT processing_date, {VEH} FROM trf GROUP BY 1 ORDER BY vehicle_count DESC, processing_date LIMIT 5",
    traffic.top_dates,
)
q(
    "trf23_windowed_traffic",
    """SELECT window_start, window_end, processing_date, VehicleClass, Location0, DeviceIndex, Region, SpeedLimit,
  round(avg_speed, 6) AS avg_speed, vehicle_count, violation_count FROM trf""",
    lambda m: m,
)
q(
    "prj33_traffic_filter",
    """SELECT VehicleClass, Region, processing_date, CAST(sum(vehicle_count) AS BIGINT) AS vehicle_count FROM trf
WHERE processing_date BETWEEN '2024-01-05' AND '2024-01-20' AND Region = 'R1' AND VehicleClass = 'click' GROUP BY 1, 2, 3""",
    lambda m: traffic.select_traffic(m, "2024-01-05", "2024-01-20", "R1", "click")
    .groupBy("VehicleClass", "Region", "processing_date")
    .agg(F.sum("vehicle_count").alias("vehicle_count")),
)
q("agg52_device_locations", "SELECT DISTINCT DeviceIndex, Location0 FROM trf", traffic.device_locations)

_HOURS = """SELECT DeviceIndex, Location0, CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month,
  array_to_string(list_transform(range(1, day(last_day(m)) + 1), lambda d: printf('%.2f', coalesce(by_day[d], 0))), ',') AS graph
FROM (SELECT DeviceIndex, Location0, m, map_from_entries(list({'k': day(d), 'v': h})) AS by_day FROM (
    SELECT DeviceIndex, Location0, date_trunc('month', d)::DATE AS m, d,
      round((epoch_us(least(e, d + INTERVAL 1 DAY)) - epoch_us(greatest(s, d))) / 3600000000.0::DOUBLE, 2) AS h
    FROM (SELECT DeviceIndex, Location0, s, e, unnest(generate_series(date_trunc('day', s)::TIMESTAMP, date_trunc('day', e)::TIMESTAMP, INTERVAL 1 DAY)) AS d
      FROM (SELECT DeviceIndex, Location0, make_timestamp(min(window_start) * 1000) AS s, make_timestamp(max(window_end) * 1000) AS e
        FROM trf GROUP BY 1, 2)))
  GROUP BY 1, 2, 3)"""


def graph_text(df):
    return df.withColumn("graph", F.array_join(F.transform("graph", lambda h: F.format_string("%.2f", h)), ","))


q("trf21_device_hours", _HOURS, lambda m: graph_text(traffic.device_hours(m)))
q(
    "trf22_device_hours_page",
    _HOURS + " ORDER BY DeviceIndex, Location0, year, month LIMIT 10 OFFSET 20",
    lambda m: graph_text(page(traffic.device_hours(m), [F.asc(c) for c in ("DeviceIndex", "Location0", "year", "month")], 20, 10)),
)
