"""The physical plans the scale rests on."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from eventmill.catalog.registry import QUERIES
from eventmill.functions.scalars import ago, latest
from eventmill.operators import batchlog, marts, service
from eventmill.operators.writers import write_table
from eventmill.session import TIMESTAMPS
from eventmill.sources import tables as scans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_range_reaches_the_scan(tables):
    df = scans.read_time_range(tables.events, F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-03").cast("timestamp"))
    text = plan(df.select("event_id"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text


def test_only_needed_columns_are_read(tables):
    text = plan(marts.daily_metrics(tables.events))
    assert "props" not in text.split("ReadSchema")[-1]


def test_rank_filter_limits_before_the_shuffle(tables):
    text = plan(batchlog.newest_per_group(tables.events, ["event_type"], 10))
    assert text.count("WindowGroupLimit") == 2


def test_top_list_reads_the_fact_once(tables):
    now = F.lit("1999-01-01").cast("timestamp")
    text = plan(service.top_products(tables.sales, tables.products, now))
    assert "TakeOrderedAndProject" in text and "CartesianProduct" not in text
    assert text.count("lineitem.parquet") == 1
    assert plan(service.top_customers(tables.transactions, tables.customers)).count("o_totalprice") >= 1


RECENT = ["src15_last_hours", "src8_time_range_scan", "agg20_realtime_snapshot", "agg22", "agg38", "dec3", "dec4", "win5_current_rate"]


@pytest.mark.parametrize("prefix", RECENT)
def test_lower_time_bound_reaches_the_scan(spark, sf_dir, prefix):
    entry.queries()
    names = [n for n in QUERIES if n.startswith(prefix)]
    assert names
    for name in names:
        text = plan(QUERIES[name](spark, sf_dir))
        filters = re.findall(r"PushedFilters: \[([^\]]*)\]", text) + re.findall(r"DataFilters: \[([^\]]*)\]", text)
        assert any(re.search("GreaterThan|>=? ?(scalar-)?[Ss]ubquery", f) for f in filters), text


def test_recent_rows_skip_row_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    start = F.lit("2024-01-01").cast("timestamp").cast("long")
    rows = spark.range(400_000).select("id", (start + F.col("id")).cast("timestamp").alias("ts"))
    rows = rows.coalesce(1)
    before = spark.conf.get(TIMESTAMPS)
    spark.sparkContext._jsc.hadoopConfiguration().setInt("parquet.block.size", 64 * 1024)
    try:
        write_table(rows, path)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    assert spark.conf.get(TIMESTAMPS) == before
    table = spark.read.parquet(path)
    df = scans.since(table, "ts", latest(table, "ts"), mins=5)
    assert df.count() == 301
    scanned = scans.since(table, "ts", latest(table, "ts"), mins=5).select("id")
    scanned.collect()
    assert "GreaterThanOrEqual(ts" in plan(scanned) or "subquery" in plan(scanned).lower()


def test_no_python_in_the_marts(tables):
    for df in (marts.customer_360(tables.events, F.current_timestamp()), marts.product_analytics(tables.events)):
        assert "Python" not in plan(df) and "CartesianProduct" not in plan(df)


def test_as_of_filter_uses_a_subquery_not_a_join(tables):
    now = tables.raw("events").agg(F.max("ts")).scalar()
    text = plan(tables.events.filter(F.col("event_ts") >= ago(now, days=1)))
    assert "NestedLoop" not in text and "Subquery" in text
