"""Canonical frames over the driver's parquet tables.

The source tables are TPC-H-like; these projections give them the column names
the operators work on. ``device_type``, ``session_id``, ``category`` and the
mapping of order status are declared synthetic columns.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmill.functions.scalars import latest
from eventmill.schemas import SOURCE_TABLES

DEVICES = ("desktop", "mobile", "tablet")
CATEGORIES = ("electronics", "clothing", "books", "home", "sports", "food")


def _pick(index, values):
    expr = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        expr = F.when(index == i, F.lit(v)).otherwise(expr)
    return expr


class Tables:
    """Canonical views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(SOURCE_TABLES[name]).parquet(self.path(name))

    @staticmethod
    def to_events(raw: DataFrame) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        action = (
            F.when(F.col("event_type") == "view", "page_view")
            .when(F.col("event_type") == "click", "add_to_cart")
            .otherwise(F.col("event_type"))
        )
        return raw.select(
            "event_id",
            F.col("user_id").alias("customer_id"),
            action.alias("event_type"),
            F.col("ts").alias("event_ts"),
            "value",
            F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"),
            k.alias("product_id"),
            (k % 10).alias("campaign_id"),
            _pick(F.col("event_id") % 3, DEVICES).alias("device_type"),
            _pick(k % 6, CATEGORIES).alias("category"),
            F.concat(
                F.lit("s"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")
            ).alias("session_id"),
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.to_events(self.raw("events"))

    @staticmethod
    def to_transactions(raw: DataFrame) -> DataFrame:
        status = (
            F.when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "O", "pending")
            .otherwise("failed")
        )
        return raw.select(
            F.col("o_orderkey").alias("transaction_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_totalprice").alias("amount"),
            status.alias("status"),
            F.col("o_orderpriority").alias("payment_method"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def transactions(self) -> DataFrame:
        return self.to_transactions(self.raw("orders"))

    @cached_property
    def sales(self) -> DataFrame:
        """One row per order line, with the product and the line amount."""
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("product_id"),
            F.col("l_orderkey").alias("transaction_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_extendedprice").alias("amount"),
            F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category")
        )

    @cached_property
    def geography(self) -> DataFrame:
        """Nation to region: 25 rows by definition of the data model."""
        nation, region = self.raw("nation"), self.raw("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            "n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("region")
        )

    @cached_property
    def customers(self) -> DataFrame:
        """Customer dimension with order totals; orders are aggregated before the join."""
        totals = self.raw("orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(
            F.count("*").alias("total_orders"),
            F.sum("o_totalprice").alias("total_spent"),
            F.min("o_orderdate").alias("created_at"),
            F.max("o_orderdate").alias("last_order_date"),
        )
        as_of = latest(self.raw("orders"), "o_orderdate")
        age = F.date_diff(as_of, F.col("last_order_date"))
        return (
            self.raw("customer")
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("c_name").alias("name"),
                F.col("c_nationkey").alias("nation_key"),
                F.col("c_acctbal").alias("balance"),
                F.col("c_mktsegment").alias("segment"),
            )
            .join(totals, "customer_id", "left")
            .withColumns(
                {
                    "total_orders": F.coalesce("total_orders", F.lit(0)),
                    "total_spent": F.coalesce("total_spent", F.lit(0.0)),
                    "status": F.when(age <= 90, "active").when(age <= 365, "inactive").otherwise("churned"),
                }
            )
            .withColumn(
                "lifecycle_stage",
                F.when(F.col("total_orders") >= 12, "loyal")
                .when(F.col("total_orders") >= 8, "repeat")
                .when(F.col("total_orders") >= 1, "new"),
            )
        )

    @cached_property
    def metrics(self) -> DataFrame:
        """Metric samples: the event type is the metric name."""
        return self.raw("events").select(
            F.col("event_id").alias("sample_id"),
            F.col("event_type").alias("metric_name"),
            F.col("ts").alias("event_ts"),
            "value",
        )

    @cached_property
    def campaigns(self) -> DataFrame:
        """Campaign counters per event: view = impression, click = click, purchase = conversion."""
        e = self.events
        return e.select(
            "campaign_id",
            "event_ts",
            F.when(F.col("event_type") == "page_view", 1).otherwise(0).alias("impressions"),
            F.when(F.col("event_type") == "add_to_cart", 1).otherwise(0).alias("clicks"),
            F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("conversions"),
            (F.col("value") * 0.1).alias("spend"),
            F.coalesce("amount", F.lit(0.0)).alias("revenue"),
        )

    @cached_property
    def passages(self) -> DataFrame:
        """Traffic passages: speed = value, class = event type, location = ``k``."""
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.raw("events").select(
            F.col("ts").alias("passage_time"),
            F.col("value").alias("speed"),
            F.col("event_type").alias("VehicleClass"),
            F.concat(F.lit("L"), k.cast("string")).alias("Location0"),
            F.concat(F.lit("D"), (k % 20).cast("string")).alias("DeviceIndex"),
            F.concat(F.lit("R"), (k % 5).cast("string")).alias("Region"),
            F.lit(80.0).alias("SpeedLimit"),
        )

    @cached_property
    def batch_log(self) -> DataFrame:
        """Processing log: one batch per order; its duration is the line count in seconds."""
        lines = self.raw("lineitem").groupBy("l_orderkey").agg(
            F.count("*").alias("record_count"), F.sum("l_quantity").alias("bytes_processed")
        )
        o = self.raw("orders")
        return o.join(lines, o.o_orderkey == lines.l_orderkey).select(
            F.col("o_orderkey").alias("batch_id"),
            F.col("o_orderpriority").alias("table_name"),
            "record_count",
            F.col("o_orderdate").alias("processing_start"),
            F.when(
                F.col("o_orderstatus") != "P",
                F.col("o_orderdate") + F.make_dt_interval(secs=F.col("record_count").cast("decimal(18,6)")),
            ).alias("processing_end"),
            F.col("bytes_processed").cast("bigint").alias("bytes_processed"),
        )
