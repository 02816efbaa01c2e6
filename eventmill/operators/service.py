"""Dashboard and API queries over events, transactions, customers and campaigns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventmill.functions.scalars import ago, as_column, percent, ratio, shifted
from eventmill.operators.ordering import top_k


def _one(df: DataFrame, column: Column) -> Column:
    """A single aggregate as a scalar subquery."""
    return df.agg(column).scalar()


# --- now ------------------------------------------------------------------------
def realtime_snapshot(events: DataFrame, transactions: DataFrame, events_as_of, tx_as_of, minutes: int = 5) -> DataFrame:
    """Events, rate, customers and value of the last minutes in one row."""
    recent_events = events.filter(F.col("event_ts") >= ago(events_as_of, mins=minutes))
    recent_tx = transactions.filter(F.col("created_at") >= ago(tx_as_of, mins=minutes))
    n_events = _one(recent_events, F.count("*"))
    return (
        recent_tx.agg(
            F.count("*").alias("transaction_count"),
            F.count_distinct("customer_id").alias("unique_customers"),
            F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("total_value"),
        )
        .withColumn("total_events", n_events)
        .withColumns(
            {
                "events_per_second": F.round(F.col("total_events") / F.lit(minutes * 60.0), 2),
                "status": F.when(F.col("total_events") > 0, "active").otherwise("no_data"),
            }
        )
    )


def dashboard_summary(
    events: DataFrame, transactions: DataFrame, customers: DataFrame, events_as_of, tx_as_of, hours: int = 24
) -> DataFrame:
    """Last-day totals; an empty period gives zeros."""
    recent_tx = transactions.filter(F.col("created_at") >= ago(tx_as_of, hours=hours))
    recent_events = events.filter(F.col("event_ts") >= ago(events_as_of, hours=hours))
    active = customers.filter((F.col("status") == "active") & (F.col("last_order_date") >= ago(tx_as_of, hours=hours)))
    return recent_tx.agg(
        F.count("*").alias("total_transactions"),
        F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("total_revenue"),
        F.round(F.coalesce(F.avg("amount"), F.lit(0.0)), 2).alias("avg_transaction_value"),
        F.count_distinct("customer_id").alias("unique_customers"),
    ).withColumns({"total_events": _one(recent_events, F.count("*")), "active_customers": _one(active, F.count("*"))})


def activity_status(events: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    recent = events.filter(F.col("event_ts") >= ago(as_of, mins=minutes))
    n = F.col("recent_activity_count")

    def state(flag: Column) -> Column:
        return F.when(flag, "active").otherwise("inactive")

    return recent.agg(F.count("*").alias("recent_activity_count")).withColumns(
        {
            "status": F.when(n > 0, "running").otherwise("stopped"),
            "consumer": state(n > 0),
            "stream_processing": state(n > 10),
            "metrics_writer": state(n > 0),
            "health_score": F.when(n > 10, 100).when(n > 0, 50).otherwise(0),
        }
    )


# --- history ----------------------------------------------------------------------
def daily_history(transactions: DataFrame, as_of, days: int = 30, metric_type: str = "revenue") -> DataFrame:
    recent = transactions.filter(F.col("created_at") >= ago(as_of, days=days))
    wanted = (
        F.round(F.sum("amount"), 2).alias("revenue")
        if metric_type == "revenue"
        else F.count_distinct("customer_id").alias("unique_customers")
    )
    return (
        recent.groupBy(F.to_date("created_at").alias("date"))
        .agg(F.count("*").alias("transactions"), wanted)
        .orderBy("date")
    )


def calendar_history(customer_hours: DataFrame, transaction_hours: DataFrame, granularity: str, start, end) -> DataFrame:
    """Calendar histogram over two hourly gold tables, joined on the bucket.

    Both sides are aggregated to the bucket before the join. Buckets that only
    the transaction side has are not reported: the customer series leads.
    """
    if granularity not in ("hour", "day", "week", "month"):
        raise ValueError(granularity)
    bucket = F.date_trunc(granularity, "hour").alias("timestamp")

    def part(df):
        return df.filter((F.col("hour") >= as_column(start)) & (F.col("hour") <= as_column(end))).groupBy(bucket)

    customers = part(customer_hours).agg(F.sum("total_customers").alias("customers"))
    orders = part(transaction_hours).agg(
        F.sum("total_revenue").alias("revenue"),
        F.sum("total_transactions").alias("orders"),
        F.avg("avg_transaction_value").alias("avg_order_value"),
    )
    joined = customers.join(orders, "timestamp", "left").select(
        "timestamp",
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        F.coalesce("orders", F.lit(0)).alias("orders"),
        F.coalesce("customers", F.lit(0)).alias("customers"),
        F.coalesce("avg_order_value", F.lit(0.0)).alias("avg_order_value"),
    )
    rate = percent(F.col("orders"), F.greatest(F.col("customers"), F.lit(1)))
    return joined.withColumn("conversion_rate", rate).orderBy("timestamp")


# --- rankings -------------------------------------------------------------------
def with_product_names(top: DataFrame, products: DataFrame) -> DataFrame:
    """Left join of a bounded top list to a product dimension of any size.

    The list is used once, so the fact behind it is read once; Spark broadcasts the
    dimension if it is small and else shuffles its three columns.
    """
    names = products.select("product_id", "name", "category")
    fallback = F.concat(F.lit("Product "), F.col("product_id").cast("string"))
    return top.join(names, "product_id", "left").withColumns(
        {"name": F.coalesce("name", fallback), "category": F.coalesce("category", F.lit("Unknown"))}
    )


def top_products(sales: DataFrame, products: DataFrame, as_of, days: int = 30, limit: int = 10) -> DataFrame:
    ranked = (
        sales.filter(F.col("created_at") >= ago(as_of, days=days))
        .groupBy("product_id")
        .agg(
            F.round(F.sum("amount"), 2).alias("total_revenue"),
            F.count("*").alias("total_orders"),
            F.round(F.avg("amount"), 2).alias("avg_order_value"),
        )
    )
    top = top_k(ranked, [F.desc("total_revenue"), F.asc("product_id")], limit)
    return with_product_names(top, products).orderBy(F.desc("total_revenue"), "product_id")


def top_products_with_growth(sales: DataFrame, products: DataFrame, as_of, days: int = 30, limit: int = 10) -> DataFrame:
    """Top products with the change against the period before, from one scan of both periods."""
    middle = ago(as_of, days=days)
    now = F.col("created_at") >= middle
    both = (
        sales.filter(F.col("created_at") >= ago(as_of, days=2 * days))
        .groupBy("product_id")
        .agg(
            F.count_if(now).alias("sales"),
            F.round(F.sum(F.when(now, F.col("amount"))), 2).alias("revenue"),
            F.round(F.sum(F.when(~now, F.col("amount"))), 2).alias("previous_revenue"),
        )
    )
    top = top_k(both.filter("sales > 0"), [F.desc("revenue"), F.asc("product_id")], limit)
    growth = change_percent(F.col("revenue"), F.col("previous_revenue"))
    return with_product_names(top.withColumn("growth_rate", growth), products)


def top_customers(transactions: DataFrame, customers: DataFrame, limit: int = 10) -> DataFrame:
    spent = transactions.groupBy("customer_id").agg(
        F.round(F.sum("amount"), 2).alias("total_spent"),
        F.count("*").alias("total_orders"),
        F.max("created_at").alias("last_order_date"),
    )
    top = top_k(spent, [F.desc("total_spent"), F.asc("customer_id")], limit)
    names = customers.select("customer_id", F.col("name").alias("customer_name"))
    return top.join(names, "customer_id", "left")


# --- customers, users -------------------------------------------------------------
def customer_statistics(customers: DataFrame) -> DataFrame:
    def having(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return customers.agg(
        F.count("*").alias("total_customers"),
        having("active").alias("active_customers"),
        having("churned").alias("churned_customers"),
        F.coalesce(F.sum("total_spent"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.avg("total_spent"), F.lit(0.0)).alias("avg_order_value"),
        F.coalesce(F.sum("total_orders"), F.lit(0)).alias("total_orders"),
    ).withColumns(
        {
            "churn_rate": F.coalesce(
                F.round(percent(F.col("churned_customers"), F.col("total_customers")), 2), F.lit(0.0)
            ),
            "activity_rate": F.coalesce(
                F.round(percent(F.col("active_customers"), F.col("total_customers")), 2), F.lit(0.0)
            ),
        }
    )


def distribution(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """Count and percentage per value, NULL shown as unknown.

    The total is a scalar subquery, so a column of many values is not gathered in one task.
    """
    counts = df.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown")).alias(column)).agg(
        F.count("*").alias("count")
    )
    total = _one(df, F.count("*"))
    return counts.withColumn("percentage", F.round(percent(F.col("count"), total), digits)).orderBy(
        F.desc("count"), column
    )


def segment_breakdown(customers: DataFrame, as_of, days: int = 30) -> DataFrame:
    recent = F.count_if(F.col("created_at") >= ago(as_of, days=days))
    counts = customers.groupBy("segment").agg(F.count("*").alias("count"), recent.alias("new_customers"))
    total = _one(customers, F.count("*"))
    return counts.withColumn("percentage", F.round(percent(F.col("count"), total), 1))


def user_statistics(users: DataFrame, as_of) -> DataFrame:
    """``users``: is_active, is_verified, last_login, created_at."""
    return users.agg(
        F.count("*").alias("total_users"),
        F.count_if("is_active").alias("active_users"),
        F.count_if("is_verified").alias("verified_users"),
        F.count_if(F.col("last_login") >= ago(as_of, days=30)).alias("active_last_30_days"),
        F.count_if(F.col("created_at") >= ago(as_of, days=7)).alias("new_last_7_days"),
    ).withColumns(
        {
            "activation_rate": F.coalesce(percent(F.col("active_users"), F.col("total_users")), F.lit(0.0)),
            "verification_rate": F.coalesce(percent(F.col("verified_users"), F.col("total_users")), F.lit(0.0)),
        }
    )


def user_account(users: DataFrame, as_of) -> DataFrame:
    return users.select(
        "user_id",
        "login_count",
        "last_login",
        F.date_diff(as_column(as_of), F.col("created_at")).alias("account_age_days"),
        "is_active",
        "is_verified",
        "role",
    )


# --- runs, campaigns, counts ---------------------------------------------------------
def run_status(runs: DataFrame, as_of) -> DataFrame:
    """Latest run and the success rate of the day ``as_of`` falls in.

    ``runs``: run_id, created_at, status, duration_seconds.
    """
    today = F.to_date("created_at") == F.to_date(as_column(as_of))
    done = today & (F.col("status") == "completed")
    newest = F.struct("created_at", "run_id")
    return runs.agg(
        F.max_by("run_id", newest).alias("last_run"),
        F.max_by("status", newest).alias("last_status"),
        F.count_if(today).alias("runs_today"),
        F.count_if(done).alias("completed_today"),
        F.round(F.coalesce(F.avg(F.when(today, F.col("duration_seconds"))), F.lit(0.0)), 2).alias("avg_processing_time"),
    ).withColumn(
        "success_rate",
        F.coalesce(F.round(percent(F.col("completed_today"), F.col("runs_today")), 2), F.lit(0.0)),
    )


def campaign_ratios(campaigns: DataFrame) -> DataFrame:
    totals = campaigns.groupBy("campaign_id").agg(
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum("conversions").alias("conversions"),
        F.sum("spend").alias("cost"),
        F.sum("revenue").alias("revenue"),
    )
    c = {n: F.col(n) for n in totals.columns}
    return totals.withColumns(
        {
            "ctr": percent(c["clicks"], c["impressions"]),
            "cvr": percent(c["conversions"], c["clicks"]),
            "roi": percent(c["revenue"] - c["cost"], c["cost"]),
            "cpc": ratio(c["cost"], c["clicks"]),
            "cpa": ratio(c["cost"], c["conversions"]),
            "roas": ratio(c["revenue"], c["cost"]),
        }
    )


def campaign_overview(campaigns: DataFrame) -> DataFrame:
    """``campaigns``: one row each with status, budget, cost, revenue, ctr, cvr."""
    return campaigns.agg(
        F.count("*").alias("total_campaigns"),
        F.count_if(F.col("status") == "active").alias("active_campaigns"),
        F.sum("budget").alias("total_budget"),
        F.sum("cost").alias("total_spent"),
        F.sum("revenue").alias("total_revenue"),
        F.round(F.avg(F.coalesce("ctr", F.lit(0.0))), 2).alias("avg_ctr"),
        F.round(F.avg(F.coalesce("cvr", F.lit(0.0))), 2).alias("avg_cvr"),
    ).withColumn(
        "total_roi",
        F.coalesce(
            F.round(percent(F.col("total_revenue") - F.col("total_spent"), F.col("total_spent")), 2), F.lit(0.0)
        ),
    )


def campaign_over_time(campaigns: DataFrame, as_of, period: str = "7d", campaign_id=None) -> DataFrame:
    days = {"24h": 1, "7d": 7, "30d": 30}[period]
    recent = campaigns.filter(F.col("event_ts") >= ago(as_of, days=days))
    if campaign_id is not None:
        recent = recent.filter(F.col("campaign_id") == as_column(campaign_id))
    return recent.groupBy("campaign_id", F.to_date("event_ts").alias("date")).agg(
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum("conversions").alias("conversions"),
        F.sum("spend").alias("spend"),
        F.sum("revenue").alias("revenue"),
    )


def event_type_counts(events: DataFrame) -> DataFrame:
    """Counts per type with a ``total`` row."""
    return (
        events.groupBy(F.coalesce("event_type", F.lit("unknown")).alias("event_type"))
        .agg(F.count("*").alias("n"))
        .rollup("event_type")
        .agg(F.sum("n").alias("count"))
        .withColumn("event_type", F.coalesce("event_type", F.lit("total")))
    )


def type_rollup(events: DataFrame) -> DataFrame:
    """Customer / Transaction / Analytics counts by what the event type contains."""
    kind = (
        F.when(F.contains("event_type", F.lit("customer")), "Customer")
        .when(F.contains("event_type", F.lit("transaction")), "Transaction")
        .otherwise("Analytics")
    )
    return events.groupBy(kind.alias("category")).agg(F.count("*").alias("count"))


# --- declared surfaces -----------------------------------------------------------------
def change_percent(current: Column, previous: Column) -> Column:
    return percent(current - previous, previous)


def channel_performance(events: DataFrame, channel: str) -> DataFrame:
    return (
        events.groupBy(F.col(channel).alias("channel"))
        .agg(
            F.count_distinct("customer_id").alias("visitors"),
            F.count_if(F.col("event_type") == "purchase").alias("conversions"),
            F.sum("amount").alias("revenue"),
            F.avg("amount").alias("avg_order_value"),
        )
        .withColumn("conversion_rate", percent(F.col("conversions"), F.col("visitors")))
    )


def geography(customers: DataFrame, places: DataFrame) -> DataFrame:
    """Customers and revenue by country. Customers are summed per nation before the join."""
    by_nation = customers.groupBy("nation_key").agg(
        F.count("*").alias("customers"), F.sum("total_spent").alias("revenue"), F.sum("total_orders").alias("orders")
    )
    return by_nation.join(places, F.col("nation_key") == F.col("n_nationkey")).select(
        "country", "region", "customers", "revenue", ratio(F.col("revenue"), F.col("orders")).alias("avg_order_value")
    )


def trend_change(transactions: DataFrame, as_of, metric: str = "revenue", period: str = "7d") -> DataFrame:
    """Current period against the one before: percent and direction, from one scan."""
    days = {"24h": 1, "7d": 7, "30d": 30, "90d": 90}[period]
    now = F.col("created_at") > ago(as_of, days=days)
    both = transactions.filter(F.col("created_at") > ago(as_of, days=2 * days))

    def value(flag: Column) -> Column:
        if metric == "revenue":
            return F.sum(F.when(flag, F.col("amount")))
        if metric == "orders":
            return F.count_if(flag).cast("double")
        if metric == "customers":
            return F.count_distinct(F.when(flag, F.col("customer_id"))).cast("double")
        if metric == "conversion_rate":
            return percent(F.count_if(flag & (F.col("status") == "completed")), F.count_if(flag))
        raise ValueError(metric)

    change = F.coalesce(F.round(change_percent(F.col("current_value"), F.col("previous_value")), 2), F.lit(0.0))
    return (
        both.agg(value(now).alias("current_value"), value(~now).alias("previous_value"))
        .withColumn("trend_percent", change)
        .withColumn(
            "trend_direction",
            F.when(F.col("trend_percent") > 0, "up").when(F.col("trend_percent") < 0, "down").otherwise("neutral"),
        )
    )


def day_over_day(transactions: DataFrame, as_of) -> DataFrame:
    """Revenue, orders and customers of the last day and their change."""
    day = F.to_date(as_column(as_of))
    # a range on the raw column, so that only the last two days are scanned
    start = shifted(as_of, lambda now: F.date_sub(F.to_date(now), 1).cast("timestamp"))
    recent = transactions.filter(F.col("created_at") >= start)
    today = F.to_date("created_at") == day

    def pair(name: str, agg) -> list[Column]:
        return [agg(today).alias(f"today_{name}"), agg(~today).alias(f"previous_{name}")]

    row = recent.agg(
        *pair("revenue", lambda f: F.round(F.sum(F.when(f, F.col("amount"))), 2)),
        *pair("orders", F.count_if),
        *pair("customers", lambda f: F.count_distinct(F.when(f, F.col("customer_id")))),
    )
    changes = {
        f"{n}_change_percent": F.round(change_percent(F.col(f"today_{n}"), F.col(f"previous_{n}")), 2)
        for n in ("revenue", "orders", "customers")
    }
    return row.withColumns(changes)


def realtime_sessions(events: DataFrame, sessions: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    """Active users, rates and session quality in one row."""
    recent = events.filter(F.col("event_ts") >= ago(as_of, mins=minutes))
    session_row = sessions.agg(
        percent(F.count_if(F.col("purchases") > 0), F.count("*")).alias("conversion_rate"),
        F.avg("duration_seconds").alias("avg_session_duration"),
        ratio(F.count_if(F.col("events") == 1), F.count("*")).alias("bounce_rate"),
    )
    return session_row.withColumns(
        {
            "active_users": _one(recent, F.count_distinct("customer_id")),
            "events_per_second": _one(recent, F.count("*") / F.lit(minutes * 60.0)),
            "revenue_per_minute": _one(recent, F.coalesce(F.sum("amount"), F.lit(0.0)) / F.lit(float(minutes))),
        }
    )


def _ranked_names(events: DataFrame, column: str, k: int) -> Column:
    """Names of the k most frequent values, in order, as a scalar array."""
    counts = events.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    top = top_k(counts, [F.desc("n"), F.asc("v")], k)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "v")))
    return top.agg(F.transform(ordered, lambda s: s.getField("v"))).scalar()


def behavior_summary(events: DataFrame, k: int = 3) -> DataFrame:
    return events.agg(
        F.count_distinct("customer_id").alias("unique_customers"),
        F.avg("value").alias("avg_engagement"),
    ).withColumns(
        {"top_actions": _ranked_names(events, "event_type", k), "top_devices": _ranked_names(events, "device_type", k)}
    )


def transaction_overview(transactions: DataFrame) -> DataFrame:
    """Totals and a status breakdown map, from one grouping by status."""
    by_status = transactions.groupBy("status").agg(F.count("*").alias("n"), F.sum("amount").alias("s"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))
    return by_status.agg(
        F.round(F.sum("s"), 2).alias("total_revenue"),
        F.sum("n").alias("total_transactions"),
        F.round(ratio(F.sum("s"), F.sum("n")), 2).alias("avg_transaction_value"),
        percent(F.sum(F.when(F.col("status") == "completed", F.col("n")).otherwise(0)), F.sum("n")).alias("success_rate"),
        entries.alias("status_breakdown"),
    )


def funnel(events: DataFrame, stages: list[str]) -> DataFrame:
    """Customers reaching each stage in order, by their first time at each stage."""
    first = [
        F.min(F.when(F.col("event_type") == s, F.col("event_ts"))).alias(f"_t{i}") for i, s in enumerate(stages)
    ]
    users = events.filter(F.col("event_type").isin(*stages)).groupBy("customer_id").agg(*first)
    reached, counts = None, []
    for i, _ in enumerate(stages):
        ok = F.col(f"_t{i}").isNotNull()
        if i:
            ok = ok & (F.col(f"_t{i}") > F.col(f"_t{i - 1}"))
        reached = ok if reached is None else reached & ok
        counts.append(F.count_if(F.coalesce(reached, F.lit(False))).alias(f"_n{i}"))
    row = users.agg(*counts)
    parts = [
        F.struct(
            F.lit(i + 1).alias("step"),
            F.lit(s).alias("stage"),
            F.col(f"_n{i}").alias("customers"),
            percent(F.col(f"_n{i}"), F.col("_n0")).alias("from_start"),
            percent(F.col(f"_n{i}"), F.col(f"_n{max(i - 1, 0)}")).alias("from_previous"),
        )
        for i, s in enumerate(stages)
    ]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def revenue_trend(transactions: DataFrame, granularity: str = "month") -> DataFrame:
    """Revenue per period and the change from the period before; the window sees one row per period."""
    by_period = transactions.groupBy(F.date_trunc(granularity, "created_at").alias("period")).agg(
        F.round(F.sum("amount"), 2).alias("revenue"), F.count("*").alias("orders")
    )
    previous = F.lag("revenue").over(Window.orderBy("period"))
    return by_period.withColumn("previous_revenue", previous).withColumn(
        "change_percent", F.round(change_percent(F.col("revenue"), F.col("previous_revenue")), 2)
    )
