"""The layers of the warehouse: details, minute and hour aggregates, application views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ago, at, between, canceled, money, ratio, rounded

KNOWN_STATUSES = ("created", "approved", "invoiced", "processing", "shipped", "delivered", "canceled", "unavailable")


def last(df: DataFrame, as_of: dt.datetime | Column, time: str = "event_time", **units: int) -> DataFrame:
    """Rows of the last N hours, days, ... before as_of."""
    return df.filter(between(F.col(time), ago(as_of, **units), at(as_of)))


def prior(df: DataFrame, as_of: dt.datetime | Column, start_hours: int, end_hours: int, time: str = "event_time") -> DataFrame:
    """Rows from start_hours to end_hours before as_of."""
    return df.filter(between(F.col(time), ago(as_of, hours=start_hours), ago(as_of, hours=end_hours)))


def order_detail(orders: DataFrame) -> DataFrame:
    """An order with its totals, date parts and whether it is paid."""
    return orders.withColumns(
        {
            "total_amount": rounded(F.col("price") + F.col("freight_value"), 2),
            "event_date": F.to_date("event_time"),
            "event_hour": F.hour("event_time"),
            "is_paid": F.when(F.col("order_status") == "delivered", 1).otherwise(0),
        }
    )


def with_payment(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders with their latest payment; none gives an empty type and 0."""
    paid = payments.groupBy("order_id").agg(F.max_by(F.struct("payment_type", "payment_value"), F.struct("event_time", "payment_id")).alias("p"))
    return orders.join(paid, "order_id", "left").withColumns({"payment_type": F.coalesce("p.payment_type", F.lit("")), "payment_value": F.coalesce("p.payment_value", F.lit(0.0))}).drop("p")


def sales_measures() -> list[Column]:
    n = F.count_distinct("order_id")
    return [n.alias("order_cnt"), money(F.col("price")).alias("total_gmv"), ratio(money(F.col("price")), F.count("price")).alias("avg_price"), F.count_distinct("customer_id").alias("unique_customers"), F.count_if(canceled()).alias("cancel_cnt")]


def hourly_sales(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.date_trunc("hour", "event_time").alias("hour_start")).agg(*sales_measures())


def category_ranking(orders: DataFrame) -> DataFrame:
    return orders.groupBy("product_category").agg(*sales_measures()).orderBy(F.desc("total_gmv"), "product_category")


def hourly_by_dimension(orders: DataFrame) -> DataFrame:
    """Hour by category by state: what a replay of the stream computes."""
    return orders.groupBy(F.date_trunc("hour", "event_time").alias("hour_start"), "product_category", "state").agg(*sales_measures())


def minute_stats(orders: DataFrame, window: str = "1 minute", by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Tumbling statistics of orders with a price of 0 or more: counts, GMV, mean, customers, commonest category.

    The same function serves batch and streams; exact distinct counts hold a window's customers in its
    state, the others are estimated.
    """
    customers = F.size(F.collect_set("customer_id")).cast("long") if exact else F.approx_count_distinct("customer_id")
    top = F.mode("product_category", True).alias("top_category")
    named = [F.count("*").alias("order_cnt"), money(F.col("price")).alias("total_gmv"), ratio(money(F.col("price")), F.count("*")).alias("avg_price"), F.count_if(canceled()).alias("cancel_cnt")]
    keys = [F.window("event_time", window).alias("w"), *(by or [])]
    out = orders.filter(F.col("price") >= 0).groupBy(*keys).agg(*named, *([] if by else [customers.alias("unique_customers"), top]))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(c for c in out.columns if c != "w"))


def daily_trend(hourly: DataFrame) -> DataFrame:
    """Days from hours, means as ratios of sums. unique_customers_sum adds up hours, it isn't a distinct count."""
    return hourly.groupBy(F.to_date("hour_start").alias("day")).agg(
        F.sum("order_cnt").alias("order_cnt"), money(F.col("total_gmv")).alias("total_gmv"), ratio(money(F.col("total_gmv")), F.sum("order_cnt")).alias("avg_price"),
        F.sum("unique_customers").alias("unique_customers_sum"), F.sum("cancel_cnt").alias("cancel_cnt"),
    )


def category_days(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy(F.to_date("hour_start").alias("day"), "product_category").agg(
        F.sum("order_cnt").alias("order_cnt"), money(F.col("total_gmv")).alias("total_gmv"), F.sum("cancel_cnt").alias("cancel_cnt"), ratio(F.sum("cancel_cnt"), F.sum("order_cnt")).alias("cancel_rate")
    )


def serving_hours(replayed: DataFrame, minutes: DataFrame) -> DataFrame:
    """Replayed hours, and realtime minutes rolled up from the hour after the last replayed one; tagged by source.

    Both sides have hour or window_start, order_cnt, total_gmv and cancel_cnt. Without replayed hours all
    minutes count.
    """
    edge = replayed.agg(F.max("hour_start").alias("edge"))  # one row
    batch = replayed.groupBy("hour_start").agg(F.sum("order_cnt").alias("order_cnt"), money(F.col("total_gmv")).alias("total_gmv"), F.sum("cancel_cnt").alias("cancel_cnt")).withColumn("source", F.lit("replay"))
    newer = minutes.join(F.broadcast(edge)).filter(F.col("edge").isNull() | (F.col("window_start") >= F.col("edge") + F.expr("INTERVAL 1 HOUR")))
    live = newer.groupBy(F.date_trunc("hour", "window_start").alias("hour_start")).agg(
        F.sum("order_cnt").alias("order_cnt"), money(F.col("total_gmv")).alias("total_gmv"), F.sum("cancel_cnt").alias("cancel_cnt")
    ).withColumn("source", F.lit("realtime"))
    return batch.unionByName(live)


def serving_totals(serving: DataFrame) -> DataFrame:
    return serving.agg(
        F.sum("order_cnt").alias("order_cnt"), money(F.col("total_gmv")).alias("total_gmv"), F.count_distinct("hour_start").alias("hours_covered"), F.min("hour_start").alias("first_hour"), F.max("hour_start").alias("last_hour")
    )


def replay_coverage(hourly: DataFrame) -> DataFrame:
    return hourly.agg(F.count("*").alias("rows"), F.min("hour_start").alias("first_hour"), F.max("hour_start").alias("last_hour"), F.sum("order_cnt").alias("order_cnt"), money(F.col("total_gmv")).alias("total_gmv"))


def state_ranks(orders: DataFrame) -> DataFrame:
    """States by GMV. The rank runs over the aggregate, a row a state."""
    gmv = orders.groupBy("state").agg(F.count_distinct("order_id").alias("order_cnt"), money(F.col("price")).alias("total_gmv"))
    return gmv.withColumn("gmv_rank", F.rank().over(Window.orderBy(F.desc("total_gmv"))))


def gmv_share(orders: DataFrame) -> DataFrame:
    gmv = orders.groupBy("product_category").agg(money(F.col("price")).alias("total_gmv"))
    return gmv.withColumn("gmv_share", ratio(F.col("total_gmv"), F.sum(F.col("total_gmv").cast("decimal(18,2)")).over(Window.partitionBy())))


def payment_types(payments: DataFrame) -> DataFrame:
    return payments.groupBy("payment_type").agg(F.count("*").alias("payment_cnt"), money(F.col("payment_value")).alias("payment_total"))


def instalment_split(payments: DataFrame) -> DataFrame:
    kind = F.when(F.col("installments") == 1, "single").otherwise("instalments").alias("kind")
    return payments.groupBy(kind).agg(F.count("*").alias("payment_cnt"), money(F.col("payment_value")).alias("payment_total"))


def cancel_rate(orders: DataFrame, by_hour: bool = False) -> DataFrame:
    keys = [F.date_trunc("hour", "event_time").alias("hour_start")] if by_hour else []
    return orders.groupBy(*keys).agg(F.count("*").alias("order_cnt"), F.count_if(canceled()).alias("cancel_cnt"), ratio(F.count_if(canceled()), F.count("*")).alias("cancel_rate"))


def category_triage(orders: DataFrame, k: int = 8) -> DataFrame:
    g = orders.groupBy("product_category").agg(F.count("*").alias("order_cnt"), ratio(money(F.col("price")), F.count("price")).alias("avg_price"), F.count_if(canceled()).alias("cancel_cnt"))
    return g.orderBy(F.desc("order_cnt"), "product_category").limit(k)


def previous_window_drop(stats: DataFrame, step: str = "1 minute", factor: float = 0.5) -> DataFrame:
    """Windows whose GMV fell under a factor of the window just before; a gap has no neighbour."""
    before = stats.select((F.col("window_start") + F.expr(f"INTERVAL {step}")).alias("window_start"), F.col("total_gmv").alias("previous_gmv"))
    return stats.join(before, "window_start").filter(F.col("total_gmv") < factor * F.col("previous_gmv")).select("window_start", "total_gmv", "previous_gmv")


def period_over_period(orders: DataFrame, base_start: Column, base_end: Column, start: Column, end: Column) -> DataFrame:
    """GMV by category in two periods; a category missing now counts as 0. One pass over both periods."""
    t = F.col("event_time")
    g = orders.filter(between(t, base_start, base_end) | between(t, start, end)).groupBy("product_category").agg(
        F.coalesce(money(F.when(between(t, base_start, base_end), F.col("price"))), F.lit(0.0)).alias("base_gmv"), F.coalesce(money(F.when(between(t, start, end), F.col("price"))), F.lit(0.0)).alias("current_gmv"),
        F.count_if(between(t, base_start, base_end)).alias("base_cnt"),
    )
    return g.filter("base_cnt > 0").withColumn("change", ratio(F.col("current_gmv") - F.col("base_gmv"), F.col("base_gmv"))).drop("base_cnt")


def two_periods(orders: DataFrame, base_start: Column, base_end: Column, start: Column, end: Column) -> DataFrame:
    """Orders, GMV, customers and cancellations of two periods, side by side in one row."""
    t, out = F.col("event_time"), []
    for name, inside in (("base", between(t, base_start, base_end)), ("current", between(t, start, end))):
        out += [
            F.count_if(inside).alias(f"{name}_orders"), F.coalesce(money(F.when(inside, F.col("price"))), F.lit(0.0)).alias(f"{name}_gmv"),
            F.count_distinct(F.when(inside, F.col("customer_id"))).alias(f"{name}_customers"), F.count_if(inside & canceled()).alias(f"{name}_canceled"),
        ]
    return orders.filter(between(t, base_start, end)).agg(*out)


def hour_and_baseline(orders: DataFrame, as_of: dt.datetime | Column, legacy_baseline: bool = False) -> DataFrame:
    """two_periods of the last hour and the same hour of the day before; the legacy baseline is the two hours around it, from 25 to 23 hours back."""
    return two_periods(orders, ago(as_of, hours=25), ago(as_of, hours=23 if legacy_baseline else 24), ago(as_of, hours=1), at(as_of))


def period_report(orders: DataFrame, alerts: DataFrame, base_start: Column, base_end: Column, start: Column, end: Column, k: int = 3) -> DataFrame:
    """Report metrics of a period against the one before: changes, order values, top categories, open alerts."""
    two = two_periods(orders, base_start, base_end, start, end)
    top = orders.filter(between(F.col("event_time"), start, end)).groupBy("product_category").agg(money(F.col("price")).alias("gmv")).orderBy(F.desc("gmv"), "product_category").limit(k)
    names = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("gmv")).alias("g"), "product_category"))), lambda x: x["product_category"]), ",").alias("top_categories"))
    open_ = alerts.filter(between(F.col("fired_at"), start, end) & (F.col("resolved") == 0)).agg(F.count("*").alias("open_alerts"))
    change = lambda a: ratio(F.col(f"current_{a}") - F.col(f"base_{a}"), F.col(f"base_{a}")).alias(f"{a}_change")
    return two.join(names).join(open_).select(  # three single rows
        "*", change("orders"), change("gmv"), ratio(F.col("current_gmv"), F.col("current_orders")).alias("current_aov"), ratio(F.col("current_canceled"), F.col("current_orders")).alias("current_cancel_rate")
    )


def job_status(jobs: DataFrame, as_of: Column, k: int = 20) -> DataFrame:
    """The newest replay jobs with seconds run so far and records a second."""
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.coalesce("finished_at", as_of))
    out = jobs.select("job_id", "status", "started_at", "processed", seconds.alias("elapsed_seconds"))
    return out.withColumn("records_per_second", ratio(F.col("processed"), F.nullif("elapsed_seconds", F.lit(0)))).orderBy(F.desc("started_at"), "job_id").limit(k)


def today_summary(orders: DataFrame, as_of: dt.datetime | Column) -> DataFrame:
    return last(orders, as_of, days=1).agg(*sales_measures())


def newest_windows(stats: DataFrame, k: int = 5) -> DataFrame:
    return stats.orderBy(F.desc("window_start")).limit(k)


def table_profile(df: DataFrame, entity: str, value: str, time: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("row_cnt"), F.count_distinct(entity).alias("entity_cnt"), ratio(money(F.col(value)), F.count(value)).alias("avg_value"), F.min(time).alias("first_time"), F.max(time).alias("last_time")
    )


def result_summary(df: DataFrame) -> DataFrame:
    """Row count, and minimum and maximum of the first two numeric columns."""
    numeric = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")][:2]
    return df.agg(F.count("*").alias("row_cnt"), *(f(c).alias(f"{n}_{c}") for c in numeric for n, f in (("min", F.min), ("max", F.max))))
