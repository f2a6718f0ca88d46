"""The feature store: definitions, one-pass computation, contracts, online reads."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import ago, at, canceled, hours_apart, money, ratio, rounded


@dataclass(frozen=True)
class Feature:
    """A feature of an entity: an aggregate over the rows of the last ``hours``, null hours for all rows before as_of."""

    group: str
    name: str
    entity: str
    hours: int | None
    #: From (whether a row counts, as_of) to an aggregate.
    compute: Callable[[Column, Column], Column]
    default: float = 0.0
    dtype: str = "FLOAT64"


def _count(inside: Column, as_of: Column) -> Column:
    return F.count_if(inside).cast("double")


def _sum(inside: Column, as_of: Column) -> Column:
    return money(F.when(inside, F.col("price")))


def _avg(inside: Column, as_of: Column) -> Column:
    return rounded(ratio(money(F.when(inside, F.col("price"))), F.count_if(inside)), 2)


def _cancel(inside: Column, as_of: Column) -> Column:
    return rounded(ratio(F.count_if(inside & canceled()), F.count_if(inside)), 4)


def _buyers(inside: Column, as_of: Column) -> Column:
    return F.count_distinct(F.when(inside, F.col("customer_id"))).cast("double")


def _days_since(inside: Column, as_of: Column) -> Column:
    return rounded(hours_apart(F.max(F.when(inside, F.col("event_time"))), as_of) / 24.0, 2)


HOUR, WEEK, MONTH = 1, 7 * 24, 30 * 24
FEATURES = [
    Feature("user", "order_count_7d", "customer_id", WEEK, _count, dtype="INT64"),
    Feature("user", "gmv_7d", "customer_id", WEEK, _sum),
    Feature("user", "cancel_rate_30d", "customer_id", MONTH, _cancel),
    Feature("user", "avg_order_price_30d", "customer_id", MONTH, _avg),
    Feature("user", "days_since_last_order", "customer_id", None, _days_since, default=999.0),
    Feature("user", "order_count_1h", "customer_id", HOUR, _count, dtype="INT64"),
    Feature("category", "order_volume_1h", "product_category", HOUR, _count, dtype="INT64"),
    Feature("category", "avg_price_7d", "product_category", WEEK, _avg),
    Feature("category", "cancel_rate_7d", "product_category", WEEK, _cancel),
    Feature("seller", "gmv_7d", "seller_id", WEEK, _sum),
    Feature("seller", "order_count_7d", "seller_id", WEEK, _count, dtype="INT64"),
    Feature("seller", "cancel_rate_30d", "seller_id", MONTH, _cancel),
    Feature("seller", "unique_buyers_30d", "seller_id", MONTH, _buyers, dtype="INT64"),
]


def compute_group(orders: DataFrame, features: list[Feature], as_of: dt.datetime | Column, version: int = 1) -> DataFrame:
    """Long rows of features of one entity: one pass over the orders, one shuffle on the entity for all of them.

    An entity without rows in a feature's window has no row for it.
    """
    now, t = at(as_of), F.col("event_time")
    (entity,), (group,) = {f.entity for f in features}, {f.group for f in features}
    spans = [f.hours for f in features]
    rows = orders.filter(t < now) if None in spans else orders.filter((t < now) & (t >= ago(as_of, hours=max(spans))))
    inside = lambda f: F.lit(True) if f.hours is None else t >= ago(as_of, hours=f.hours)
    aggs = [x for n, f in enumerate(features) for x in (f.compute(inside(f), now).alias(f"v{n}"), F.count_if(inside(f)).alias(f"n{n}"))]
    wide = rows.filter(F.col(entity).isNotNull()).groupBy(F.col(entity).cast("string").alias("entity_id")).agg(*aggs)
    cells = F.array(*(F.struct(F.lit(f.name).alias("feature_name"), F.when(F.col(f"n{n}") > 0, F.col(f"v{n}")).alias("feature_value")) for n, f in enumerate(features)))
    return wide.select("entity_id", F.lit(group).alias("group_name"), F.inline(cells)).filter("feature_value IS NOT NULL").withColumns(
        {"feature_value_str": F.lit(None).cast("string"), "feature_time": now, "computed_at": now, "version": F.lit(version)}
    )


def gmv_share_today(orders: DataFrame, as_of: dt.datetime | Column) -> DataFrame:
    """category.gmv_share_today: each category's share of the last day's GMV."""
    from .layers import gmv_share, last

    share = gmv_share(last(orders, as_of, days=1))
    return share.select(
        F.col("product_category").alias("entity_id"), F.lit("category").alias("group_name"), F.lit("gmv_share_today").alias("feature_name"), rounded(F.col("gmv_share"), 4).alias("feature_value"),
        F.lit(None).cast("string").alias("feature_value_str"), at(as_of).alias("feature_time"), at(as_of).alias("computed_at"), F.lit(1).alias("version"),
    )


def temporal(times: DataFrame, time: str) -> DataFrame:
    """hour_of_day, is_peak_hour (9-11 and 19-22) and is_weekend of each time."""
    t = F.col(time)
    hour = F.hour(t)
    return times.select(
        "*", hour.alias("hour_of_day"), F.when(hour.between(9, 11) | hour.between(19, 22), 1).otherwise(0).alias("is_peak_hour"), F.when(F.weekday(t) >= 5, 1).otherwise(0).alias("is_weekend")
    )


def materialize_features(orders: DataFrame, as_of: dt.datetime | Column, groups: list[str] | None = None) -> DataFrame:
    """Long history rows of all defined features, a pass for each entity."""
    wanted = [f for f in FEATURES if not groups or f.group in groups]
    parts = [compute_group(orders, [f for f in wanted if f.group == g], as_of) for g in dict.fromkeys(f.group for f in wanted)]
    if not groups or "category" in groups:
        parts.append(gmv_share_today(orders, as_of))
    return reduce(DataFrame.unionByName, parts)


def windowed_user_features(orders: DataFrame, window: str = "1 hour") -> DataFrame:
    """Features of a customer by tumbling window; the same on a stream, with categories estimated there."""
    n = F.count("*")
    distinct = F.approx_count_distinct("product_category") if orders.isStreaming else F.count_distinct("product_category")
    amount = F.col("price") * F.col("quantity") if "quantity" in orders.columns else F.col("price")
    g = orders.groupBy("customer_id", F.window("event_time", window).alias("w")).agg(
        n.alias("order_count"), money(amount).alias("gmv"), ratio(money(F.col("price")), F.count("price")).alias("avg_price"), distinct.alias("category_cnt")
    )
    return g.select("customer_id", F.col("w.start").alias("window_start"), "order_count", "gmv", "avg_price", "category_cnt", F.col("w.end").alias("feature_time"))


def definitions(spark: SparkSession, features: list[Feature] = FEATURES) -> DataFrame:
    """The registry as rows: definitions and contracts in one."""
    rows = [(f.group, f.name, f.entity, f.dtype, f.default, f.hours * 3600 if f.hours else None) for f in features]
    return spark.createDataFrame(rows, "group_name string, feature_name string, entity string, dtype string, default_value double, window_seconds int")


def freshness(history: DataFrame, contracts: DataFrame, as_of: Column) -> DataFrame:
    """Latest time and staleness of each feature against its contract; without one is_stale is null.

    The history is aggregated before the join.
    """
    newest = history.groupBy("group_name", "feature_name").agg(F.max("feature_time").alias("last_time"))
    out = newest.join(contracts, ["group_name", "feature_name"], "left")
    age = F.floor((F.unix_micros(as_of) - F.unix_micros("last_time")) / 1_000_000)
    return out.withColumn("staleness_seconds", age).withColumn("is_stale", F.when(F.col("max_staleness_seconds").isNotNull(), F.when(F.col("staleness_seconds") > F.col("max_staleness_seconds"), 1).otherwise(0)))


def coverage(history: DataFrame) -> DataFrame:
    """Entities, records, and null or zero values of each feature."""
    empty = F.col("feature_value").isNull() | (F.col("feature_value") == 0)
    return history.groupBy("group_name", "feature_name").agg(
        F.count_distinct("entity_id").alias("entity_cnt"), F.count("*").alias("record_cnt"), F.count_if(empty).alias("empty_cnt"), ratio(F.count_if(empty), F.count("*")).alias("empty_rate"), F.max("computed_at").alias("last_computed")
    )


def breach_actions(fresh: DataFrame) -> DataFrame:
    """What the contract says of a stale feature: its action, else "serve"."""
    return fresh.withColumn("action", F.when(F.col("is_stale") == 1, F.col("on_breach_action")).otherwise("serve"))


def apply_breach(values: DataFrame, actions: DataFrame) -> DataFrame:
    """Feature rows after their contract: default value, dropped, or an error that stops the job."""
    known = values.join(actions.select("group_name", "feature_name", "action", "default_value_float"), ["group_name", "feature_name"], "left")
    stop = F.when(F.col("action") == "raise_error", F.raise_error(F.concat(F.lit("stale feature "), F.col("feature_name"))).cast("double"))
    value = F.when(F.col("action") == "use_default", F.col("default_value_float")).otherwise(F.coalesce(stop, F.col("feature_value")))
    return known.filter(F.coalesce(F.col("action"), F.lit("serve")) != "skip_feature").withColumn("feature_value", value).drop("action", "default_value_float")


def online_snapshot(history: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    """Latest value of each (entity, feature) that is within its time to live: what the online store holds."""
    from .versioned import latest_values, retained

    return latest_values(retained(history, "feature_time", ttl_seconds, as_of), ["entity_id", "group_name", "feature_name"], "feature_value", "feature_time", "version")


MAX_FEATURES = 10_000


def tiered_read(entities: DataFrame, features: DataFrame, online: DataFrame, offline: DataFrame, contracts: DataFrame) -> DataFrame:
    """A value for each asked (entity, feature): online, else latest offline, else the contract's default, else 0.

    The grid is what was asked for: entities times a list of features, which may have up to MAX_FEATURES names.
    """
    names = features.select("group_name", "feature_name").distinct().limit(MAX_FEATURES + 1).collect()
    if len(names) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features are asked for")
    kind = "array<struct<group_name: string, feature_name: string>>"
    asked = F.array(*(F.struct(F.lit(r.group_name).alias("group_name"), F.lit(r.feature_name).alias("feature_name")) for r in sorted(names))).cast(kind)
    grid = entities.select("entity_id").distinct().select("entity_id", F.inline(asked))
    keys = ["entity_id", "group_name", "feature_name"]
    out = grid.join(online.select(*keys, F.col("feature_value").alias("_on")), keys, "left").join(offline.select(*keys, F.col("feature_value").alias("_off")), keys, "left")
    out = out.join(contracts.select("group_name", "feature_name", F.col("default_value_float").alias("_def")), ["group_name", "feature_name"], "left")
    tier = F.when(F.col("_on").isNotNull(), "online").when(F.col("_off").isNotNull(), "offline").when(F.col("_def").isNotNull(), "default").otherwise("zero")
    return out.select(*keys, F.coalesce("_on", "_off", "_def", F.lit(0.0)).alias("feature_value"), tier.alias("tier"))


def feature_vectors(values: DataFrame) -> DataFrame:
    """entity -> map of feature names to values."""
    return values.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("feature_name", "feature_value")))).alias("features"))


def labels_between(spark: SparkSession, template: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Labels of an SQL text with the parameters :start_time and :end_time."""
    return spark.sql(template, args={"start_time": start, "end_time": end})


def training_summary(rows: DataFrame, features: list[str], label: str = "label", time: str = "event_time") -> DataFrame:
    return rows.agg(F.count("*").alias("row_cnt"), F.lit(len(features)).alias("feature_cnt"), rounded(ratio(F.sum(label), F.count(label)), 4).alias("positive_rate"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def user_statistics(orders: DataFrame, as_of: Column) -> DataFrame:
    """Recency, frequency, monetary value, order value and active categories of each customer.

    Fields on refunds, ratings, page views and conversion have no source data.
    """
    return orders.groupBy("customer_id").agg(
        hours_apart(F.max("event_time"), as_of).alias("recency_hours"), F.count_distinct("order_id").alias("frequency"), money(F.col("price")).alias("monetary"),
        ratio(money(F.col("price")), F.count_distinct("order_id")).alias("avg_order_value"), F.count_distinct("product_category").alias("active_categories"),
    )


def seller_statistics(orders: DataFrame, as_of: Column) -> DataFrame:
    """GMV and orders of each seller's last seven days, and the products they have sold; refunds and ratings have no source data."""
    recent = F.col("event_time") >= ago(as_of, days=7)
    return orders.filter(F.col("event_time") < as_of).groupBy("seller_id").agg(
        F.coalesce(F.sum(F.when(recent, F.col("price").cast("decimal(18,2)"))).cast("double"), F.lit(0.0)).alias("gmv_7d"),
        F.count_distinct(F.when(recent, F.col("order_id"))).alias("order_cnt_7d"), F.count_distinct("product_id").alias("sku_cnt"),
    )


def category_statistics(orders: DataFrame, as_of: Column, share: float = 0.8, buckets: int = 64) -> DataFrame:
    """Mean price of each category, and how many of its sellers, the largest first, make up so much of its GMV.

    Sellers are summed first. Their running sum has two levels: a category's sellers are dealt into buckets by the logarithm of
    their GMV, buckets are summed in order, and the running sum inside a bucket starts from those above it; so a category of
    very many sellers isn't sorted by one task. Views and conversion have no source data.
    """
    gmv = F.sum(F.col("price").cast("decimal(18,2)"))
    sellers = orders.filter(F.col("event_time") < as_of).groupBy("product_category", "seller_id").agg(F.coalesce(gmv, F.lit(0).cast("decimal(28,2)")).alias("gmv"), F.count("price").alias("n"))
    # larger sums have smaller buckets; equal sums share one
    bucket = F.greatest(F.lit(0), F.lit(buckets) - F.floor(F.log2(F.greatest(F.col("gmv").cast("double"), F.lit(0.0)) + 1) * 2).cast("int"))
    sellers = sellers.withColumn("bucket", bucket)
    sums = sellers.groupBy("product_category", "bucket").agg(F.sum("gmv").alias("sum"))
    of = Window.partitionBy("product_category")
    sums = sums.withColumns({"total": F.sum("sum").over(of), "before": F.coalesce(F.sum("sum").over(of.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}).drop("sum")
    same = F.col("s.product_category").eqNullSafe(F.col("b.product_category")) & (F.col("s.bucket") == F.col("b.bucket"))
    placed = sellers.alias("s").join(sums.alias("b"), same).select("s.*", "b.total", "b.before")
    inside = F.sum("gmv").over(Window.partitionBy("product_category", "bucket").orderBy(F.desc("gmv"), "seller_id").rowsBetween(Window.unboundedPreceding, 0))
    top = placed.withColumn("above", F.col("before") + inside - F.col("gmv"))
    return top.groupBy("product_category").agg(ratio(F.sum("gmv").cast("double"), F.sum("n")).alias("avg_price"), F.count_if(F.col("above") < F.lit(share).cast("decimal(4,3)") * F.col("total")).alias("top_seller_cnt"))


def registry_overview(history: DataFrame, contracts: DataFrame) -> DataFrame:
    """Features of each group: all, those under contract, and the last update."""
    names = history.groupBy("group_name", "feature_name").agg(F.max("computed_at").alias("t")).join(contracts.select("group_name", "feature_name", F.lit(1).alias("c")), ["group_name", "feature_name"], "left")
    return names.groupBy("group_name").agg(F.count("*").alias("feature_cnt"), F.count("c").alias("contract_cnt"), F.max("t").alias("last_update"))
