"""Data quality: profile, issues, score, rule-driven repair, window gates, freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import canceled, ratio, rounded
from .layers import KNOWN_STATUSES

#: Columns that a repair never rewrites.
READ_ONLY = frozenset({"order_id", "event_time", "_kafka_offset"})
#: (field, issue, condition) of each counter; every condition is true or false, never null.
CHECKS = [
    ("price", "negative", "coalesce(price < 0, false)"),
    ("price", "null", "price IS NULL"),
    ("price", "extreme", "coalesce(price > 3000, false)"),
    ("freight_value", "negative", "coalesce(freight_value < 0, false)"),
    ("product_category", "blank", "coalesce(product_category, '') = ''"),
    ("order_status", "invalid", "coalesce(order_status NOT IN ({}), true)".format(", ".join(f"'{s}'" for s in KNOWN_STATUSES))),
    ("customer_id", "format", r"NOT coalesce(regexp_like(customer_id, '^C[0-9]{5}$'), false)"),
    ("seller_id", "format", r"NOT coalesce(regexp_like(seller_id, '^S[0-9]{4}$'), false)"),
    ("state", "null", "state IS NULL"),
]
#: Rules in place of a generator: (rule_id, field, condition, transform, priority), low priority first.
RULES = [
    ("r1", "price", "price < 0", "abs(price)", 1),
    ("r2", "price", "price > 3000", "CAST(3000.0 AS DOUBLE)", 2),
    ("r3", "product_category", "product_category = ''", "'unknown'", 1),
    ("r4", "order_status", "order_status NOT IN ({})".format(", ".join(f"'{s}'" for s in KNOWN_STATUSES)), "'created'", 1),
    ("r5", "state", "state IS NULL", "'NA'", 1),
    ("r6", "order_id", "order_id = ''", "'none'", 1),
]


def profile(orders: DataFrame) -> DataFrame:
    """All counters in one pass, one row: total, each check, distinct orders, price extremes."""
    counters = [F.count_if(F.expr(c)).alias(f"{field}_{issue}") for field, issue, c in CHECKS]
    return orders.agg(F.count("*").alias("total"), *counters, F.count_distinct("order_id").alias("distinct_orders"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("duplicate_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_them"))


def issues(profiled: DataFrame) -> DataFrame:
    """A row for each issue that occurs: field, issue, rows, rate."""
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(i).alias("issue"), F.col(f"{f}_{i}").alias("cnt")) for f, i, _ in CHECKS))
    return profiled.select("total", F.inline(cells)).filter("cnt > 0").select("field", "issue", "cnt", rounded(ratio(F.col("cnt"), F.col("total")), 6).alias("rate"))


def quality_score(found: DataFrame) -> DataFrame:
    """100, less 15 for each field with an issue, less up to 20 for each issue's rate in percent; 0 or more."""
    loss = F.sum(F.least(F.col("rate") * 100, F.lit(20.0)).cast("decimal(18,6)")).cast("double")
    score = F.lit(100.0) - 15.0 * F.count_distinct("field") - F.coalesce(loss, F.lit(0.0))
    return found.agg(F.count("*").alias("issue_cnt"), rounded(F.greatest(score, F.lit(0.0)), 1).alias("quality_score"))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, field_name string, condition_sql string, transform_expr string, priority int")


def usable_rules(columns: list[str], catalogue: list[tuple] = RULES) -> list[tuple]:
    return [r for r in sorted(catalogue, key=lambda r: (r[4], r[0])) if r[1] in columns and r[1] not in READ_ONLY]


def repair(orders: DataFrame, catalogue: list[tuple] = RULES) -> DataFrame:
    """Rows that a rule hits, rewritten: for each field its first rule by priority whose condition holds."""
    wanted = usable_rules(orders.columns, catalogue)
    if not wanted:
        return orders.limit(0)
    new: dict[str, Column] = {}
    for field in dict.fromkeys(r[1] for r in wanted):
        own = [r for r in wanted if r[1] == field]
        value = F.when(F.expr(own[0][2]), F.expr(own[0][3]))
        for r in own[1:]:
            value = value.when(F.expr(r[2]), F.expr(r[3]))
        new[field] = value.otherwise(F.col(field))
    hit = reduce(Column.__or__, (F.coalesce(F.expr(r[2]), F.lit(False)) for r in wanted))
    return orders.filter(hit).withColumns(new)


def rule_hits(orders: DataFrame, catalogue: list[tuple] = RULES) -> DataFrame:
    """Rows that each rule's condition matches, all counted in one pass."""
    wanted = usable_rules(orders.columns, catalogue)
    counted = orders.agg(*(F.count_if(F.expr(r[2])).alias(r[0]) for r in wanted))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(r[0]).alias("rule_id"), F.lit(r[1]).alias("field_name"), F.col(r[0]).alias("hits")) for r in wanted))))


def audit(orders: DataFrame, catalogue: list[tuple] = RULES) -> DataFrame:
    """One row on a run: rows scanned, issues, rules, rows fixed, score."""
    found = issues(profile(orders))
    fixed = repair(orders, catalogue).agg(F.count("*").alias("fixed"))
    return orders.agg(F.count("*").alias("scanned")).join(quality_score(found)).join(fixed).withColumn("rules", F.lit(len(usable_rules(orders.columns, catalogue))))  # single rows


def window_gate(orders: DataFrame, window: str = "1 minute", min_orders: int = 5, max_rate: float = 0.15, max_price: float = 3000.0) -> DataFrame:
    """Alert rows of tumbling windows: many cancellations (HIGH), an extreme price (MEDIUM)."""
    g = orders.groupBy(F.window("event_time", window).alias("w")).agg(F.count("*").alias("n"), F.count_if(canceled()).alias("c"), F.max("price").alias("p"))
    rate = ratio(F.col("c"), F.col("n"))
    cells = F.array(
        F.when((F.col("n") > min_orders) & (rate > max_rate), F.struct(F.lit("HIGH").alias("severity"), F.lit("cancel_rate").alias("metric_name"), rate.alias("value"))),
        F.when(F.col("p") > max_price, F.struct(F.lit("MEDIUM").alias("severity"), F.lit("max_price").alias("metric_name"), F.col("p").alias("value"))),
    )
    return g.select(F.col("w.start").alias("window_start"), F.inline(F.array_compact(cells)))


def table_freshness(tables: dict[str, tuple[DataFrame, str, int]], as_of: Column) -> DataFrame:
    """tables: name -> (rows, time column, allowed seconds). One aggregate a table."""
    def one(name: str, df: DataFrame, time: str, limit: int) -> DataFrame:
        age = F.floor((F.unix_micros(as_of) - F.unix_micros(F.max(time))) / 1_000_000)
        return df.agg(F.count("*").alias("row_cnt"), F.max(time).alias("last_time"), age.alias("age_seconds")).select(F.lit(name).alias("table_name"), "*", F.lit(limit).alias("limit_seconds"))

    out = reduce(DataFrame.unionByName, (one(n, *v) for n, v in tables.items()))
    return out.withColumn("is_fresh", F.when(F.col("age_seconds") <= F.col("limit_seconds"), 1).otherwise(0))


def table_health(fresh: DataFrame, degraded_seconds: int = 3600) -> DataFrame:
    """Empty tables are down, older ones than a limit degraded."""
    state = F.when(F.col("row_cnt") == 0, "down").when(F.col("age_seconds") > degraded_seconds, "degraded").otherwise("healthy")
    return fresh.select("table_name", "row_cnt", "age_seconds", state.alias("health"))
