"""Queries of the feature store."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.columns import AS_OF, at
from ..operators import asof
from ..operators import features as X
from ..operators import versioned as V
from ..sources import adapters as A
from ..sources.adapters import money_sql, rounded_sql, sql
from .layers import DAY, GMV, NOW
from .registry import query

NAMES = ["amount", "items", "dwell"]
CANCELED = "count(*) FILTER (order_status = 'canceled')"
#: feature -> (SQL of the value, hours back)
VALUES = {
    ("user", "order_count_7d"): ("CAST(count(*) AS DOUBLE)", 168),
    ("user", "gmv_7d"): (GMV, 168),
    ("user", "cancel_rate_30d"): (rounded_sql(f"{CANCELED}::DOUBLE / count(*)", 4), 720),
    ("user", "avg_order_price_30d"): (rounded_sql(f"{GMV} / count(*)", 2), 720),
    ("user", "days_since_last_order"): (rounded_sql(f"date_diff('hour', max(event_time), {NOW}) / 24.0::DOUBLE", 2), 10**6),
    ("user", "order_count_1h"): ("CAST(count(*) AS DOUBLE)", 1),
    ("category", "order_volume_1h"): ("CAST(count(*) AS DOUBLE)", 1),
    ("category", "avg_price_7d"): (rounded_sql(f"{GMV} / count(*)", 2), 168),
    ("category", "cancel_rate_7d"): (rounded_sql(f"{CANCELED}::DOUBLE / count(*)", 4), 168),
    ("seller", "gmv_7d"): (GMV, 168),
    ("seller", "order_count_7d"): ("CAST(count(*) AS DOUBLE)", 168),
    ("seller", "cancel_rate_30d"): (rounded_sql(f"{CANCELED}::DOUBLE / count(*)", 4), 720),
    ("seller", "unique_buyers_30d"): ("CAST(count(DISTINCT customer_id) AS DOUBLE)", 720),
}
ENTITY = {"user": "customer_id", "category": "product_category", "seller": "seller_id"}
SHARE = f"SELECT product_category AS entity_id, 'category' AS group_name, 'gmv_share_today' AS feature_name, {rounded_sql(f'{GMV} / CAST(sum(sum(CAST(price AS DECIMAL(18,2)))) OVER () AS DOUBLE)', 4)} AS feature_value FROM order_stream WHERE {DAY} GROUP BY 1"


def feature_sql(group: str, name: str) -> str:
    value, hours = VALUES[group, name]
    return f"SELECT {ENTITY[group]} AS entity_id, '{group}' AS group_name, '{name}' AS feature_name, {value} AS feature_value FROM order_stream WHERE event_time < {NOW} AND event_time >= {NOW} - INTERVAL {hours} HOUR GROUP BY 1"


SHORT = ("entity_id", "group_name", "feature_name", "feature_value")
for number, feature in zip([1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14], X.FEATURES):

    @query(f"F{number}_{feature.group}_{feature.name}", sql("order_stream", feature_sql(feature.group, feature.name)))
    def one(spark, sf, feature=feature):
        return X.compute_group(A.order_stream(spark, sf), [feature], AS_OF).select(*SHORT)


@query("F10_category_gmv_share_today", sql("order_stream", SHARE))
def f10(spark, sf):
    return X.gmv_share_today(A.order_stream(spark, sf), AS_OF).select(*SHORT)


for number, column in ((15, "hour_of_day"), (16, "is_peak_hour"), (17, "is_weekend")):
    expression = {
        "hour_of_day": "CAST(hour(event_time) AS INT)",
        "is_peak_hour": "CASE WHEN hour(event_time) BETWEEN 9 AND 11 OR hour(event_time) BETWEEN 19 AND 22 THEN 1 ELSE 0 END",
        "is_weekend": "CASE WHEN isodow(event_time) >= 6 THEN 1 ELSE 0 END",
    }[column]

    @query(f"F{number}_temporal_{column}", sql("order_stream", f"SELECT order_id, {expression} AS {column} FROM order_stream"))
    def part(spark, sf, column=column):
        return X.temporal(A.order_stream(spark, sf), "event_time").select("order_id", column)


@query("F18_windowed_user_features", sql("order_stream", f"SELECT customer_id, date_trunc('hour', event_time) AS window_start, count(*) AS order_count, {GMV} AS gmv, {GMV} / count(price) AS avg_price, count(DISTINCT product_category) AS category_cnt, date_trunc('hour', event_time) + INTERVAL 1 HOUR AS feature_time FROM order_stream GROUP BY 1, 2"))
def f18(spark, sf):
    return X.windowed_user_features(A.order_stream(spark, sf))


@query("F19_materialize_features", sql("order_stream", " UNION ALL ".join(feature_sql(*k) for k in VALUES) + " UNION ALL " + SHARE))
def f19(spark, sf):
    return X.materialize_features(A.order_stream(spark, sf), AS_OF).select(*SHORT)


FRESH = f"""fresh AS (
    SELECT *, CASE WHEN max_staleness_seconds IS NOT NULL THEN CAST(staleness_seconds > max_staleness_seconds AS INT) END AS is_stale FROM (
        SELECT h.group_name, h.feature_name, h.last_time, c.default_value_float, c.max_staleness_seconds, c.on_breach_action, date_sub('second', last_time, {NOW}) AS staleness_seconds
        FROM (SELECT group_name, feature_name, max(feature_time) AS last_time FROM feature_history GROUP BY 1, 2) h LEFT JOIN feature_contracts c USING (group_name, feature_name)))"""


def fresh(spark, sf):
    return X.freshness(A.feature_history(spark, sf), A.feature_contracts(spark, sf), at(AS_OF))


@query("F20_freshness", sql("feature_history feature_contracts", f", {FRESH} SELECT * FROM fresh"))
def f20(spark, sf):
    return fresh(spark, sf)


@query("F21_coverage", sql("feature_history", "SELECT group_name, feature_name, count(DISTINCT entity_id) AS entity_cnt, count(*) AS record_cnt, count(*) FILTER (feature_value IS NULL OR feature_value = 0) AS empty_cnt, count(*) FILTER (feature_value IS NULL OR feature_value = 0)::DOUBLE / count(*) AS empty_rate, max(computed_at) AS last_computed FROM feature_history GROUP BY 1, 2"))
def f21(spark, sf):
    return X.coverage(A.feature_history(spark, sf))


@query("F22_breach_actions", sql("feature_history feature_contracts", f", {FRESH} SELECT group_name, feature_name, is_stale, CASE WHEN is_stale = 1 THEN on_breach_action ELSE 'serve' END AS action FROM fresh"))
def f22(spark, sf):
    return X.breach_actions(fresh(spark, sf)).select("group_name", "feature_name", "is_stale", "action")


TTL = 5 * 86400
SNAPSHOT = f"online AS (SELECT entity_id, group_name, feature_name, arg_max(feature_value, (feature_time, version)) AS feature_value, max(feature_time) AS feature_time FROM feature_history WHERE feature_time > {NOW} - INTERVAL 5 DAY GROUP BY 1, 2, 3)"


@query("F23_online_snapshot", sql("feature_history", f", {SNAPSHOT} SELECT * FROM online"))
def f23(spark, sf):
    return X.online_snapshot(A.feature_history(spark, sf), at(AS_OF), TTL)


ASKED = "SELECT CAST(c_custkey AS VARCHAR) AS entity_id FROM customer"
TIERS = f"""{SNAPSHOT},
    offline AS (SELECT entity_id, group_name, feature_name, arg_max(feature_value, (feature_time, version)) AS feature_value FROM feature_history GROUP BY 1, 2, 3),
    grid AS (SELECT entity_id, group_name, feature_name FROM ({ASKED}), (SELECT DISTINCT group_name, feature_name FROM feature_history))
    SELECT entity_id, group_name, feature_name, coalesce(n.feature_value, f.feature_value, default_value_float, 0.0::DOUBLE) AS feature_value,
        CASE WHEN n.feature_value IS NOT NULL THEN 'online' WHEN f.feature_value IS NOT NULL THEN 'offline' WHEN default_value_float IS NOT NULL THEN 'default' ELSE 'zero' END AS tier
    FROM grid LEFT JOIN online n USING (entity_id, group_name, feature_name) LEFT JOIN offline f USING (entity_id, group_name, feature_name) LEFT JOIN feature_contracts USING (group_name, feature_name)"""


def asked(spark, sf):
    return A.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"))


def tiers(spark, sf):
    h = A.feature_history(spark, sf)
    offline = V.latest_values(h, ["entity_id", "group_name", "feature_name"], "feature_value", "feature_time", "version")
    return X.tiered_read(asked(spark, sf), h.select("group_name", "feature_name").distinct(), X.online_snapshot(h, at(AS_OF), TTL), offline, A.feature_contracts(spark, sf))


@query("F24_tiered_read", sql("feature_history feature_contracts", f", {TIERS}"))
def f24(spark, sf):
    return tiers(spark, sf)


@query("J11_completeness", sql("feature_history feature_contracts", f", {TIERS.replace('SELECT entity_id, group_name, feature_name, coalesce', 'SELECT tier, count(*) AS cells FROM (SELECT entity_id, group_name, feature_name, coalesce')}) GROUP BY 1"))
def j11(spark, sf):
    return tiers(spark, sf).groupBy("tier").agg(F.count("*").alias("cells"))


@query("F25_feature_vectors", sql("feature_history", f"SELECT entity_id, count(*) AS feature_cnt, {', '.join(f"max(v) FILTER (feature_name = '{n}') AS {n}" for n in NAMES)} FROM (SELECT entity_id, feature_name, arg_max(feature_value, (feature_time, version)) AS v FROM feature_history GROUP BY 1, 2) GROUP BY 1"))
def f25(spark, sf):
    """What the maps of the entities hold."""
    h = A.feature_history(spark, sf)
    out = X.feature_vectors(V.latest_values(h, ["entity_id", "feature_name"], "feature_value", "feature_time", "version"))
    return out.select("entity_id", F.size("features").cast("long").alias("feature_cnt"), *(F.try_element_at("features", F.lit(n)).alias(n) for n in NAMES))


START, END = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)


@query("F26_labels_between", sql("feature_labels", "SELECT entity_id, event_time, label FROM feature_labels WHERE event_time >= TIMESTAMP '2024-01-10' AND event_time < TIMESTAMP '2024-01-20'"))
def f26(spark, sf):
    A.feature_labels(spark, sf).createOrReplaceTempView("lakeloom_labels")
    return X.labels_between(spark, "SELECT entity_id, event_time, label FROM lakeloom_labels WHERE event_time >= :start_time AND event_time < :end_time", START, END)


@query("F27_training_summary", sql("feature_labels", f"SELECT count(*) AS row_cnt, 3 AS feature_cnt, {rounded_sql('sum(label)::DOUBLE / count(label)', 4)} AS positive_rate, min(event_time) AS first_time, max(event_time) AS last_time FROM feature_labels"))
def f27(spark, sf):
    return X.training_summary(asof.point_in_time(A.feature_labels(spark, sf), A.feature_history(spark, sf), NAMES), NAMES)


def literal(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)


DEFINED = ", ".join("(" + ", ".join(map(literal, (f.group, f.name, f.entity, f.dtype, f.default, f.hours * 3600 if f.hours else None))) + ")" for f in X.FEATURES)
DEFINITIONS = f"defined(group_name, feature_name, entity, dtype, default_value, window_seconds) AS (VALUES {DEFINED}), counted AS (SELECT group_name, feature_name, count(*) AS entity_cnt FROM ({' UNION ALL '.join(feature_sql(*k) for k in VALUES)} UNION ALL {SHARE}) GROUP BY 1, 2)"


@query("F28_definition_rows", sql("order_stream", f", {DEFINITIONS} SELECT d.*, entity_cnt FROM defined d LEFT JOIN counted USING (group_name, feature_name)"))
def f28(spark, sf):
    """Definitions beside the number of entities that have a value now."""
    values = X.materialize_features(A.order_stream(spark, sf), AS_OF).groupBy("group_name", "feature_name").agg(F.count("*").alias("entity_cnt"))
    return X.definitions(spark).join(values, ["group_name", "feature_name"], "left")


@query("F29_user_statistics", sql("order_lines", f"SELECT customer_id, date_diff('hour', max(event_time), {NOW}) AS recency_hours, count(DISTINCT order_id) AS frequency, {GMV} AS monetary, {GMV} / count(DISTINCT order_id) AS avg_order_value, count(DISTINCT product_category) AS active_categories FROM order_lines GROUP BY 1"))
def f29(spark, sf):
    return X.user_statistics(A.order_lines(spark, sf), at(AS_OF))


def latest_sql(name: str) -> str:
    """The latest value of a feature at each label, by an as-of join in SQL."""
    return f"""(SELECT l.label_id, f.feature_value AS {name}, f.feature_time AS {name}_time FROM feature_labels l ASOF LEFT JOIN (
        SELECT entity_id, feature_time, arg_max(feature_value, version) AS feature_value FROM feature_history WHERE feature_name = '{name}' GROUP BY 1, 2) f ON l.entity_id = f.entity_id AND l.event_time >= f.feature_time)"""


@query("J1_point_in_time", sql("feature_labels feature_history", f"SELECT l.*, amount FROM feature_labels l JOIN {latest_sql('amount')} USING (label_id)"))
def j1(spark, sf):
    return asof.point_in_time(A.feature_labels(spark, sf), A.feature_history(spark, sf), ["amount"])


WIDE = "feature_labels l JOIN " + " JOIN ".join(f"{latest_sql(n)} USING (label_id)" for n in NAMES)


@query("J2_point_in_time_wide", sql("feature_labels feature_history", f"SELECT l.*, amount, items, dwell FROM {WIDE}"))
def j2(spark, sf):
    return asof.point_in_time(A.feature_labels(spark, sf), A.feature_history(spark, sf), NAMES)


@query("J3_training_set", sql("feature_labels feature_history", f"SELECT l.*, coalesce(amount, -1.0::DOUBLE) AS user__amount, items AS user__items, coalesce(dwell, 0.5::DOUBLE) AS user__dwell FROM {WIDE}"))
def j3(spark, sf):
    return asof.training_set(A.feature_labels(spark, sf), A.feature_history(spark, sf), {"user": NAMES}, {("user", "amount"): -1.0, ("user", "dwell"): 0.5})


AT = "TIMESTAMP '2024-01-15 00:00:00'"


@query("J4_values_at", sql("feature_history", f"SELECT entity_id, {', '.join(f'''arg_max(feature_value, (feature_time, version)) FILTER (feature_name = '{n}') AS {n}''' for n in NAMES)} FROM ({ASKED}) LEFT JOIN (SELECT * FROM feature_history WHERE feature_time <= {AT}) USING (entity_id) GROUP BY 1"))
def j4(spark, sf):
    return asof.values_at(A.feature_history(spark, sf), asked(spark, sf), NAMES, at(dt.datetime(2024, 1, 15)))


@query("J5_point_in_time_ttl", sql("feature_labels feature_history", f"SELECT l.*, CASE WHEN l.event_time - amount_time <= INTERVAL 1 DAY THEN amount END AS amount, CASE WHEN l.event_time - dwell_time <= INTERVAL 1 DAY THEN dwell END AS dwell FROM {WIDE}"))
def j5(spark, sf):
    return asof.point_in_time(A.feature_labels(spark, sf), A.feature_history(spark, sf), ["amount", "dwell"], ttl_seconds=86_400)


@query("J8_freshness_join", sql("feature_history feature_contracts", "SELECT group_name, count(DISTINCT feature_name) AS feature_cnt, count(DISTINCT CASE WHEN c.max_staleness_seconds IS NOT NULL THEN feature_name END) AS contract_cnt, max(computed_at) AS last_update FROM feature_history LEFT JOIN feature_contracts c USING (group_name, feature_name) GROUP BY 1"))
def j8(spark, sf):
    return X.registry_overview(A.feature_history(spark, sf), A.feature_contracts(spark, sf))


@query("A21_registry_overview", sql("feature_history", f"SELECT group_name, count(DISTINCT feature_name) AS feature_cnt, count(DISTINCT feature_name) FILTER (feature_time > {NOW} - INTERVAL 1 DAY) AS active_cnt, max(computed_at) AS last_update FROM feature_history GROUP BY 1"))
def a21(spark, sf):
    """All features of a group, and those with a value in the last day."""
    h, recent = A.feature_history(spark, sf), F.col("feature_time") > at(AS_OF) - F.expr("INTERVAL 1 DAY")
    return h.groupBy("group_name").agg(F.count_distinct("feature_name").alias("feature_cnt"), F.count_distinct(F.when(recent, F.col("feature_name"))).alias("active_cnt"), F.max("computed_at").alias("last_update"))


@query("J13_repeated_labels", sql("feature_labels feature_history", f"SELECT l.*, amount FROM (SELECT * FROM feature_labels UNION ALL SELECT * FROM feature_labels WHERE label_id % 3 = 0) l JOIN {latest_sql('amount')} USING (label_id)"))
def j13(spark, sf):
    """Labels that repeat keep a row each."""
    labels = A.feature_labels(spark, sf)
    return asof.point_in_time(labels.union(labels.filter("label_id % 3 = 0")), A.feature_history(spark, sf), ["amount"])
