"""Queries of data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import AS_OF, at
from ..operators import quality as Q
from ..sources import adapters as A
from ..sources.adapters import rounded_sql, sql
from .layers import NOW
from .registry import query

#: The checks in SQL; only the regular expression's function has another name.
CHECKS = [(f, i, c.replace("regexp_like", "regexp_matches")) for f, i, c in Q.CHECKS]
COUNTS = ", ".join(f"count(*) FILTER ({c}) AS {f}_{i}" for f, i, c in CHECKS)
ISSUES = "found AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, '{i}' AS issue, count(*) FILTER ({c}) AS cnt, {rounded_sql(f'count(*) FILTER ({c})::DOUBLE / count(*)', 6)} AS rate FROM dirty_orders" for f, i, c in CHECKS
) + ") WHERE cnt > 0)"
SCORE = f"score AS (SELECT count(*) AS issue_cnt, {rounded_sql('greatest(100.0::DOUBLE - 15.0::DOUBLE * count(DISTINCT field) - coalesce(CAST(sum(CAST(least(rate * 100, 20.0) AS DECIMAL(18,6))) AS DOUBLE), 0), 0)', 1)} AS quality_score FROM found)"


@query("A23_profile", sql("dirty_orders", f"SELECT count(*) AS total, {COUNTS}, count(DISTINCT order_id) AS distinct_orders, min(price) AS min_price, max(price) AS max_price FROM dirty_orders"))
def a23(spark, sf):
    return Q.profile(A.dirty_orders(spark, sf))


@query("A24_duplicate_keys", "SELECT count(*) AS duplicate_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in_them FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def a24(spark, sf):
    return Q.duplicate_keys(A.lines(spark, sf), ["l_orderkey", "l_linenumber"])


@query("Q1_issues", sql("dirty_orders", f", {ISSUES} SELECT * FROM found"))
def q1(spark, sf):
    return Q.issues(Q.profile(A.dirty_orders(spark, sf)))


@query("Q2_quality_score", sql("dirty_orders", f", {ISSUES}, {SCORE} SELECT * FROM score"))
def q2(spark, sf):
    return Q.quality_score(Q.issues(Q.profile(A.dirty_orders(spark, sf))))


STATUSES = f"order_status NOT IN {Q.KNOWN_STATUSES}"
HIT = f"price < 0 OR price > 3000 OR product_category = '' OR {STATUSES} OR state IS NULL"
FIXED = f"""SELECT * REPLACE (CASE WHEN price < 0 THEN abs(price) WHEN price > 3000 THEN 3000.0::DOUBLE ELSE price END AS price,
    CASE WHEN product_category = '' THEN 'unknown' ELSE product_category END AS product_category, CASE WHEN {STATUSES} THEN 'created' ELSE order_status END AS order_status, coalesce(state, 'NA') AS state)
    FROM dirty_orders WHERE {HIT}"""


@query("Q3_repair", sql("dirty_orders", FIXED))
def q3(spark, sf):
    return Q.repair(A.dirty_orders(spark, sf))


@query("Q4_rule_hits", sql("dirty_orders", " UNION ALL ".join(f"SELECT '{r[0]}' AS rule_id, '{r[1]}' AS field_name, count(*) FILTER ({r[2]}) AS hits FROM dirty_orders" for r in Q.RULES if r[1] not in Q.READ_ONLY)))
def q4(spark, sf):
    return Q.rule_hits(A.dirty_orders(spark, sf))


@query("Q5_rule_catalogue", sql("dirty_orders", "SELECT rule_id, field_name, hits > 0 AS is_needed FROM (" + " UNION ALL ".join(f"SELECT '{r[0]}' AS rule_id, '{r[1]}' AS field_name, count(*) FILTER ({r[2]}) AS hits FROM dirty_orders" for r in Q.RULES if r[1] not in Q.READ_ONLY) + ")"))
def q5(spark, sf):
    """The catalogue's usable rules, and whether the data needs them."""
    hits = Q.rule_hits(A.dirty_orders(spark, sf))
    return Q.rules(spark).join(hits, ["rule_id", "field_name"]).select("rule_id", "field_name", (F.col("hits") > 0).alias("is_needed"))


@query("Q6_audit", sql("dirty_orders", f", {ISSUES}, {SCORE} SELECT (SELECT count(*) FROM dirty_orders) AS scanned, score.*, (SELECT count(*) FROM dirty_orders WHERE {HIT}) AS fixed, 5 AS rules FROM score"))
def q6(spark, sf):
    return Q.audit(A.dirty_orders(spark, sf))


GATE = """g AS (SELECT time_bucket(INTERVAL 6 HOUR, event_time) AS window_start, count(*) AS n, count(*) FILTER (order_status = 'canceled') AS c, max(price) AS p FROM dirty_orders GROUP BY 1)
    SELECT window_start, 'HIGH' AS severity, 'cancel_rate' AS metric_name, c::DOUBLE / n AS value FROM g WHERE n > 5 AND c::DOUBLE / n > 0.15
    UNION ALL SELECT window_start, 'MEDIUM', 'max_price', p FROM g WHERE p > 3000"""


@query("Q7_window_gate", sql("dirty_orders", f", {GATE}"))
def q7(spark, sf):
    """Six-hour windows, as the events are sparse."""
    return Q.window_gate(A.dirty_orders(spark, sf), "6 hours")


FRESH = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_cnt, max({t}) AS last_time, date_sub('second', max({t}), {NOW}) AS age_seconds, {limit} AS limit_seconds, CASE WHEN date_sub('second', max({t}), {NOW}) <= {limit} THEN 1 ELSE 0 END AS is_fresh FROM {n}"
    for n, t, limit in (("order_stream", "event_time", 300), ("payments", "event_time", 86400), ("consumer_lag", "check_time", 60))
)


def fresh(spark, sf):
    tables = {"order_stream": (A.order_stream(spark, sf), "event_time", 300), "payments": (A.payments(spark, sf), "event_time", 86400), "consumer_lag": (A.consumer_lag(spark, sf), "check_time", 60)}
    return Q.table_freshness(tables, at(AS_OF))


@query("Q8_table_freshness", sql("order_stream payments consumer_lag", FRESH))
def q8(spark, sf):
    return fresh(spark, sf)


@query("Q9_table_health", sql("order_stream payments consumer_lag", f"SELECT table_name, row_cnt, age_seconds, CASE WHEN row_cnt = 0 THEN 'down' WHEN age_seconds > 3600 THEN 'degraded' ELSE 'healthy' END AS health FROM ({FRESH})"))
def q9(spark, sf):
    return Q.table_health(fresh(spark, sf))
