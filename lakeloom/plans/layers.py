"""Queries of the warehouse layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import AS_OF, ago, at
from ..operators import layers as L
from ..operators import versioned as V
from ..sources import adapters as A
from ..sources import landing
from ..sources.adapters import money_sql, rounded_sql, sql
from .registry import query

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
DAY = "event_time >= TIMESTAMP '2024-01-30 00:00:00' AND event_time < TIMESTAMP '2024-01-31 00:00:00'"
GMV = money_sql("price")
SALES = f"count(DISTINCT order_id) AS order_cnt, {GMV} AS total_gmv, {GMV} / count(price) AS avg_price, count(DISTINCT customer_id) AS unique_customers, count(*) FILTER (order_status = 'canceled') AS cancel_cnt"
HOURLY = f"hourly AS (SELECT date_trunc('hour', event_time) AS hour_start, product_category, state, {SALES} FROM order_stream GROUP BY 1, 2, 3)"


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order stream as JSON texts, with broken texts, bad times and negative prices among them."""
    o, n = A.order_stream(spark, sf_dir), F.col("_kafka_offset")
    o = o.withColumn("price", F.when(n % 50 == 0, -F.col("price")).otherwise(F.col("price")))
    o = o.withColumn("event_time", F.when(n % 41 == 0, "soon").otherwise(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")))
    return o.select(F.when(n % 97 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(*o.columns))).alias("value"))


def raw_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments as JSON texts; every fiftieth is below zero, whatever it was, and some texts are broken."""
    p, n = A.payments(spark, sf_dir), F.col("payment_id").cast("long")
    p = p.withColumn("payment_value", F.when(n % 50 == 0, -1 - F.col("payment_value")).otherwise(F.col("payment_value"))).withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"))
    return p.select(F.when(n % 97 == 0, F.lit("[1")).otherwise(F.to_json(F.struct(*p.columns))).alias("value"))


@query("S3_land_orders", sql("order_stream", "SELECT * REPLACE (date_trunc('second', event_time) AS event_time), CAST(event_time AS DATE) AS _load_date FROM order_stream WHERE _kafka_offset % 97 <> 0 AND _kafka_offset % 41 <> 0 AND (_kafka_offset % 50 <> 0 OR price = 0)"))
def s3(spark, sf):
    return landing.land_orders(landing.parsed(raw_orders(spark, sf), landing.ORDER_JSON, "order_id"))


@query("S4_land_payments", sql("payments", "SELECT * REPLACE (date_trunc('second', event_time) AS event_time) FROM payments WHERE CAST(payment_id AS BIGINT) % 97 <> 0 AND CAST(payment_id AS BIGINT) % 50 <> 0"))
def s4(spark, sf):
    return landing.land_payments(landing.parsed(raw_payments(spark, sf), landing.PAYMENT_JSON, "payment_id"))


@query("P1_order_detail", sql("order_stream", f"SELECT *, {rounded_sql('price + freight_value', 2)} AS total_amount, CAST(event_time AS DATE) AS event_date, CAST(hour(event_time) AS INT) AS event_hour, CASE WHEN order_status = 'delivered' THEN 1 ELSE 0 END AS is_paid FROM order_stream"))
def p1(spark, sf):
    return L.order_detail(A.order_stream(spark, sf))


@query("P2_last_hours", sql("order_stream", f"SELECT order_id, event_time FROM order_stream WHERE event_time >= {NOW} - INTERVAL 6 HOUR AND event_time < {NOW}"))
def p2(spark, sf):
    return L.last(A.order_stream(spark, sf), AS_OF, hours=6).select("order_id", "event_time")


@query("P3_prior_period", sql("order_stream", f"SELECT order_id, event_time FROM order_stream WHERE event_time >= {NOW} - INTERVAL 25 HOUR AND event_time < {NOW} - INTERVAL 24 HOUR"))
def p3(spark, sf):
    return L.prior(A.order_stream(spark, sf), AS_OF, 25, 24).select("order_id", "event_time")


@query("P4_unknown_status", sql("dirty_orders", f"SELECT order_id, order_status FROM dirty_orders WHERE order_status IS NULL OR order_status NOT IN {L.KNOWN_STATUSES}"))
def p4(spark, sf):
    s = F.col("order_status")
    return A.dirty_orders(spark, sf).filter(s.isNull() | ~s.isin(*L.KNOWN_STATUSES)).select("order_id", "order_status")


@query("P5_id_formats", sql("dirty_orders", r"SELECT count(*) FILTER (NOT regexp_matches(customer_id, '^C\d{5}$')) AS bad_customers, count(*) FILTER (NOT regexp_matches(seller_id, '^S\d{4}$')) AS bad_sellers FROM dirty_orders"))
def p5(spark, sf):
    return A.dirty_orders(spark, sf).agg(F.count_if(~F.col("customer_id").rlike(r"^C\d{5}$")).alias("bad_customers"), F.count_if(~F.col("seller_id").rlike(r"^S\d{4}$")).alias("bad_sellers"))


@query("P6_feature_lookup", sql("feature_history", "SELECT entity_id, feature_name, feature_value, feature_time, version FROM feature_history WHERE entity_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) AND feature_name IN ('amount', 'dwell')"))
def p6(spark, sf):
    """Entities from a table, so a semi join; features from a list."""
    wanted = A.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"))
    return A.feature_history(spark, sf).filter(F.col("feature_name").isin("amount", "dwell")).join(wanted, "entity_id", "left_semi").select("entity_id", "feature_name", "feature_value", "feature_time", "version")


@query("J6_order_payment", sql("order_stream payments", "SELECT o.*, coalesce(p.payment_type, '') AS payment_type, coalesce(p.payment_value, 0.0::DOUBLE) AS payment_value FROM order_stream o LEFT JOIN payments p USING (order_id)"))
def j6(spark, sf):
    return L.with_payment(A.order_stream(spark, sf), A.payments(spark, sf))


@query("A1_hourly_sales", sql("order_stream", f"SELECT date_trunc('hour', event_time) AS hour_start, {SALES} FROM order_stream WHERE {DAY} GROUP BY 1"))
def a1(spark, sf):
    return L.hourly_sales(L.last(A.order_stream(spark, sf), AS_OF, days=1)).orderBy("hour_start")


@query("A2_category_ranking", sql("order_stream", f"SELECT product_category, {SALES} FROM order_stream WHERE {DAY} GROUP BY 1"))
def a2(spark, sf):
    return L.category_ranking(L.last(A.order_stream(spark, sf), AS_OF, days=1))


@query("A2_category_ranking_lines", sql("order_lines", f"SELECT product_category, {SALES} FROM order_lines GROUP BY 1"))
def a2_lines(spark, sf):
    return L.category_ranking(A.order_lines(spark, sf))


@query("A3_hour_category_state", sql("order_stream", f", {HOURLY} SELECT * FROM hourly"))
def a3(spark, sf):
    return L.hourly_by_dimension(A.order_stream(spark, sf))


@query("A4_daily_trend", sql("order_stream", f", {HOURLY} SELECT CAST(hour_start AS DATE) AS day, CAST(sum(order_cnt) AS BIGINT) AS order_cnt, {money_sql('total_gmv')} AS total_gmv, {money_sql('total_gmv')} / sum(order_cnt) AS avg_price, CAST(sum(unique_customers) AS BIGINT) AS unique_customers_sum, CAST(sum(cancel_cnt) AS BIGINT) AS cancel_cnt FROM hourly GROUP BY 1"))
def a4(spark, sf):
    return L.daily_trend(L.hourly_by_dimension(A.order_stream(spark, sf)))


@query("A5_category_days", sql("order_stream", f", {HOURLY} SELECT CAST(hour_start AS DATE) AS day, product_category, CAST(sum(order_cnt) AS BIGINT) AS order_cnt, {money_sql('total_gmv')} AS total_gmv, CAST(sum(cancel_cnt) AS BIGINT) AS cancel_cnt, sum(cancel_cnt)::DOUBLE / sum(order_cnt) AS cancel_rate FROM hourly GROUP BY 1, 2"))
def a5(spark, sf):
    return L.category_days(L.hourly_by_dimension(A.order_stream(spark, sf)))


def serving(spark, sf):
    """Hours replayed up to two days before the end, minutes for all of the stream."""
    orders = A.order_stream(spark, sf)
    return L.serving_hours(L.hourly_by_dimension(orders.filter(F.col("event_time") < ago(AS_OF, days=2))), L.minute_stats(orders))


SERVING = f"""serving AS (
    SELECT date_trunc('hour', event_time) AS hour_start, count(*) AS order_cnt, {GMV} AS total_gmv, count(*) FILTER (order_status = 'canceled') AS cancel_cnt,
        CASE WHEN event_time < {NOW} - INTERVAL 2 DAY THEN 'replay' ELSE 'realtime' END AS source FROM order_stream GROUP BY 1, 5)"""


@query("U1_serving_hours", sql("order_stream", f", {SERVING} SELECT * FROM serving"))
def u1(spark, sf):
    return serving(spark, sf)


@query("A6_serving_totals", sql("order_stream", f", {SERVING} SELECT CAST(sum(order_cnt) AS BIGINT) AS order_cnt, {money_sql('total_gmv')} AS total_gmv, count(DISTINCT hour_start) AS hours_covered, min(hour_start) AS first_hour, max(hour_start) AS last_hour FROM serving"))
def a6(spark, sf):
    return L.serving_totals(serving(spark, sf))


@query("A7_replay_coverage", sql("order_stream", f", {HOURLY} SELECT count(*) AS rows, min(hour_start) AS first_hour, max(hour_start) AS last_hour, CAST(sum(order_cnt) AS BIGINT) AS order_cnt, {money_sql('total_gmv')} AS total_gmv FROM hourly"))
def a7(spark, sf):
    return L.replay_coverage(L.hourly_by_dimension(A.order_stream(spark, sf)))


def report_sql(start: str, base: str) -> str:
    inside, before = f"event_time >= {start} AND event_time < {NOW}", f"event_time >= {base} AND event_time < {start}"
    part = lambda n, w: f"count(*) FILTER ({w}) AS {n}_orders, coalesce({GMV} FILTER ({w}), 0) AS {n}_gmv, count(DISTINCT customer_id) FILTER ({w}) AS {n}_customers, count(*) FILTER ({w} AND order_status = 'canceled') AS {n}_canceled".replace(f"{GMV} FILTER ({w})", f"CAST(sum(CAST(price AS DECIMAL(18,2))) FILTER ({w}) AS DOUBLE)")
    return f""", two AS (SELECT {part('base', before)}, {part('current', inside)} FROM order_stream),
    top AS (SELECT product_category, {GMV} AS gmv FROM order_stream WHERE {inside} GROUP BY 1 ORDER BY gmv DESC, product_category LIMIT 3)
    SELECT *, (SELECT string_agg(product_category, ',' ORDER BY gmv DESC, product_category) FROM top) AS top_categories,
        (SELECT count(*) FROM alert_events WHERE fired_at >= {start} AND fired_at < {NOW} AND resolved = 0) AS open_alerts,
        (current_orders - base_orders)::DOUBLE / nullif(base_orders, 0) AS orders_change, (current_gmv - base_gmv) / nullif(base_gmv, 0) AS gmv_change,
        current_gmv / nullif(current_orders, 0) AS current_aov, current_canceled::DOUBLE / nullif(current_orders, 0) AS current_cancel_rate FROM two"""


@query("A8_daily_report", sql("order_stream alert_events", report_sql(f"({NOW} - INTERVAL 1 DAY)", f"({NOW} - INTERVAL 2 DAY)")))
def a8(spark, sf):
    return L.period_report(A.order_stream(spark, sf), A.alert_events(spark, sf), ago(AS_OF, days=2), ago(AS_OF, days=1), ago(AS_OF, days=1), at(AS_OF))


@query("A9_weekly_report", sql("order_stream alert_events", report_sql(f"date_trunc('week', {NOW})", f"(date_trunc('week', {NOW}) - INTERVAL 7 DAY)")))
def a9(spark, sf):
    monday = F.date_trunc("week", at(AS_OF))
    return L.period_report(A.order_stream(spark, sf), A.alert_events(spark, sf), ago(monday, days=7), monday, monday, at(AS_OF))


@query("A10_payment_types", sql("payments", f"SELECT payment_type, count(*) AS payment_cnt, {money_sql('payment_value')} AS payment_total FROM payments GROUP BY 1"))
def a10(spark, sf):
    return L.payment_types(A.payments(spark, sf))


@query("A11_instalment_split", sql("payments", f"SELECT CASE WHEN installments = 1 THEN 'single' ELSE 'instalments' END AS kind, count(*) AS payment_cnt, {money_sql('payment_value')} AS payment_total FROM payments GROUP BY 1"))
def a11(spark, sf):
    return L.instalment_split(A.payments(spark, sf))


RATE = "count(*) AS order_cnt, count(*) FILTER (order_status = 'canceled') AS cancel_cnt, count(*) FILTER (order_status = 'canceled')::DOUBLE / nullif(count(*), 0) AS cancel_rate"


@query("A12_cancel_rate", sql("order_stream", f"SELECT {RATE} FROM order_stream WHERE event_time >= {NOW} - INTERVAL 180 MINUTE AND event_time < {NOW}"))
def a12(spark, sf):
    return L.cancel_rate(L.last(A.order_stream(spark, sf), AS_OF, minutes=180))


@query("A12_cancel_rate_by_hour", sql("order_stream", f"SELECT date_trunc('hour', event_time) AS hour_start, {RATE} FROM order_stream GROUP BY 1"))
def a12h(spark, sf):
    return L.cancel_rate(A.order_stream(spark, sf), by_hour=True)


@query("A13_category_triage", sql("order_lines", f"SELECT product_category, count(*) AS order_cnt, {GMV} / count(price) AS avg_price, count(*) FILTER (order_status = 'canceled') AS cancel_cnt FROM order_lines GROUP BY 1 ORDER BY order_cnt DESC, product_category LIMIT 8"))
def a13(spark, sf):
    return L.category_triage(A.order_lines(spark, sf))


@query("A26_today_summary", sql("order_stream", f"SELECT {SALES} FROM order_stream WHERE {DAY}"))
def a26(spark, sf):
    return L.today_summary(A.order_stream(spark, sf), AS_OF)


STATS = f"SELECT time_bucket(INTERVAL 1 MINUTE, event_time) AS window_start, time_bucket(INTERVAL 1 MINUTE, event_time) + INTERVAL 1 MINUTE AS window_end, count(*) AS order_cnt, {GMV} AS total_gmv, {GMV} / count(*) AS avg_price, count(*) FILTER (order_status = 'canceled') AS cancel_cnt"


@query("A26_newest_windows", sql("order_stream", f"{STATS}, count(DISTINCT customer_id) AS unique_customers, arg_min(product_category, (-n, product_category)) AS top_category FROM (SELECT *, count(*) OVER (PARTITION BY time_bucket(INTERVAL 1 MINUTE, event_time), product_category) AS n FROM order_stream WHERE price >= 0) GROUP BY 1 ORDER BY 1 DESC LIMIT 5"))
def a26w(spark, sf):
    return L.newest_windows(L.minute_stats(A.order_stream(spark, sf)))


@query("A27_table_profile", sql("order_stream", f"SELECT count(*) AS row_cnt, count(DISTINCT customer_id) AS entity_cnt, {GMV} / count(price) AS avg_value, min(event_time) AS first_time, max(event_time) AS last_time FROM order_stream"))
def a27(spark, sf):
    return L.table_profile(A.order_stream(spark, sf), "customer_id", "price", "event_time")


@query("A29_result_summary", "SELECT count(*) AS row_cnt, min(l_orderkey) AS min_l_orderkey, max(l_orderkey) AS max_l_orderkey, min(l_partkey) AS min_l_partkey, max(l_partkey) AS max_l_partkey FROM lineitem")
def a29(spark, sf):
    return L.result_summary(A.lines(spark, sf))


@query("W1_state_ranks", sql("order_lines", f"SELECT state, count(DISTINCT order_id) AS order_cnt, {GMV} AS total_gmv, CAST(rank() OVER (ORDER BY {GMV} DESC) AS INT) AS gmv_rank FROM order_lines GROUP BY 1"))
def w1(spark, sf):
    return L.state_ranks(A.order_lines(spark, sf))


@query("W2_gmv_share", sql("order_lines", f"SELECT product_category, {GMV} AS total_gmv, {GMV} / CAST(sum(sum(CAST(price AS DECIMAL(18,2)))) OVER () AS DOUBLE) AS gmv_share FROM order_lines GROUP BY 1"))
def w2(spark, sf):
    return L.gmv_share(A.order_lines(spark, sf))


@query("W3_latest_version", "SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1")
def w3(spark, sf):
    return V.latest_version(A.lines(spark, sf), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("W4_newest_by_key", sql("feature_history", "SELECT entity_id, feature_name, feature_value, feature_time, version FROM feature_history QUALIFY row_number() OVER (PARTITION BY entity_id, feature_name ORDER BY feature_time DESC, version DESC) = 1"))
def w4(spark, sf):
    h = A.feature_history(spark, sf).select("entity_id", "feature_name", "feature_value", "feature_time", "version")
    return V.newest_n_by(h, ["entity_id", "feature_name"], [F.desc("feature_time"), F.desc("version")])


@query("W5_latest_values", sql("feature_history", "SELECT entity_id, feature_name, arg_max(feature_value, (feature_time, version)) AS feature_value, max(feature_time) AS feature_time FROM feature_history GROUP BY 1, 2"))
def w5(spark, sf):
    return V.latest_values(A.feature_history(spark, sf), ["entity_id", "feature_name"], "feature_value", "feature_time", "version")


@query("W6_top_categories", sql("order_lines", f"SELECT state, product_category, {GMV} AS total_gmv FROM order_lines GROUP BY 1, 2 ORDER BY total_gmv DESC, state, product_category LIMIT 20"))
def w6(spark, sf):
    g = A.order_lines(spark, sf).groupBy("state", "product_category").agg(L.money(F.col("price")).alias("total_gmv"))
    return g.orderBy(F.desc("total_gmv"), "state", "product_category").limit(20)


@query("W11_replay_jobs", sql("replay_jobs", f"SELECT job_id, status, started_at, processed, date_sub('second', started_at, coalesce(finished_at, {NOW})) AS elapsed_seconds, processed::DOUBLE / nullif(date_sub('second', started_at, coalesce(finished_at, {NOW})), 0) AS records_per_second FROM replay_jobs ORDER BY started_at DESC, job_id LIMIT 20"))
def w11(spark, sf):
    return L.job_status(A.replay_jobs(spark, sf), at(AS_OF))


@query("J9_gmv_cliff", sql("order_stream", f", h AS (SELECT date_trunc('hour', event_time) AS window_start, {GMV} AS total_gmv FROM order_stream WHERE price >= 0 GROUP BY 1) SELECT a.window_start, a.total_gmv, b.total_gmv AS previous_gmv FROM h a JOIN h b ON a.window_start = b.window_start + INTERVAL 1 HOUR WHERE a.total_gmv < 0.5 * b.total_gmv"))
def j9(spark, sf):
    return L.previous_window_drop(L.minute_stats(A.order_stream(spark, sf), "1 hour"), "1 hour")


@query("J10_category_periods", sql("order_stream", f"SELECT product_category, {GMV.replace('))) AS', '))) FILTER (event_time < ' + NOW + ' - INTERVAL 1 DAY) AS')} AS base_gmv, coalesce({GMV.replace('))) AS', '))) FILTER (event_time >= ' + NOW + ' - INTERVAL 1 DAY) AS')}, 0) AS current_gmv, (current_gmv - base_gmv) / nullif(base_gmv, 0) AS change FROM order_stream WHERE event_time >= {NOW} - INTERVAL 2 DAY AND event_time < {NOW} GROUP BY 1 HAVING count(*) FILTER (event_time < {NOW} - INTERVAL 1 DAY) > 0"))
def j10(spark, sf):
    return L.period_over_period(A.order_stream(spark, sf), ago(AS_OF, days=2), ago(AS_OF, days=1), ago(AS_OF, days=1), at(AS_OF))


@query("R1_retention", sql("order_stream", f"SELECT order_id, event_time FROM order_stream WHERE event_time + INTERVAL 7 DAY > {NOW}"))
def r1(spark, sf):
    return V.retained(A.order_stream(spark, sf), "event_time", 7 * 86400, at(AS_OF)).select("order_id", "event_time")
