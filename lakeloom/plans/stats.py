"""Queries of distributions, drift, forecasts and trends."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.columns import AS_OF, at
from ..operators import layers as L
from ..operators import stats as S
from ..sources import adapters as A
from ..sources.adapters import rounded_sql, sql
from .layers import GMV, NOW
from .registry import query

EMPTY = "count(*) FILTER (feature_value IS NULL OR feature_value = 0)::DOUBLE / count(*)"


@query("A25_distribution", sql("feature_history", f"""SELECT group_name, feature_name, count(*) AS cnt, CAST(sum(CAST(feature_value AS DECIMAL(18,4))) AS DOUBLE) / count(feature_value) AS mean, {rounded_sql('stddev_pop(feature_value)', 6)} AS std,
    min(feature_value) AS min, max(feature_value) AS max, {rounded_sql('quantile_cont(feature_value, 0.5)', 6)} AS p50, {rounded_sql('quantile_cont(feature_value, 0.95)', 6)} AS p95, {EMPTY} AS null_rate FROM feature_history GROUP BY 1, 2"""))
def a25(spark, sf):
    out = S.distribution(A.feature_history(spark, sf), ["group_name", "feature_name"], "feature_value")
    return out.withColumns({c: S.rounded(F.col(c), 6) for c in ("std", "p50", "p95")})


def parts(base_start: str, mid: str, end: str) -> str:
    bucket = "least(greatest(coalesce(CAST(floor((feature_value - low) / nullif(high - low, 0) * 10) AS BIGINT) + 1, 1), 1), 10)"
    return f"""base AS (SELECT * FROM feature_history WHERE feature_time >= {base_start} AND feature_time < {mid}), cur AS (SELECT * FROM feature_history WHERE feature_time >= {mid} AND feature_time < {end}),
    bounds AS (SELECT group_name, feature_name, min(feature_value) AS low, max(feature_value) AS high FROM base GROUP BY 1, 2),
    hist AS (SELECT kind, group_name, feature_name, bucket, count(*) AS cnt, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY kind, group_name, feature_name) AS share FROM (
        SELECT 'base' AS kind, group_name, feature_name, {bucket} AS bucket FROM base JOIN bounds USING (group_name, feature_name) UNION ALL
        SELECT 'cur' AS kind, group_name, feature_name, {bucket} AS bucket FROM cur JOIN bounds USING (group_name, feature_name)) GROUP BY 1, 2, 3, 4),
    grid AS (SELECT group_name, feature_name, bucket FROM (SELECT DISTINCT group_name, feature_name FROM hist), range(1, 11) t(bucket)),
    pq AS (SELECT g.*, greatest(coalesce(c.share, 0), 1e-6::DOUBLE) AS p, greatest(coalesce(b.share, 0), 1e-6::DOUBLE) AS q FROM grid g
        LEFT JOIN hist b ON b.kind = 'base' AND g.group_name = b.group_name AND g.feature_name = b.feature_name AND g.bucket = b.bucket
        LEFT JOIN hist c ON c.kind = 'cur' AND g.group_name = c.group_name AND g.feature_name = c.feature_name AND g.bucket = c.bucket),
    index AS (SELECT group_name, feature_name, {rounded_sql('CAST(sum(CAST(round((p - q) * ln(p / q), 12) AS DECIMAL(20,12))) AS DOUBLE)', 6)} AS psi FROM pq GROUP BY 1, 2),
    nulls AS (SELECT group_name, feature_name, count(*) AS current_cnt, {EMPTY} AS null_rate FROM cur GROUP BY 1, 2),
    report AS (SELECT group_name, feature_name, psi, current_cnt, null_rate, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'monitor' ELSE 'drift' END AS label,
        CASE WHEN psi >= 0.25 OR coalesce(null_rate, 0) > 0.3 THEN 1 ELSE 0 END AS is_drifted, {end} AS check_time FROM index LEFT JOIN nulls USING (group_name, feature_name))"""


WEEK = parts(f"({NOW} - INTERVAL 168 HOUR)", f"({NOW} - INTERVAL 24 HOUR)", NOW)


@query("D1_histogram", sql("feature_history", f", {WEEK} SELECT group_name, feature_name, bucket, cnt, share FROM hist WHERE kind = 'base'"))
def d1(spark, sf):
    h, t, keys = A.feature_history(spark, sf), F.col("feature_time"), ["group_name", "feature_name"]
    base = h.filter((t >= S.ago(AS_OF, hours=168)) & (t < S.ago(AS_OF, hours=24)))
    bounds = base.groupBy(*keys).agg(F.min("feature_value").alias("low"), F.max("feature_value").alias("high"))
    return S.histogram(base, keys, "feature_value", bounds)


@query("D2_psi", sql("feature_history", f", {WEEK} SELECT group_name, feature_name, psi FROM index"))
def d2(spark, sf):
    return S.drift_report(A.feature_history(spark, sf), at(AS_OF)).select("group_name", "feature_name", "psi")


@query("D3_psi_label", sql("feature_history", f", {WEEK} SELECT label, count(*) AS feature_cnt FROM report GROUP BY 1"))
def d3(spark, sf):
    return S.drift_report(A.feature_history(spark, sf), at(AS_OF)).groupBy("label").agg(F.count("*").alias("feature_cnt"))


@query("D4_drift_report", sql("feature_history", f", {WEEK} SELECT * FROM report"))
def d4(spark, sf):
    return S.drift_report(A.feature_history(spark, sf), at(AS_OF))


BEFORE = "TIMESTAMP '2024-01-30 00:00:00'"


def reports(spark, sf):
    """The reports of the last two days."""
    h = A.feature_history(spark, sf)
    return S.drift_report(h, at(AS_OF)).union(S.drift_report(h, at(AS_OF - dt.timedelta(days=1))))


@query("D5_drift_latest", sql("feature_history", f", {WEEK} SELECT * FROM report"))
def d5(spark, sf):
    return S.drift_latest(reports(spark, sf), at(AS_OF))


def category_hours(spark, sf):
    orders = A.order_stream(spark, sf)
    return L.minute_stats(orders, "1 hour", ["product_category"])


#: Smoothing of the last 60 hours of each category by recursion over its points, and ten steps ahead.
HOLT = f"""series AS (SELECT product_category, date_trunc('hour', event_time) AS window_start, {GMV} AS v FROM order_stream WHERE price >= 0 GROUP BY 1, 2),
    points AS (SELECT *, row_number() OVER (PARTITION BY product_category ORDER BY window_start) AS n FROM (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY product_category ORDER BY window_start DESC) <= 60)),
    fold AS (
        SELECT a.product_category, 1::BIGINT AS n, a.v AS level, b.v - a.v AS trend, 0.0::DOUBLE AS sq FROM points a JOIN points b ON a.product_category = b.product_category AND a.n = 1 AND b.n = 2
        UNION ALL SELECT product_category, n, 0.35::DOUBLE * v + 0.65::DOUBLE * guess, 0.1::DOUBLE * (0.35::DOUBLE * v + 0.65::DOUBLE * guess - level) + 0.9::DOUBLE * trend, sq + (v - guess) * (v - guess)
        FROM (SELECT f.product_category, p.n, p.v, f.level, f.trend, f.sq, f.level + f.trend AS guess FROM fold f JOIN points p ON p.product_category = f.product_category AND p.n = f.n + 1)),
    fitted AS (SELECT *, 1.96::DOUBLE * sqrt(sq / (n - 1)) AS margin FROM fold WHERE n >= 4 QUALIFY row_number() OVER (PARTITION BY product_category ORDER BY n DESC) = 1),
    steps AS (SELECT product_category, (SELECT max(window_start) FROM points p WHERE p.product_category = f.product_category) AS last_time, CAST(h AS INT) AS horizon, greatest(level + h * trend, 0.0::DOUBLE) AS p, margin * (1.0::DOUBLE + 0.1::DOUBLE * (h - 1)) AS wide FROM fitted f, range(1, 11) t(h)),
    forecasts AS (SELECT product_category, last_time, horizon, {rounded_sql('p', 2)} AS predicted, {rounded_sql('greatest(p - wide, 0.0::DOUBLE)', 2)} AS lower_bound, {rounded_sql('p + wide', 2)} AS upper_bound, last_time + horizon * INTERVAL 1 HOUR AS forecast_time FROM steps)"""


@query("TF1_holt", sql("order_stream", f", {HOLT} SELECT * EXCLUDE (forecast_time) FROM forecasts"))
def tf1(spark, sf):
    """Forecast of GMV by category."""
    return S.forecast(category_hours(spark, sf), ["product_category"], "window_start", "total_gmv")


def forecasts(spark, sf):
    return S.forecast_rows(S.forecast(category_hours(spark, sf), ["product_category"], "window_start", "total_gmv"), "1 HOUR")


@query("TF2_forecast_rows", sql("order_stream", f", {HOLT} SELECT * FROM forecasts"))
def tf2(spark, sf):
    return forecasts(spark, sf)


@query("W15_upcoming", sql("order_stream", f", {HOLT} SELECT * FROM forecasts WHERE forecast_time > {NOW} AND horizon <= 5"))
def w15(spark, sf):
    return S.upcoming(forecasts(spark, sf), at(AS_OF), 5)


@query("TF5_actual_and_forecast", sql("order_stream", f", {HOLT} SELECT product_category, window_start AS time, v AS value, 'actual' AS kind FROM series WHERE window_start >= {NOW} - INTERVAL 1 DAY UNION ALL SELECT product_category, forecast_time, predicted, 'forecast' FROM forecasts"))
def tf5(spark, sf):
    stats = category_hours(spark, sf)
    return S.actual_and_forecast(stats.filter(F.col("window_start") >= S.ago(AS_OF, days=1)), forecasts(spark, sf), ["product_category"], "window_start", "total_gmv")


def trend_sql(keys: str, source: str, time: str, value: str, last: int, ahead: int) -> str:
    return f"""SELECT {keys}, count(*) AS points, regr_slope({value}, x) AS slope, regr_intercept({value}, x) AS intercept, intercept + slope * (max(x) + {ahead}) AS predicted FROM (
        SELECT *, (epoch_us({time}) - min(epoch_us({time})) OVER (PARTITION BY {keys})) / 1000000.0::DOUBLE AS x FROM (
            SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {time} DESC, {value} DESC) <= {last})) GROUP BY {keys} HAVING count(*) >= 3"""


@query("TF3_lag_trend", sql("consumer_lag", f"SELECT consumer_group, topic, points, {rounded_sql('slope', 6)} AS slope, {rounded_sql('predicted', 2)} AS predicted, CASE WHEN predicted > 100000 THEN 1 ELSE 0 END AS is_alert FROM ({trend_sql('consumer_group, topic', 'consumer_lag', 'check_time', 'lag', 20, 1800)} )"))
def tf3(spark, sf):
    out = S.linear_trend(A.consumer_lag(spark, sf), ["consumer_group", "topic"], "check_time", "lag", 20, 1800)
    alert = F.when(F.col("predicted") > 100_000, 1).otherwise(0).alias("is_alert")
    return out.select("consumer_group", "topic", "points", S.rounded(F.col("slope"), 6).alias("slope"), S.rounded(F.col("predicted"), 2).alias("predicted"), alert)


@query("TF4_storage_trend", sql("query_log", f", days AS (SELECT regexp_extract(query_sql, 'INTO (\\w+\\.\\w+)', 1) AS target, date_trunc('day', query_time) AS day, CAST(sum(read_bytes) AS BIGINT) AS bytes FROM query_log WHERE query_sql LIKE 'INSERT%' GROUP BY 1, 2) SELECT target, points, {rounded_sql('slope', 6)} AS slope, CASE WHEN slope * 3600 > 1024 THEN 1 ELSE 0 END AS is_growing FROM ({trend_sql('target', 'days', 'day', 'bytes', 5, 0)})"))
def tf4(spark, sf):
    """Growth of what is written to each table by day, flagged above 1 KiB an hour."""
    log = A.query_log(spark, sf).filter("query_sql LIKE 'INSERT%'")
    days = log.groupBy(F.regexp_extract("query_sql", r"INTO (\w+\.\w+)", 1).alias("target"), F.date_trunc("day", "query_time").alias("day")).agg(F.sum("read_bytes").alias("bytes"))
    out = S.linear_trend(days, ["target"], "day", "bytes", 5, 0)
    return out.select("target", "points", S.rounded(F.col("slope"), 6).alias("slope"), F.when(F.col("slope") * 3600 > 1024, 1).otherwise(0).alias("is_growing"))


HOURS = f"hours AS (SELECT date_trunc('hour', event_time) AS window_start, count(*) AS order_cnt, {GMV} AS total_gmv FROM order_stream WHERE price >= 0 GROUP BY 1)"
MEAN = "CAST(sum(CAST(total_gmv AS DECIMAL(18,2))) FILTER ({0}) AS DOUBLE) / count(*) FILTER ({0})"


@query("W7_half_trend", sql("order_stream", f""", {HOURS}, n AS (SELECT *, row_number() OVER (ORDER BY window_start) AS n, count(*) OVER () AS m FROM hours WHERE window_start >= {NOW} - INTERVAL 1 DAY)
    SELECT *, (second_mean - first_mean) / first_mean AS change, CASE WHEN abs((second_mean - first_mean) / first_mean) >= 0.15 THEN 1 ELSE 0 END AS is_trend FROM (
        SELECT count(*) AS points, {MEAN.format('n <= m // 2')} AS first_mean, {MEAN.format('n > m // 2')} AS second_mean FROM n) WHERE points >= 6"""))
def w7(spark, sf):
    return S.half_trend(L.minute_stats(L.last(A.order_stream(spark, sf), AS_OF, days=1), "1 hour"), "window_start", "total_gmv")


@query("W8_two_sided_outliers", sql("order_stream", f", {HOURS} SELECT window_start, total_gmv, {rounded_sql('z', 2)} AS z FROM (SELECT *, (total_gmv - avg(total_gmv) OVER ()) / stddev_samp(total_gmv) OVER () AS z FROM hours) WHERE abs(z) > 2"))
def w8(spark, sf):
    return S.two_sided_outliers(L.minute_stats(A.order_stream(spark, sf), "1 hour").select("window_start", "total_gmv"), "window_start", "total_gmv")


@query("W9_recent_drop", sql("order_stream", f""", {HOURS}, long AS (UNPIVOT (SELECT window_start, order_cnt::DOUBLE AS order_cnt, total_gmv FROM hours) ON order_cnt, total_gmv INTO NAME metric_name VALUE v)
    SELECT metric_name, points, {rounded_sql('mean', 6)} AS mean, {rounded_sql('std', 6)} AS std, {rounded_sql('current', 6)} AS current, CASE WHEN points >= 10 AND current < mean - 2 * std THEN 1 ELSE 0 END AS is_drop FROM (
        SELECT metric_name, count(v) FILTER (b) AS points, avg(v) FILTER (b) AS mean, stddev_samp(v) FILTER (b) AS std, avg(v) FILTER (NOT b) AS current
        FROM (SELECT *, window_start < {NOW} - INTERVAL 5 HOUR AS b FROM long WHERE window_start >= {NOW} - INTERVAL 60 HOUR AND window_start < {NOW}) GROUP BY 1)"""))
def w9(spark, sf):
    """Hours stand for minutes, as the events are sparse."""
    stats = L.minute_stats(A.order_stream(spark, sf), "1 hour").withColumn("order_cnt", F.col("order_cnt").cast("double"))
    out = S.recent_drop(stats, "window_start", ["order_cnt", "total_gmv"], at(AS_OF), start_min=60 * 60, recent_min=5 * 60)
    return out.withColumns({c: S.rounded(F.col(c), 6) for c in ("mean", "std", "current")})


@query("W10_sliding_outliers", sql("order_stream", f", h AS (SELECT product_category, date_trunc('hour', event_time) AS window_start, {GMV} AS total_gmv FROM order_stream WHERE price >= 0 GROUP BY 1, 2) SELECT product_category, window_start, total_gmv FROM (SELECT *, avg(total_gmv) OVER w AS mean, stddev_samp(total_gmv) OVER w AS std FROM h WINDOW w AS (PARTITION BY product_category ORDER BY epoch(window_start) RANGE BETWEEN 108000 PRECEDING AND 3600 PRECEDING)) WHERE abs(total_gmv - mean) > 2 * std"))
def w10(spark, sf):
    return S.sliding_outliers(category_hours(spark, sf), ["product_category"], "window_start", "total_gmv", 30 * 3600, 3600).select("product_category", "window_start", "total_gmv")
