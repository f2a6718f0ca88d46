"""Queries of alerts and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import AS_OF, ago, at, settle, worst_first
from ..operators import alerts as R
from ..operators import layers as L
from ..operators import lineage as N
from ..operators import quality as Q
from ..operators import stats as S
from ..sources import adapters as A
from ..sources.adapters import sql
from .layers import DAY, GMV, NOW, SALES
from .quality import CHECKS
from .registry import query
from .stats import WEEK

COLS = "source, category, severity, metric_name, current_value, threshold_value"
PRINT = "substr(md5(source || ':' || metric_name || ':' || category), 1, 16) AS fingerprint"


def two(spark, sf):
    return L.two_periods(A.order_stream(spark, sf), ago(AS_OF, days=2), ago(AS_OF, days=1), ago(AS_OF, days=1), at(AS_OF))


def period(w: str, n: str) -> str:
    return f"CAST(sum(CAST(price AS DECIMAL(18,2))) FILTER ({w}) AS DOUBLE) AS {n}_gmv, count(*) FILTER ({w}) AS {n}_orders, count(*) FILTER ({w} AND order_status = 'canceled') AS {n}_canceled"


TWO = f"two AS (SELECT {period(f'event_time >= {NOW} - INTERVAL 2 DAY AND event_time < {NOW} - INTERVAL 1 DAY', 'base')}, {period(DAY, 'current')} FROM order_stream)"
L1 = f"""metrics AS (SELECT * FROM (UNPIVOT (SELECT order_cnt::DOUBLE AS order_cnt, total_gmv, cancel_cnt::DOUBLE / order_cnt AS cancel_rate, avg_price, unique_customers::DOUBLE AS unique_customers,
        (SELECT max(lag)::DOUBLE FROM consumer_lag) AS max_lag FROM (SELECT {SALES} FROM order_stream WHERE {DAY})) ON * INTO NAME metric_name VALUE value)),
    rules(metric_name, op, threshold, severity) AS (VALUES {", ".join(f"('{m}', '{o}', {t}::DOUBLE, '{s}')" for m, o, t, s in R.THRESHOLDS)}),
    l1 AS (SELECT 'rule_engine' AS source, 'BUSINESS' AS category, severity, metric_name, value AS current_value, threshold AS threshold_value FROM metrics JOIN rules USING (metric_name)
        WHERE CASE op WHEN 'gt' THEN value > threshold WHEN 'lt' THEN value < threshold WHEN 'lte' THEN value <= threshold WHEN 'gte' THEN value >= threshold END)"""
L2 = "l2 AS (SELECT 'rule_engine' AS source, 'BUSINESS' AS category, CASE WHEN c < -0.35 THEN 'P1' WHEN c <= -0.20 THEN 'P2' END AS severity, 'gmv_drop' AS metric_name, c AS current_value, -0.2::DOUBLE AS threshold_value FROM (SELECT (current_gmv - base_gmv) / base_gmv AS c FROM two) WHERE c <= -0.20)"
L3 = "l3 AS (SELECT 'rule_engine' AS source, 'BUSINESS' AS category, CASE WHEN n > 0.50 THEN 'P1' ELSE 'P2' END AS severity, 'cancel_rise' AS metric_name, n AS current_value, 0.3::DOUBLE AS threshold_value FROM (SELECT current_canceled::DOUBLE / current_orders AS n, base_canceled::DOUBLE / base_orders AS b FROM two) WHERE n >= 0.30 AND n - b >= 0.10)"
CHANGES = f"changes AS (SELECT product_category, {period(f'event_time < {NOW} - INTERVAL 1 DAY', 'base')}, {period(f'event_time >= {NOW} - INTERVAL 1 DAY', 'current')} FROM order_stream WHERE event_time >= {NOW} - INTERVAL 2 DAY AND event_time < {NOW} GROUP BY 1)"
L4 = "l4 AS (SELECT 'rule_engine' AS source, product_category AS category, CASE WHEN c < -0.60 THEN 'P1' ELSE 'P2' END AS severity, 'category_drop' AS metric_name, c AS current_value, -0.4::DOUBLE AS threshold_value FROM (SELECT product_category, (coalesce(current_gmv, 0) - base_gmv) / base_gmv AS c FROM changes WHERE base_orders > 0) WHERE c < -0.40)"
LAG = "lags AS (SELECT consumer_group, max(lag) AS max_lag, avg(lag) AS avg_lag, count(*) AS samples FROM consumer_lag WHERE is_replay = 0 GROUP BY 1 HAVING max(lag) > 50000)"
L5 = "l5 AS (SELECT 'rule_engine' AS source, consumer_group AS category, CASE WHEN max_lag > 200000 THEN 'P1' ELSE 'P2' END AS severity, 'consumer_lag' AS metric_name, max_lag::DOUBLE AS current_value, 50000.0::DOUBLE AS threshold_value FROM lags)"


def today_metrics(spark, sf):
    row = L.today_summary(A.order_stream(spark, sf), AS_OF).withColumn("cancel_rate", L.ratio(F.col("cancel_cnt"), F.col("order_cnt")))
    lag = A.consumer_lag(spark, sf).agg(F.max("lag").alias("max_lag"))
    return R.metric_rows(row.join(lag), [r[0] for r in R.THRESHOLDS])  # two single rows


def l1_rows(spark, sf):
    rules = spark.createDataFrame(R.THRESHOLDS, "metric_name string, op string, threshold double, severity string")
    return R.threshold_alerts(today_metrics(spark, sf), rules)


def changes(spark, sf):
    return L.period_over_period(A.order_stream(spark, sf), ago(AS_OF, days=2), ago(AS_OF, days=1), ago(AS_OF, days=1), at(AS_OF))


@query("L1_threshold_rules", sql("order_stream consumer_lag", f", {L1} SELECT * FROM l1"))
def l1(spark, sf):
    return l1_rows(spark, sf)


@query("L2_gmv_drop", sql("order_stream", f", {TWO}, {L2} SELECT * FROM l2"))
def l2(spark, sf):
    return R.gmv_drop(two(spark, sf))


@query("L3_cancel_rise", sql("order_stream", f", {TWO}, {L3} SELECT * FROM l3"))
def l3(spark, sf):
    return R.cancel_rise(two(spark, sf))


def hours_sql(base_end: int) -> str:
    return f"two AS (SELECT {period(f'event_time >= {NOW} - INTERVAL 25 HOUR AND event_time < {NOW} - INTERVAL {base_end} HOUR', 'base')}, {period(f'event_time >= {NOW} - INTERVAL 1 HOUR AND event_time < {NOW}', 'current')} FROM order_stream)"


for suffix, legacy, end in (("", False, 24), ("_legacy", True, 23)):

    @query(f"L2_hour_gmv_drop{suffix}", sql("order_stream", f", {hours_sql(end)}, {L2} SELECT * FROM l2"))
    def l2h(spark, sf, legacy=legacy):
        """The last hour against the one a day before, or against the two hours around that."""
        return R.gmv_drop(L.hour_and_baseline(A.order_stream(spark, sf), at(AS_OF), legacy))

    @query(f"L3_hour_cancel_rise{suffix}", sql("order_stream", f", {hours_sql(end)}, {L3.replace('n - b', 'n - coalesce(b, 0)')} SELECT * FROM l3"))
    def l3h(spark, sf, legacy=legacy):
        return R.cancel_rise(L.hour_and_baseline(A.order_stream(spark, sf), at(AS_OF), legacy))


@query("L4_category_drop", sql("order_stream", f", {CHANGES}, {L4} SELECT * FROM l4"))
def l4(spark, sf):
    return R.category_drop(changes(spark, sf))


@query("A28_lag_by_group", sql("consumer_lag", f", {LAG} SELECT * FROM lags"))
def a28(spark, sf):
    return R.lag_by_group(A.consumer_lag(spark, sf))


@query("L5_lag_alerts", sql("consumer_lag", f", {LAG}, {L5} SELECT * FROM l5"))
def l5(spark, sf):
    return R.lag_alerts(R.lag_by_group(A.consumer_lag(spark, sf)))


@query("L6_quality_alerts", sql("dirty_orders", "SELECT 'rule_engine' AS source, 'DATA' AS category, CASE WHEN v < 50 THEN 'P2' ELSE 'P3' END AS severity, 'quality_score' AS metric_name, v AS current_value, 70.0::DOUBLE AS threshold_value FROM (SELECT avg(score) AS v FROM (SELECT event_time, CASE WHEN price < 0 OR product_category = '' OR state IS NULL THEN 0.0::DOUBLE ELSE 60.0::DOUBLE END AS score FROM dirty_orders)" + f" WHERE event_time >= {NOW} - INTERVAL 600 MINUTE AND event_time < {NOW}) WHERE v < 70"))
def l6(spark, sf):
    """Scores by row: 0 for a damaged one, 60 else, over ten hours."""
    bad = (F.col("price") < 0) | (F.col("product_category") == "") | F.col("state").isNull()
    scores = A.dirty_orders(spark, sf).select("event_time", F.when(bad, 0.0).otherwise(60.0).alias("score"))
    return R.quality_alerts(scores, "event_time", "score", at(AS_OF), minutes=600)


@query("L7_failed_jobs", sql("replay_jobs", f"SELECT 'rule_engine' AS source, 'INFRA' AS category, 'P1' AS severity, 'replay_job_' || job_id AS metric_name, 1.0::DOUBLE AS current_value, 0.0::DOUBLE AS threshold_value FROM replay_jobs WHERE status = 'failed' AND finished_at >= {NOW} - INTERVAL 1440 MINUTE AND finished_at < {NOW}"))
def l7(spark, sf):
    return R.failed_jobs(A.replay_jobs(spark, sf), at(AS_OF), minutes=1440)


L8 = "l8 AS (SELECT 'drift_monitor' AS source, 'DATA' AS category, 'P3' AS severity, group_name || '.' || feature_name AS metric_name, psi AS current_value, 0.25::DOUBLE AS threshold_value FROM report WHERE is_drifted = 1)"


@query("L8_drift_alerts", sql("feature_history", f", {WEEK}, {L8} SELECT * FROM l8"))
def l8(spark, sf):
    return R.drift_alerts(S.drift_report(A.feature_history(spark, sf), at(AS_OF)))


ALL = f"{L1}, {TWO}, {L2}, {L3}, {CHANGES}, {L4}, {LAG}, {L5}, every AS (SELECT *, {PRINT} FROM (" + " UNION ALL ".join(f"SELECT {COLS} FROM l{n}" for n in range(1, 6)) + "))"


@query("U3_all_detectors", sql("order_stream consumer_lag", f", {ALL} SELECT * FROM every"))
def u3(spark, sf):
    both, lag = two(spark, sf), R.lag_by_group(A.consumer_lag(spark, sf))
    return R.by_severity(R.union_alerts([l1_rows(spark, sf), R.gmv_drop(both), R.cancel_rise(both), R.category_drop(changes(spark, sf)), R.lag_alerts(lag)]))


@query("L9_fingerprint", sql("alert_events", "SELECT alert_id, fingerprint FROM alert_events"))
def l9(spark, sf):
    return A.alert_events(spark, sf).select("alert_id", "fingerprint")


SILENCES = [("rule_engine", "metric_1", "2024-02-01"), ("", "metric_7", "2024-02-01"), ("trend_predictor", "", "2024-01-01")]


@query("L10_silencing", sql("alert_events", "SELECT alert_id, source, metric_name FROM alert_events WHERE NOT (source = 'rule_engine' AND contains(metric_name, 'metric_1')) AND NOT contains(metric_name, 'metric_7')"))
def l10(spark, sf):
    rules = spark.createDataFrame(SILENCES, "source string, metric string, expires string").withColumn("expires_at", F.to_timestamp("expires"))
    return R.silence(A.alert_events(spark, sf), rules, at(AS_OF)).select("alert_id", "source", "metric_name")


NAME = r"([A-Za-z_]\w*\.[A-Za-z_]\w*)"
EDGES = rf"""statements AS (
    SELECT unnest(string_split(regexp_replace(regexp_replace(query_sql, '/\*.*?\*/', ' ', 'gs'), '--[^\n]*', '', 'g'), ';')) AS s FROM query_log),
    parts AS (
    SELECT list_transform(regexp_extract_all(s, '(?i)\b(?:from|join)\s+{NAME}', 1), lambda x: lower(x)) AS sources, lower(regexp_extract(s, '(?i)\binsert\s+into\s+{NAME}', 1)) AS filled,
        lower(regexp_extract(s, '(?i)\bcreate\s+(?:materialized\s+)?view\s+{NAME}', 1)) AS made, CASE WHEN regexp_matches(s, '(?i)\bmaterialized\s+view\b') THEN lower(regexp_extract(s, '(?i)\bto\s+{NAME}', 1)) ELSE '' END AS written
    FROM statements),
    edges AS (
    SELECT DISTINCT source, target FROM (
        SELECT unnest(sources) AS source, target FROM (SELECT sources, unnest(list_filter([filled, made], lambda x: x <> '')) AS target FROM parts)
        UNION ALL SELECT made, written FROM parts WHERE made <> '' AND written <> '')
    WHERE source <> target AND split_part(source, '.', 1) NOT IN ('system', 'information_schema') AND split_part(target, '.', 1) NOT IN ('system', 'information_schema'))"""
#: The tables of alerts by the log's names: one of the two that the events name.
ALERTED = "alerted AS (SELECT alert_id, severity, CASE WHEN CAST(alert_id AS BIGINT) % 2 = 0 THEN 'ods.t1' ELSE 'dwd.t3' END AS t FROM alert_events)"


def edges(spark, sf):
    """The edges of the log, found once for all that the query does with them."""
    return settle(spark, N.edges_of_sql(A.query_log(spark, sf)))


@query("L11_lineage_enrichment", sql("alert_events query_log", f", {EDGES}, {ALERTED}, n AS (SELECT source AS t, count(*) AS n FROM edges GROUP BY 1) SELECT alert_id, coalesce(n, 0) AS downstream_cnt, CASE WHEN coalesce(n, 0) >= 3 AND severity = 'P3' THEN 'P2' WHEN coalesce(n, 0) >= 3 AND severity = 'P2' THEN 'P1' ELSE severity END AS severity FROM alerted LEFT JOIN n USING (t)"))
def l11(spark, sf):
    table = F.when(F.col("alert_id").cast("long") % 2 == 0, "ods.t1").otherwise("dwd.t3")
    alerts = A.alert_events(spark, sf).select("alert_id", "severity", F.array(table).alias("affected_tables"))
    return N.enrich_alerts(alerts, edges(spark, sf)).select("alert_id", F.size("downstream_tables").cast("long").alias("downstream_cnt"), "severity")


@query("L13_edges_of_sql", sql("query_log", f", {EDGES} SELECT * FROM edges"))
def l13(spark, sf):
    return edges(spark, sf)


#: What lies up to two edges before and behind a table.
NEAR = """up AS (SELECT source AS node FROM edges WHERE target = 'dwd.t3'), down AS (SELECT target AS node FROM edges WHERE source = 'dwd.t3')
    SELECT 'up' AS direction, node FROM up UNION ALL SELECT 'down', node FROM down
    UNION ALL SELECT DISTINCT 'up to two', node FROM (SELECT node FROM up UNION ALL SELECT source FROM edges JOIN up ON target = node) WHERE node <> 'dwd.t3'
    UNION ALL SELECT DISTINCT 'down to two', node FROM (SELECT node FROM down UNION ALL SELECT target FROM edges JOIN down ON source = node) WHERE node <> 'dwd.t3'"""


@query("L14_neighbours", sql("query_log", f", {EDGES}, {NEAR}"))
def l14(spark, sf):
    e, tag = edges(spark, sf), lambda df, name: df.select(F.lit(name).alias("direction"), "node")
    near = tag(N.upstream(e, "dwd.t3"), "up").union(tag(N.downstream(e, "dwd.t3"), "down"))
    return near.union(tag(N.upstream(e, "dwd.t3", 2), "up to two")).union(tag(N.downstream(e, "dwd.t3", 2), "down to two"))


PAIRS = "pairs AS (SELECT source AS ancestor, target AS descendant FROM edges UNION SELECT ancestor, target FROM pairs JOIN edges ON descendant = source)"


@query("L15_closure", sql("query_log", f", {EDGES}, {PAIRS} SELECT * FROM pairs WHERE ancestor <> descendant"))
def l15(spark, sf):
    return N.closure(edges(spark, sf))


@query("L16_impact", sql("query_log", f", {EDGES}, {PAIRS} SELECT node, descendants, least(descendants / 10.0::DOUBLE, 1.0) AS score, CASE WHEN descendants > 7 THEN 'P1' WHEN descendants > 3 THEN 'P2' ELSE 'P3' END AS severity FROM (SELECT ancestor AS node, count(*) AS descendants FROM pairs WHERE ancestor <> descendant GROUP BY 1)"))
def l16(spark, sf):
    return N.impact(N.closure(edges(spark, sf)))


@query("L17_two_hops", sql("query_log", f", {EDGES} SELECT source AS node, target AS affected, 1 AS hop FROM edges UNION ALL SELECT *, 2 FROM (SELECT a.source, b.target FROM edges a JOIN edges b ON a.target = b.source WHERE a.source <> b.target EXCEPT SELECT source, target FROM edges)"))
def l17(spark, sf):
    return N.two_hops(edges(spark, sf))


@query("A14_severity_and_type", sql("alert_events", "SELECT severity, source, count(*) AS alert_cnt FROM alert_events GROUP BY GROUPING SETS ((severity), (source))"))
def a14(spark, sf):
    return R.severity_and_type_counts(A.alert_events(spark, sf))


@query("A15_hourly_alerts", sql("alert_events", "SELECT date_trunc('hour', fired_at) AS hour_start, severity, source, count(*) AS alert_cnt FROM alert_events GROUP BY 1, 2, 3"))
def a15(spark, sf):
    return R.hourly_alerts(A.alert_events(spark, sf))


RAN = "allowed = 1 AND dry_run = 0"


@query("A16_action_success", sql("decision_log", f"SELECT CAST(log_time AS DATE) AS day, skill_name, action_type, risk_level, count(*) AS total, count(*) FILTER (allowed = 1) AS allowed_cnt, count(*) FILTER ({RAN}) AS executed_cnt, count(*) FILTER ({RAN} AND success = 1) AS success_cnt, count(*) FILTER ({RAN} AND success = 1)::DOUBLE / nullif(count(*) FILTER ({RAN}), 0) AS success_rate FROM decision_log GROUP BY 1, 2, 3, 4"))
def a16(spark, sf):
    return R.action_success(A.decision_log(spark, sf))


@query("A17_noisy_alerts", sql("alert_events", "SELECT fingerprint, source, metric_name, count(*) AS alert_cnt, max(fired_at) AS last_fired, min(severity) AS worst_severity FROM alert_events GROUP BY 1, 2, 3 ORDER BY alert_cnt DESC, fingerprint LIMIT 20"))
def a17(spark, sf):
    return R.noisy_alerts(A.alert_events(spark, sf))


@query("A18_alert_days", sql("alert_events", "SELECT CAST(fired_at AS DATE) AS day, metric_name, severity, count(*) AS alert_cnt, CAST(sum(resolved) AS BIGINT) AS resolved_cnt FROM alert_events GROUP BY 1, 2, 3"))
def a18(spark, sf):
    return R.alert_days(A.alert_events(spark, sf))


@query("A19_slow_summary", sql("query_log", "SELECT CASE WHEN lower(query_sql) LIKE '% join %' THEN 'join' WHEN lower(query_sql) LIKE '%count(%' THEN 'aggregate' ELSE 'other' END AS kind, count(*) AS query_cnt, avg(duration_ms) AS avg_ms, max(duration_ms) AS max_ms, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM query_log WHERE duration_ms > 3000 GROUP BY 1"))
def a19(spark, sf):
    return N.slow_summary(A.query_log(spark, sf))


DONE = "d AS (SELECT alert_id, max(success) AS success, count(*) AS decisions FROM decision_log GROUP BY 1)"


@query("A20_outcome_counts", sql("alert_events decision_log", f", {DONE} SELECT count(*) AS total, count(*) FILTER (resolved = 1) AS resolved_cnt, count(*) FILTER (resolved = 0 AND success IS NOT NULL) AS monitoring_cnt, count(*) FILTER (resolved = 0 AND success IS NULL) AS escalated_cnt, count(*) FILTER (success = 1) AS success_cnt FROM alert_events LEFT JOIN d USING (alert_id)"))
def a20(spark, sf):
    return R.outcome_counts(A.alert_events(spark, sf), A.decision_log(spark, sf))


@query("J7_open_with_outcome", sql("alert_events decision_log", f", {DONE} SELECT alert_id, severity, coalesce(decisions, 0) AS decisions FROM alert_events LEFT JOIN d USING (alert_id) WHERE coalesce(success, 0) = 0"))
def j7(spark, sf):
    return R.open_with_outcome(A.alert_events(spark, sf), A.decision_log(spark, sf)).select("alert_id", "severity", "decisions")


@query("J12_not_analysed", sql("query_log", f"SELECT query_time, query_sql FROM query_log WHERE duration_ms > 3000 AND query_sql NOT IN (SELECT query_sql FROM query_log WHERE query_time >= {NOW} - INTERVAL 24 HOUR)"))
def j12(spark, sf):
    log = A.query_log(spark, sf)
    return N.not_seen(log.filter("duration_ms > 3000"), log.filter(F.col("query_time") >= ago(AS_OF, hours=24))).select("query_time", "query_sql")


@query("K3_slow_queries", sql("query_log", f"SELECT * FROM query_log WHERE query_time >= {NOW} - INTERVAL 24 HOUR AND query_time < {NOW} AND duration_ms > 1000 AND NOT starts_with(lower(ltrim(query_sql)), 'system') ORDER BY duration_ms DESC, query_time LIMIT 50"))
def k3(spark, sf):
    return N.slow_queries(A.query_log(spark, sf), at(AS_OF), slow_ms=1000, hours=24)


@query("P7_open_alerts", sql("alert_events", "SELECT alert_id, fired_at FROM alert_events WHERE resolved = 0"))
def p7(spark, sf):
    return A.alert_events(spark, sf).filter("resolved = 0").select("alert_id", "fired_at")


@query("P8_alert_search", sql("alert_events", f"SELECT alert_id, fired_at, severity, source FROM alert_events WHERE fired_at >= {NOW} - INTERVAL 72 HOUR AND severity IN ('P1', 'P2') AND source IN ('rule_engine', 'drift_monitor') ORDER BY fired_at DESC, alert_id LIMIT 200"))
def p8(spark, sf):
    return R.search(A.alert_events(spark, sf), at(AS_OF), ["P1", "P2"], ["rule_engine", "drift_monitor"], 72).select("alert_id", "fired_at", "severity", "source")


SIMILAR = "incidents AS (SELECT alert_id, fired_at, title FROM alert_events WHERE resolved = 1 AND (contains(lower(title), 'metric_3') OR contains(lower(title), 'node 2')) ORDER BY fired_at DESC, alert_id LIMIT 3)"


@query("P9_similar_incidents", sql("alert_events", f", {SIMILAR} SELECT * FROM incidents"))
def p9(spark, sf):
    return R.similar_incidents(A.alert_events(spark, sf), ["metric_3", "Node 2", "x"]).select("alert_id", "fired_at", "title")


@query("P9_commonest_action", sql("alert_events decision_log", ", r AS (SELECT action_type FROM decision_log WHERE alert_id IN (SELECT alert_id FROM alert_events WHERE resolved = 1)) SELECT (SELECT action_type FROM r GROUP BY 1 ORDER BY count(*) DESC, action_type LIMIT 1) AS action_type, count(*) AS decisions FROM r"))
def p9a(spark, sf):
    return R.commonest_action(A.alert_events(spark, sf).filter("resolved = 1"), A.decision_log(spark, sf))


UNIFIED = "SELECT alert_id, fired_at, severity, metric_name, 'system' AS category, source, current_value, threshold_value, resolved FROM alert_events"


@query("U2_unified_alerts", sql("alert_events dirty_orders", f"{UNIFIED} UNION ALL SELECT 'q' || order_id, event_time, 'P2', 'price', 'quality', 'quality_gate', price, 0.0::DOUBLE, 0 FROM dirty_orders WHERE price < 0"))
def u2(spark, sf):
    system = A.alert_events(spark, sf).select("alert_id", "fired_at", "severity", "metric_name", F.lit("system").alias("category"), "source", "current_value", "threshold_value", "resolved")
    quality = A.dirty_orders(spark, sf).filter("price < 0").select(
        F.concat(F.lit("q"), "order_id").alias("alert_id"), F.col("event_time").alias("fired_at"), F.lit("P2").alias("severity"), F.lit("price").alias("metric_name"), F.lit("quality").alias("category"),
        F.lit("quality_gate").alias("source"), F.col("price").alias("current_value"), F.lit(0.0).alias("threshold_value"), F.lit(0).alias("resolved"),
    )
    return system.unionByName(quality)


PASSING = """passing AS (SELECT fingerprint, min(fired_at) AS t FROM alert_events GROUP BY 1
    UNION ALL SELECT a.fingerprint, min(a.fired_at) FROM passing p JOIN alert_events a ON a.fingerprint = p.fingerprint AND a.fired_at >= p.t + INTERVAL 86400 SECOND GROUP BY 1)"""


@query("W12_dedup_alerts", sql("alert_events", f", {PASSING} SELECT min(alert_id) AS alert_id, fired_at, a.fingerprint FROM alert_events a JOIN passing p ON a.fingerprint = p.fingerprint AND fired_at = t GROUP BY 2, 3"))
def w12(spark, sf):
    """Which alerts pass depends on the last that passed."""
    return R.dedup_alerts(A.alert_events(spark, sf), 86_400).select("alert_id", "fired_at", "fingerprint")


@query("W13_by_severity", sql("alert_events", "SELECT alert_id, CAST(substr(severity, 2) AS INT) - 1 AS severity_rank FROM alert_events"))
def w13(spark, sf):
    return R.by_severity(A.alert_events(spark, sf)).select("alert_id", worst_first(F.col("severity")).alias("severity_rank"))


@query("W14_action_gate", sql("decision_log", f"""SELECT *, CASE WHEN recent < hour_limit THEN 1 ELSE 0 END AS may_run FROM (
    SELECT a.alert_id, a.action_type, a.risk_level, CASE a.risk_level WHEN 'low' THEN 10 WHEN 'medium' THEN 3 WHEN 'high' THEN 1 ELSE 0 END AS hour_limit,
        (SELECT count(*) FROM decision_log b WHERE b.action_type = a.action_type AND {RAN} AND b.log_time >= a.log_time - INTERVAL 1 HOUR AND b.log_time < a.log_time) AS recent FROM decision_log a)"""))
def w14(spark, sf):
    return R.gate_actions(A.decision_log(spark, sf)).select("alert_id", "action_type", "risk_level", "hour_limit", "recent", "may_run")
