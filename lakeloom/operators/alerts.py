"""Alerts: rules over metrics, detectors, dedup, silencing, and what is computed of past alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SEVERITIES, ago, fingerprint, ratio, settle, worst_first

#: (metric, operator, threshold, severity) of the threshold rules.
THRESHOLDS = [
    ("order_cnt", "lt", 1.0, "P1"),
    ("total_gmv", "lt", 1000.0, "P2"),
    ("cancel_rate", "gt", 0.15, "P2"),
    ("avg_price", "gt", 200.0, "P3"),
    ("unique_customers", "lte", 10.0, "P3"),
    ("max_lag", "gte", 100_000.0, "P2"),
]
#: Executions in an hour that a risk allows.
RATE_LIMITS = {"low": 10, "medium": 3, "high": 1, "critical": 0}
ALERT = ("source", "category", "severity", "metric_name", "current_value", "threshold_value")


def compare(value: Column, op: Column, threshold: Column) -> Column:
    out = F.when(op == "gt", value > threshold)
    for name, test in (("lt", value < threshold), ("eq", value == threshold), ("ne", value != threshold), ("gte", value >= threshold), ("lte", value <= threshold)):
        out = out.when(op == name, test)
    return out


def threshold_alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """metrics (metric_name, value) against rules (metric_name, op, threshold, severity); a null value is skipped."""
    hit = metrics.join(rules, "metric_name").filter(F.col("value").isNotNull() & compare(F.col("value"), F.col("op"), F.col("threshold")))
    return hit.select(F.lit("rule_engine").alias("source"), F.lit("BUSINESS").alias("category"), "severity", "metric_name", F.col("value").alias("current_value"), F.col("threshold").alias("threshold_value"))


def metric_rows(row: DataFrame, names: list[str]) -> DataFrame:
    """One row of metrics as (metric_name, value) rows."""
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric_name"), F.col(n).cast("double").alias("value")) for n in names))))


def gmv_drop(two: DataFrame) -> DataFrame:
    """Of two_periods: a fall by 20 percent is P2, by more than 35 P1."""
    change = ratio(F.col("current_gmv") - F.col("base_gmv"), F.col("base_gmv"))
    severity = F.when(change < -0.35, "P1").when(change <= -0.20, "P2")
    return two.select(F.lit("rule_engine").alias("source"), F.lit("BUSINESS").alias("category"), severity.alias("severity"), F.lit("gmv_drop").alias("metric_name"), change.alias("current_value"), F.lit(-0.2).alias("threshold_value")).filter("severity IS NOT NULL")


def cancel_rise(two: DataFrame) -> DataFrame:
    """Of two_periods: a cancel rate of 0.30 or more that rose by 10 points is P2, above 0.50 P1."""
    now, before = ratio(F.col("current_canceled"), F.col("current_orders")), ratio(F.col("base_canceled"), F.col("base_orders"))
    severity = F.when((now >= 0.30) & (now - F.coalesce(before, F.lit(0.0)) >= 0.10), F.when(now > 0.50, "P1").otherwise("P2"))
    return two.select(F.lit("rule_engine").alias("source"), F.lit("BUSINESS").alias("category"), severity.alias("severity"), F.lit("cancel_rise").alias("metric_name"), now.alias("current_value"), F.lit(0.3).alias("threshold_value")).filter("severity IS NOT NULL")


def category_drop(changes: DataFrame) -> DataFrame:
    """Of period_over_period: a fall by more than 40 percent is P2, by more than 60 P1."""
    severity = F.when(F.col("change") < -0.60, "P1").when(F.col("change") < -0.40, "P2")
    return changes.select(F.lit("rule_engine").alias("source"), F.col("product_category").alias("category"), severity.alias("severity"), F.lit("category_drop").alias("metric_name"), F.col("change").alias("current_value"), F.lit(-0.4).alias("threshold_value")).filter("severity IS NOT NULL")


def lag_by_group(lag: DataFrame, limit: int = 50_000) -> DataFrame:
    """Groups, replay aside, whose largest lag passes the limit."""
    g = lag.filter("is_replay = 0").groupBy("consumer_group").agg(F.max("lag").alias("max_lag"), F.avg("lag").alias("avg_lag"), F.count("*").alias("samples"))
    return g.filter(F.col("max_lag") > limit)


def lag_alerts(groups: DataFrame) -> DataFrame:
    severity = F.when(F.col("max_lag") > 200_000, "P1").otherwise("P2")
    return groups.select(F.lit("rule_engine").alias("source"), F.col("consumer_group").alias("category"), severity.alias("severity"), F.lit("consumer_lag").alias("metric_name"), F.col("max_lag").cast("double").alias("current_value"), F.lit(50_000.0).alias("threshold_value"))


def quality_alerts(scores: DataFrame, time: str, score: str, as_of: Column, minutes: int = 30) -> DataFrame:
    """Mean score of the last minutes: under 70 is P3, under 50 P2."""
    g = scores.filter((F.col(time) >= ago(as_of, minutes=minutes)) & (F.col(time) < as_of)).agg(F.avg(score).alias("v"))
    severity = F.when(F.col("v") < 50, "P2").when(F.col("v") < 70, "P3")
    return g.select(F.lit("rule_engine").alias("source"), F.lit("DATA").alias("category"), severity.alias("severity"), F.lit("quality_score").alias("metric_name"), F.col("v").alias("current_value"), F.lit(70.0).alias("threshold_value")).filter("severity IS NOT NULL")


def failed_jobs(jobs: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    """A P1 alert for each replay job that failed in the last minutes."""
    hit = jobs.filter((F.col("status") == "failed") & (F.col("finished_at") >= ago(as_of, minutes=minutes)) & (F.col("finished_at") < as_of))
    return hit.select(F.lit("rule_engine").alias("source"), F.lit("INFRA").alias("category"), F.lit("P1").alias("severity"), F.concat(F.lit("replay_job_"), "job_id").alias("metric_name"), F.lit(1.0).alias("current_value"), F.lit(0.0).alias("threshold_value"))


def drift_alerts(report: DataFrame) -> DataFrame:
    return report.filter("is_drifted = 1").select(F.lit("drift_monitor").alias("source"), F.lit("DATA").alias("category"), F.lit("P3").alias("severity"), F.concat_ws(".", "group_name", "feature_name").alias("metric_name"), F.col("psi").alias("current_value"), F.lit(0.25).alias("threshold_value"))


def union_alerts(parts: list[DataFrame]) -> DataFrame:
    """Outputs of detectors in one frame, with their fingerprint."""
    return reduce(DataFrame.unionByName, (p.select(*ALERT) for p in parts)).withColumn("fingerprint", fingerprint(F.col("source"), F.col("metric_name"), F.col("category")))


def by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(worst_first(F.col("severity")), "fingerprint")


DAY_US = 86_400_000_000


def dedup_alerts(alerts: DataFrame, window_seconds: int = 900) -> DataFrame:
    """Alerts that pass: those of a fingerprint within the window of the last one that passed are dropped.

    What passes depends on what passed before, so each time of a fingerprint gets a pointer to the next that would pass
    after it: the first at or behind the window's end. Pointers are doubled, each round joining those of the round before with
    themselves, until none leads on; then what lies on the way from a fingerprint's first time is marked from the
    longest jumps to the shortest. All joins are by fingerprint and time, so a frequent fingerprint is spread over all tasks, and rounds
    are the logarithm of the most alerts of one that pass.

    Of alerts of one time the one of the smallest id passes. Null times don't pass; null fingerprints are one fingerprint.
    """
    spark, width = alerts.sparkSession, window_seconds * 1_000_000
    named = alerts.filter("fired_at IS NOT NULL").withColumns({"_f": F.coalesce(F.concat(F.lit("="), "fingerprint"), F.lit("")), "_us": F.unix_micros("fired_at")})
    if width <= 0:
        return named.select(*alerts.columns)
    times = named.select("_f", "_us").distinct()
    jumps = [settle(spark, next_times(times, width))]
    while jumps[-1].filter("_next IS NOT NULL").limit(1).count():
        here = jumps[-1]
        there = here.select("_f", F.col("_us").alias("_next"), F.col("_next").alias("_onward"))
        jumps.append(settle(spark, here.join(there, ["_f", "_next"], "left").select("_f", "_us", F.col("_onward").alias("_next"))))
    passed = times.groupBy("_f").agg(F.min("_us").alias("_us"))
    for jump in reversed(jumps[:-1]):
        passed = settle(spark, passed.unionByName(passed.join(jump, ["_f", "_us"]).filter("_next IS NOT NULL").select("_f", F.col("_next").alias("_us"))))
    first = F.row_number().over(Window.partitionBy("_f", "_us").orderBy("alert_id"))
    return named.join(passed, ["_f", "_us"], "left_semi").withColumn("_nr", first).filter("_nr = 1").select(*alerts.columns)


def next_times(times: DataFrame, width: int) -> DataFrame:
    """_f, _us and _next: the first of the fingerprint's times at or behind _us + width, null if there is none.

    Times and the ends of their windows are merged in order inside (fingerprint, day); what a day lacks comes from a window over
    one row for each (fingerprint, day).
    """
    both = times.select("_f", F.explode(F.array(F.struct(F.col("_us").alias("at"), F.col("_us").alias("time"), F.lit(None).cast("long").alias("of")), F.struct((F.col("_us") + width).alias("at"), F.lit(None).cast("long").alias("time"), F.col("_us").alias("of")))).alias("x"))
    both = both.select("_f", "x.*").withColumn("day", F.floor(F.col("at") / DAY_US))
    days = both.groupBy("_f", "day").agg(F.min("time").alias("first"))
    later = F.min("first").over(Window.partitionBy("_f").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1))
    days = days.withColumn("later", later).select("_f", "day", "later")
    inside = F.min("time").over(Window.partitionBy("_f", "day").orderBy(F.desc("at"), F.col("of").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("own", inside).filter("of IS NOT NULL").join(days, ["_f", "day"])
    return found.select("_f", F.col("of").alias("_us"), F.coalesce("own", "later").alias("_next"))


def silence(alerts: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """Alerts that no unexpired rule silences: source equal or blank, and metric containing or blank.

    Rules are gathered by source, and what they silence is found on the distinct (source, metric) of the alerts,
    so that all joins are of equal keys. Null sources and metrics count as blank ones of an alert.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    active = rules.filter(F.col("expires_at") > as_of).groupBy(F.col("source").alias("_s")).agg(F.collect_set("metric").alias("_m"))
    named = alerts.withColumns({"_source": blank(F.col("source")), "_metric": blank(F.col("metric_name"))})
    pairs = named.select("_source", "_metric").distinct()
    asked = pairs.withColumn("_s", F.explode(F.array_distinct(F.array(F.col("_source"), F.lit("")))))
    silent = asked.join(active, "_s").filter(F.exists("_m", lambda m: F.contains(F.col("_metric"), m))).select("_source", "_metric").distinct()
    return named.join(silent, ["_source", "_metric"], "left_anti").select(*alerts.columns)


def open_with_outcome(alerts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Alerts on which no decision succeeded yet: decisions are aggregated before the join."""
    done = decisions.groupBy("alert_id").agg(F.max("success").alias("success"), F.count("*").alias("decisions"))
    return alerts.join(done, "alert_id", "left").filter(F.coalesce("success", F.lit(0)) == 0).withColumn("decisions", F.coalesce("decisions", F.lit(0)))


def severity_and_type_counts(alerts: DataFrame) -> DataFrame:
    """Counts by severity and by source, as one pass of grouping sets."""
    g = alerts.groupingSets([[F.col("severity")], [F.col("source")]], "severity", "source").agg(F.count("*").alias("alert_cnt"))
    return g


def hourly_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.date_trunc("hour", "fired_at").alias("hour_start"), "severity", "source").agg(F.count("*").alias("alert_cnt"))


def action_success(decisions: DataFrame) -> DataFrame:
    ran = (F.col("allowed") == 1) & (F.col("dry_run") == 0)
    return decisions.groupBy(F.to_date("log_time").alias("day"), "skill_name", "action_type", "risk_level").agg(
        F.count("*").alias("total"), F.count_if(F.col("allowed") == 1).alias("allowed_cnt"), F.count_if(ran).alias("executed_cnt"), F.count_if(ran & (F.col("success") == 1)).alias("success_cnt"),
        ratio(F.count_if(ran & (F.col("success") == 1)), F.count_if(ran)).alias("success_rate"),
    )


def noisy_alerts(alerts: DataFrame, k: int = 20) -> DataFrame:
    """The commonest fingerprints with their last time and worst severity."""
    worst = F.array_min(F.collect_set(F.struct(worst_first(F.col("severity")).alias("n"), "severity")))["severity"]
    g = alerts.groupBy("fingerprint", "source", "metric_name").agg(F.count("*").alias("alert_cnt"), F.max("fired_at").alias("last_fired"), worst.alias("worst_severity"))
    return g.orderBy(F.desc("alert_cnt"), "fingerprint").limit(k)


def alert_days(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.to_date("fired_at").alias("day"), "metric_name", "severity").agg(F.count("*").alias("alert_cnt"), F.sum("resolved").alias("resolved_cnt"))


def outcome_counts(alerts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Alerts by what came of them."""
    d = decisions.groupBy("alert_id").agg(F.max("success").alias("success"), F.max("allowed").alias("allowed"))
    j = alerts.join(d, "alert_id", "left")
    return j.agg(
        F.count("*").alias("total"), F.count_if(F.col("resolved") == 1).alias("resolved_cnt"), F.count_if((F.col("resolved") == 0) & F.col("success").isNotNull()).alias("monitoring_cnt"),
        F.count_if((F.col("resolved") == 0) & F.col("success").isNull()).alias("escalated_cnt"), F.count_if(F.col("success") == 1).alias("success_cnt"),
    )


def gate_actions(decisions: DataFrame) -> DataFrame:
    """Whether each action may run: fewer executions of its type in the hour up to it than its risk allows.

    Executions are counted by type and time first; a frame over the hour before then runs inside (type, hour), where
    each hour also has the rows of the one before it, so a type with very many actions is spread over its hours.
    """
    hour = 3_600_000_000
    ran = (F.col("allowed") == 1) & (F.col("dry_run") == 0)
    us = F.unix_micros("log_time")
    per = decisions.groupBy("action_type", us.alias("_us")).agg(F.count_if(ran).alias("_n"))
    own = F.floor(F.col("_us") / hour)
    spread = per.withColumn("_own", own).withColumn("_hour", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy("action_type", "_hour").orderBy("_us").rangeBetween(-hour, -1)
    recent = spread.withColumn("recent", F.coalesce(F.sum("_n").over(w), F.lit(0))).filter("_hour = _own").select("action_type", "_us", "recent")
    limit = F.lit(None).cast("int")
    for risk, n in RATE_LIMITS.items():
        limit = F.when(F.col("risk_level") == risk, n).otherwise(limit)
    out = decisions.withColumn("_us", us).join(recent, ["action_type", "_us"], "left").drop("_us").withColumns({"hour_limit": limit, "recent": F.coalesce("recent", F.lit(0))})
    return out.withColumn("may_run", F.when(F.col("recent") < F.coalesce("hour_limit", F.lit(0)), 1).otherwise(0))


def search(alerts: DataFrame, as_of: Column, severities: list[str] | None = None, sources: list[str] | None = None, hours: int = 24, limit: int = 200) -> DataFrame:
    out = alerts.filter(F.col("fired_at") >= ago(as_of, hours=hours))
    if severities:
        out = out.filter(F.col("severity").isin(severities))
    if sources:
        out = out.filter(F.col("source").isin(sources))
    return out.orderBy(F.desc("fired_at"), "alert_id").limit(limit)


def similar_incidents(alerts: DataFrame, words: list[str], limit: int = 3) -> DataFrame:
    """Newest resolved alerts whose title holds one of up to three words of two letters or more."""
    words = [w for w in words if len(w) >= 2][:3]
    if not words:
        return alerts.limit(0)
    hit = reduce(Column.__or__, (F.contains(F.lower("title"), F.lit(w.lower())) for w in words))
    return alerts.filter((F.col("resolved") == 1) & hit).orderBy(F.desc("fired_at"), "alert_id").limit(limit)


def commonest_action(incidents: DataFrame, decisions: DataFrame) -> DataFrame:
    """The action taken most often on some incidents; of equally common ones the first by name."""
    return decisions.join(incidents.select("alert_id"), "alert_id", "left_semi").agg(F.mode("action_type", True).alias("action_type"), F.count("*").alias("decisions"))


def assert_severities(alerts: DataFrame) -> DataFrame:
    """alerts, with an error if a severity isn't known."""
    ok = F.col("severity").isin(*SEVERITIES)
    return alerts.withColumn("severity", F.when(ok, F.col("severity")).otherwise(F.raise_error(F.concat(F.lit("unknown severity "), "severity")).cast("string")))
