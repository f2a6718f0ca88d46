"""Distributions, drift, forecasts, trends, outliers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ago, money, ratio, rounded

EPSILON = 1e-6
STABLE, DRIFTED, NULL_LIMIT = 0.1, 0.25, 0.3


def distribution(values: DataFrame, keys: list[str], value: str, exact: bool = True) -> DataFrame:
    """Count, mean, population deviation, extremes, p50, p95 and the rate of null or zero values by key.

    Exact percentiles hold a key's distinct values in one task; ``exact=False`` estimates them in fixed space.
    """
    pct = (lambda p: F.percentile(value, F.lit(p))) if exact else (lambda p: F.percentile_approx(value, F.lit(p), 10_000).cast("double"))
    empty = F.col(value).isNull() | (F.col(value) == 0)
    return values.groupBy(*keys).agg(
        F.count("*").alias("cnt"), ratio(F.sum(F.col(value).cast("decimal(18,4)")), F.count(value)).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        pct(0.5).alias("p50"), pct(0.95).alias("p95"), ratio(F.count_if(empty), F.count("*")).alias("null_rate"),
    )


def bucket_of(value: Column, low: Column, high: Column, buckets: int = 10) -> Column:
    """Equal-width bucket 1..buckets, clamped; all in 1 where the bounds are equal. Null stays null."""
    raw = F.floor((value - low) / F.nullif(high - low, F.lit(0.0)) * buckets) + 1
    return F.when(value.isNotNull(), F.least(F.greatest(F.coalesce(raw, F.lit(1)), F.lit(1)), F.lit(buckets)))


def histogram(values: DataFrame, keys: list[str], value: str, bounds: DataFrame, buckets: int = 10) -> DataFrame:
    """Share of each bucket by key; bounds: keys, low, high, one row a key."""
    binned = values.filter(F.col(value).isNotNull()).join(bounds, keys).withColumn("bucket", bucket_of(F.col(value), F.col("low"), F.col("high"), buckets))
    counts = binned.groupBy(*keys, "bucket").agg(F.count("*").alias("cnt"))
    return counts.withColumn("share", ratio(F.col("cnt"), F.sum("cnt").over(Window.partitionBy(*keys))))


def psi(expected: DataFrame, actual: DataFrame, keys: list[str], buckets: int = 10) -> DataFrame:
    """Population stability index by key of two histograms: sum of (p - q) ln(p / q), shares floored."""
    grid = expected.select(*keys).union(actual.select(*keys)).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(buckets).cast("long"))))
    share = lambda h, name: h.select(*keys, "bucket", F.col("share").alias(name))
    both = grid.join(share(expected, "q"), [*keys, "bucket"], "left").join(share(actual, "p"), [*keys, "bucket"], "left")
    p, q = (F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(EPSILON)) for c in "pq")
    return both.groupBy(*keys).agg(rounded(F.sum(F.round((p - q) * F.log(p / q), 12).cast("decimal(20,12)")).cast("double"), 6).alias("psi"))


def psi_label(x: Column) -> Column:
    return F.when(x < STABLE, "stable").when(x < DRIFTED, "monitor").otherwise("drift")


def drift_report(history: DataFrame, as_of: Column, hours: int = 24, baseline_hours: int = 168) -> DataFrame:
    """Every feature's last hours against the days before them: PSI, label, null rate, drift flag.

    One job over all features: bounds by feature (a row each) come from the baseline, values outside are
    clamped to the outer buckets.
    """
    keys, t = ["group_name", "feature_name"], F.col("feature_time")
    now = history.filter((t >= ago(as_of, hours=hours)) & (t < as_of))
    base = history.filter((t >= ago(as_of, hours=baseline_hours)) & (t < ago(as_of, hours=hours)))
    bounds = base.groupBy(*keys).agg(F.min("feature_value").alias("low"), F.max("feature_value").alias("high"))
    index = psi(histogram(base, keys, "feature_value", bounds), histogram(now, keys, "feature_value", bounds), keys)
    empty = F.col("feature_value").isNull() | (F.col("feature_value") == 0)
    nulls = now.groupBy(*keys).agg(F.count("*").alias("current_cnt"), ratio(F.count_if(empty), F.count("*")).alias("null_rate"))
    out = index.join(nulls, keys, "left").withColumn("label", psi_label(F.col("psi")))
    drifted = (F.col("psi") >= DRIFTED) | (F.coalesce("null_rate", F.lit(0.0)) > NULL_LIMIT)
    return out.withColumn("is_drifted", F.when(drifted, 1).otherwise(0)).withColumn("check_time", as_of)


def drift_latest(reports: DataFrame, as_of: Column, hours: int = 168) -> DataFrame:
    """The newest report of each feature within a lookback."""
    from .versioned import newest_n_by

    recent = reports.filter(F.col("check_time") > ago(as_of, hours=hours))
    return newest_n_by(recent, ["group_name", "feature_name"], [F.desc("check_time")])


def holt(values: Column, horizon: int = 10, alpha: float = 0.35, beta: float = 0.10) -> Column:
    """Double exponential smoothing of an array in time order: array of (horizon, predicted, lower, upper).

    Under four points: the last value, give or take 20 percent. Forecasts and bounds are 0 or more. The
    recurrence is one fold over the array; series are independent rows.
    """
    z = F.lit(0.0)
    start = F.struct(values[0].alias("level"), (values[1] - values[0]).alias("trend"), z.alias("sq"), F.lit(0).alias("n"))

    def step(s: Column, v: Column) -> Column:
        guess = s["level"] + s["trend"]
        level = F.lit(alpha) * v + F.lit(1 - alpha) * guess
        trend = F.lit(beta) * (level - s["level"]) + F.lit(1 - beta) * s["trend"]
        return F.struct(level.alias("level"), trend.alias("trend"), (s["sq"] + (v - guess) * (v - guess)).alias("sq"), (s["n"] + 1).alias("n"))

    state = F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), start, step)
    margin = F.lit(1.96) * F.sqrt(ratio(state["sq"], state["n"]))

    def ahead(i: Column) -> Column:
        point = F.greatest(state["level"] + i * state["trend"], z)
        wide = margin * (F.lit(1.0) + F.lit(0.1) * (i - 1))  # steps count from 0 here
        return F.struct(i.alias("horizon"), point.alias("predicted"), F.greatest(point - wide, z).alias("lower_bound"), (point + wide).alias("upper_bound"))

    steps = F.sequence(F.lit(1), F.lit(horizon))
    last = F.try_element_at(values, F.lit(-1))
    flat = F.transform(steps, lambda i: F.struct(i.alias("horizon"), last.alias("predicted"), (last * 0.8).alias("lower_bound"), (last * 1.2).alias("upper_bound")))
    return F.when(F.size(values) < 4, flat).otherwise(F.transform(steps, ahead))


def forecast(series: DataFrame, keys: list[str], time: str, value: str, lookback: int = 60, horizon: int = 10, min_points: int = 4) -> DataFrame:
    """Forecast rows of each series from its last points; shorter series give none.

    A window keeps the last points of a series before they are gathered, so an array has lookback entries.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc(time))
    recent = series.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= lookback)
    rows = recent.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(time, value))), lambda x: x[value]).alias("v"), F.max(time).alias("last_time"))
    out = rows.filter(F.size("v") >= min_points).select(*keys, "last_time", F.inline(holt(F.col("v"), horizon)))
    return out.withColumns({c: rounded(F.col(c), 2) for c in ("predicted", "lower_bound", "upper_bound")})


def forecast_rows(forecasts: DataFrame, step: str) -> DataFrame:
    """Forecasts with the time they are for."""
    return forecasts.withColumn("forecast_time", F.col("last_time") + F.col("horizon") * F.expr(f"INTERVAL {step}"))


def upcoming(forecasts: DataFrame, as_of: Column, horizon: int) -> DataFrame:
    return forecasts.filter((F.col("forecast_time") > as_of) & (F.col("horizon") <= horizon)).orderBy("forecast_time")


def actual_and_forecast(actual: DataFrame, forecasts: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Actual values and forecast ones in one frame, tagged."""
    a = actual.select(*keys, F.col(time).alias("time"), F.col(value).alias("value"), F.lit("actual").alias("kind"))
    return a.unionByName(forecasts.select(*keys, F.col("forecast_time").alias("time"), F.col("predicted").alias("value"), F.lit("forecast").alias("kind")))


def linear_trend(points: DataFrame, keys: list[str], time: str, value: str, last: int, ahead_seconds: int, min_points: int = 3) -> DataFrame:
    """Slope a second by least squares over the last points, and the value it leads to after ahead_seconds."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(value))
    recent = points.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= last)
    first = Window.partitionBy(*keys)
    x = (F.unix_micros(F.col(time)) - F.min(F.unix_micros(F.col(time))).over(first)) / 1_000_000
    g = recent.withColumn("_x", x).groupBy(*keys).agg(
        F.count("*").alias("points"), F.regr_slope(F.col(value).cast("double"), "_x").alias("slope"), F.regr_intercept(F.col(value).cast("double"), "_x").alias("intercept"), F.max("_x").alias("_last")
    )
    return g.filter(F.col("points") >= min_points).withColumn("predicted", F.col("intercept") + F.col("slope") * (F.col("_last") + ahead_seconds)).drop("_last")


def half_trend(stats: DataFrame, time: str, value: str, flag: float = 0.15, min_points: int = 6) -> DataFrame:
    """Mean of the second half of a window against the first; stats are the few rows of one window."""
    order, whole = Window.orderBy(time), Window.partitionBy()
    rows = stats.withColumn("_n", F.row_number().over(order)).withColumn("_all", F.count("*").over(whole))
    first = F.col("_n") <= F.floor(F.col("_all") / 2)
    mean = lambda inside: ratio(money(F.when(inside, F.col(value))), F.count_if(inside))
    g = rows.agg(F.count("*").alias("points"), mean(first).alias("first_mean"), mean(~first).alias("second_mean")).filter(F.col("points") >= min_points)
    change = ratio(F.col("second_mean") - F.col("first_mean"), F.col("first_mean"))
    return g.withColumn("change", change).withColumn("is_trend", F.when(F.abs("change") >= flag, 1).otherwise(0))


def two_sided_outliers(stats: DataFrame, time: str, value: str, sigmas: float = 2.0) -> DataFrame:
    """Rows further from the mean than so many sample deviations, with their z rounded to 2 digits.

    The moments come from one aggregate row, joined back: no window over all rows.
    """
    moments = stats.agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    z = ratio(F.col(value) - F.col("_mean"), F.col("_std"))
    return stats.join(F.broadcast(moments)).withColumn("z", rounded(z, 2)).filter(F.abs(z) > sigmas).select(time, value, "z")


def recent_drop(stats: DataFrame, time: str, metrics: list[str], as_of: Column, start_min: int = 60, recent_min: int = 5, min_points: int = 10, sigmas: float = 2.0) -> DataFrame:
    """Metrics whose recent mean fell under the baseline's by so many deviations: one pass, a row for each metric."""
    t = F.col(time)
    base, now = (t >= ago(as_of, minutes=start_min)) & (t < ago(as_of, minutes=recent_min)), (t >= ago(as_of, minutes=recent_min)) & (t < as_of)
    aggs = []
    for m in metrics:
        aggs += [F.count(F.when(base, F.col(m))).alias(f"{m}_n"), F.avg(F.when(base, F.col(m))).alias(f"{m}_mean"), F.stddev_samp(F.when(base, F.col(m))).alias(f"{m}_std"), F.avg(F.when(now, F.col(m))).alias(f"{m}_now")]
    cells = F.array(*(F.struct(F.lit(m).alias("metric_name"), F.col(f"{m}_n").alias("points"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_std").alias("std"), F.col(f"{m}_now").alias("current")) for m in metrics))
    rows = stats.filter((t >= ago(as_of, minutes=start_min)) & (t < as_of)).agg(*aggs).select(F.inline(cells))
    return rows.withColumn("is_drop", F.when((F.col("points") >= min_points) & (F.col("current") < F.col("mean") - sigmas * F.col("std")), 1).otherwise(0))


def sliding_outliers(stats: DataFrame, keys: list[str], time: str, value: str, window_seconds: int = 1800, gap_seconds: int = 60, sigmas: float = 2.0) -> DataFrame:
    """Rows beyond so many deviations of the sliding window that ends gap_seconds before them."""
    w = Window.partitionBy(*keys).orderBy(F.unix_timestamp(F.col(time))).rangeBetween(-window_seconds, -gap_seconds)
    rows = stats.withColumn("mean", F.avg(value).over(w)).withColumn("std", F.stddev_samp(value).over(w))
    return rows.filter(F.abs(F.col(value) - F.col("mean")) > sigmas * F.col("std")).select(*keys, time, value, "mean", "std")


def population_stability(p: list[float], q: list[float]) -> float:
    """PSI of two lists of shares, for small vectors."""
    return round(sum((max(a, EPSILON) - max(b, EPSILON)) * math.log(max(a, EPSILON) / max(b, EPSILON)) for a, b in zip(p, q)), 6)
