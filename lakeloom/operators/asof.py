"""As-of (point-in-time) joins: one shuffle for any number of features, and no hot entity in one task.

Labels and feature rows are united and ordered by time inside (entity, time bucket); a running ``last`` gives
each label the latest value at or before its time. What the bucket itself lacks is carried over from earlier
buckets, by a window over one row for each (entity, bucket). Both read one exchange, so labels and features are scanned
and moved once. Rows without a key or a time find nothing: those of the features are left out, and labels are
spread over buckets of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: dict[str, Column], tie: str, bucket_seconds: int = 7 * 86_400
) -> DataFrame:
    """left with a column for each of values: a struct (time, value) of the latest right row at or before its time.

    values: expressions over right, null where a row has no such value. Ties in time go to the greatest
    ``tie``. Rows of left are kept as they are, repeated ones too; null keys or times match nothing.
    """
    known = lambda time: reduce(Column.__and__, (F.col(c).isNotNull() for c in (*keys, time)))
    # neither the struct of the keys nor the bucket is ever null, so the join below filters neither of its sides anew
    bucket = lambda t, other: F.coalesce(F.floor(F.unix_timestamp(t) / bucket_seconds), other).alias("_b")
    key = F.struct(*keys).alias("_key")
    names = list(values)
    r = right.filter(known(right_time)).select(
        key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), bucket(right_time, F.lit(0)),
        *(F.when(v.isNotNull(), F.struct(F.col(right_time).alias("time"), v.alias("value"))).alias(f"_v{n}") for n, v in enumerate(values.values())),
    )
    hashed = [c for c, kind in left.dtypes if "map<" not in kind]
    apart = F.lit(-(2**40)) - F.pmod(F.xxhash64(*hashed), F.lit(4096))  # no bucket of a time
    l = left.select(key, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), bucket(F.when(known(left_time), F.col(left_time)), apart))  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True).repartition("_key", "_b")
    run = Window.partitionBy("_key", "_b").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({f"_v{n}": F.last(f"_v{n}", ignorenulls=True).over(run) for n in range(len(names))}).filter("_side = 1")
    # buckets of labels count too, though they add no value: what earlier ones hold is carried to each of them
    latest = both.groupBy("_key", "_b").agg(F.count("_row").alias("_labels"), *(F.max_by(f"_v{n}", F.when(F.col(f"_v{n}").isNotNull(), F.struct("_side", "_t", "_tie"))).alias(f"_v{n}") for n in range(len(names))))
    before = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select("_key", "_b", "_labels", *(F.last(f"_v{n}", ignorenulls=True).over(before).alias(f"_c{n}") for n in range(len(names)))).filter("_labels > 0").drop("_labels")
    out = seen.join(carried, ["_key", "_b"], "left")
    return out.select("_row.*", *(F.coalesce(f"_v{n}", f"_c{n}").alias(name) for n, name in enumerate(names)))


def point_in_time(labels: DataFrame, history: DataFrame, features: list[str], label_time: str = "event_time", ttl_seconds: int | None = None) -> DataFrame:
    """labels with the latest value of each feature at or before their time, one column a feature.

    history is long: entity_id, feature_name, feature_value, feature_time, version. With a ttl, older
    values are null.
    """
    rows = history.filter(F.col("feature_name").isin(features))
    found = asof_join(labels, rows, ["entity_id"], label_time, "feature_time", {f"_f{n}": F.when(F.col("feature_name") == f, F.col("feature_value")) for n, f in enumerate(features)}, "version")

    def value(n: int) -> Column:
        x = F.col(f"_f{n}")
        if ttl_seconds is None:
            return x["value"]
        return F.when(F.unix_micros(F.col(label_time)) - F.unix_micros(x["time"]) <= ttl_seconds * 1_000_000, x["value"])

    return found.select(*labels.columns, *(value(n).alias(f) for n, f in enumerate(features)))


def training_set(labels: DataFrame, history: DataFrame, features: dict[str, list[str]], defaults: dict[tuple[str, str], float]) -> DataFrame:
    """Features of several groups, as columns group__feature; missing values take their default, if there is one."""
    named = history.withColumn("feature_name", F.concat_ws("__", "group_name", "feature_name"))
    wide = [f"{g}__{f}" for g, fs in features.items() for f in fs]
    out = point_in_time(labels, named, wide)
    fill = {f"{g}__{f}": v for (g, f), v in defaults.items() if f"{g}__{f}" in wide}
    return out.fillna(fill) if fill else out


def values_at(history: DataFrame, entities: DataFrame, features: list[str], as_of: Column) -> DataFrame:
    """One row for each entity of a list: its features' values at one time, missing ones null."""
    rows = history.filter((F.col("feature_time") <= as_of) & F.col("feature_name").isin(features))
    order = F.struct("feature_time", "version")
    is_ = lambda f: F.col("feature_name") == f
    wide = rows.groupBy("entity_id").agg(*(F.max_by(F.when(is_(f), F.col("feature_value")), F.when(is_(f), order)).alias(f) for f in features))
    return entities.select("entity_id").distinct().join(wide, "entity_id", "left")
