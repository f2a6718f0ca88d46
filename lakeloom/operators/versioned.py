"""Versioned tables: the last version of a key wins, explicitly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_version(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row a key: the one with the greatest version columns (list tie-breaks after the version).

    A maximum by struct, so rows are combined before the shuffle and a hot key costs one row a task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*version)).alias("row")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest)).select(*df.columns)


def newest_n_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order that has no ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def latest_values(history: DataFrame, keys: list[str], value: str, time: str, ties: str) -> DataFrame:
    """The value of the latest time for each key, with that time."""
    order = F.struct(time, ties)
    return history.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(time).alias(time))


def retained(df: DataFrame, time: str, seconds: int, as_of: Column) -> DataFrame:
    """Rows that a time to live keeps: time + interval later than as_of."""
    return df.filter(F.col(time) > as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """target with changes merged in: the latest version of each key of both."""
    return latest_version(target.unionByName(changes), keys, version)
