"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "lakeloom", **conf: str) -> SparkSession:
    """UTC time, adaptive execution with skew handling, RocksDB state for streams; conf adds to that or overrides it.

    Names in conf hold underscores for dots.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    builder = SparkSession.builder.appName(app)
    for k, v in (settings | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
