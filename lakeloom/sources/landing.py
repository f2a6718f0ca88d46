"""Raw JSON to typed tables: fixed schemas, bad rows dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER_JSON = "order_id string, customer_id string, product_id string, product_category string, seller_id string, price double, freight_value double, order_status string, state string, city string, event_time string, _kafka_offset long"
PAYMENT_JSON = "payment_id string, order_id string, payment_type string, payment_value double, installments int, event_time string"
STATS_JSON = "window_start string, window_end string, order_cnt long, total_gmv double, avg_price double, unique_customers long, top_category string"


def parsed(raw: DataFrame, schema: str, key: str) -> DataFrame:
    """Rows of a JSON text column ``value``; what isn't JSON of the schema, or lacks the key, is skipped."""
    return raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*").filter(F.col(key).isNotNull())


def json_stream(spark: SparkSession, path: str, schema: str, key: str, max_files: int = 100) -> DataFrame:
    """A stream of JSON lines from files. A broker's topic reads alike: only this function names the connector."""
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
    return parsed(raw, schema, key)


def topic_stream(spark: SparkSession, servers: str, topic: str, schema: str, key: str, starting: str = "earliest") -> DataFrame:
    """The same from a Kafka topic; the connector has to be on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).load()
    return parsed(raw.select(F.col("value").cast("string").alias("value")), schema, key)


def timed(df: DataFrame, *columns: str) -> DataFrame:
    """Text times as timestamps; rows whose time can't be read are dropped."""
    for c in columns:
        df = df.withColumn(c, F.try_to_timestamp(F.col(c)))
    return df.dropna(subset=list(columns))


def land_orders(rows: DataFrame) -> DataFrame:
    out = timed(rows, "event_time").filter(F.col("price") >= 0)
    return out.withColumn("_load_date", F.to_date("event_time"))


def land_payments(rows: DataFrame) -> DataFrame:
    return timed(rows, "event_time").filter(F.col("payment_value") >= 0)


def land_minute_stats(rows: DataFrame) -> DataFrame:
    return timed(rows, "window_start", "window_end")


def land_wide(rows: DataFrame) -> DataFrame:
    return timed(rows, "event_time").withColumn("event_date", F.to_date("event_time"))
