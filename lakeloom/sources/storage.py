"""Files: exports, archives, compaction, idempotent loads, generated data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ago, at, rounded


def write_training_set(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_views(views: dict[str, DataFrame], time: str, start: Column, end: Column, folder: str) -> dict[str, str]:
    """Each view's rows from start to end, both included, as one Parquet data set; gives their paths."""
    out = {}
    for name, df in views.items():
        out[name] = f"{folder}/{name}"
        in_range(df, time, start, end).write.mode("overwrite").parquet(out[name])
    return out


def in_range(df: DataFrame, time: str, start: Column, end: Column) -> DataFrame:
    return df.filter(F.col(time).between(start, end))


def archive(df: DataFrame, time: str, as_of: dt.datetime | Column, days: int, path: str) -> None:
    """The last days by date partition. Dates written again replace their own partitions only."""
    rows = df.filter((F.col(time) >= ago(as_of, days=days)) & (F.col(time) < at(as_of))).withColumn("archive_date", F.to_date(time))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("archive_date").parquet(path)


def compact(spark: SparkSession, path: str, target: str, target_bytes: int = 128 << 20) -> int:
    """Rewrites a data set in files of about target_bytes; gives their number. The rows stay the same.

    The size comes from the file system's listing through Spark's own reader, not from a local one.
    """
    size = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).agg(F.sum("length")).first()[0] or 0
    n = max(1, -(-size // target_bytes))
    spark.read.parquet(path).repartition(n).write.mode("overwrite").parquet(target)
    return n


def read_where(spark: SparkSession, path: str, condition: str) -> DataFrame:
    """Rows of a data set; the condition reaches the scan."""
    return spark.read.parquet(path).filter(condition)


def missing_batches(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of batches that a table doesn't hold yet, by _batch_id: loading twice is loading once."""
    return batch.join(existing.select("_batch_id").distinct(), "_batch_id", "left_anti")


def append_once(spark: SparkSession, batch: DataFrame, path: str) -> int:
    """Loads the batches that aren't loaded yet, each as its own partition; gives the number of their rows.

    A batch is loaded once its id stands in the table ``path + ".loaded"``, which is written last: what a failed run left of
    a batch is replaced as a whole by the next. Rows without a batch id share a partition, which every run replaces.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.loaded")
    known = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    new = missing_batches(batch, spark.read.parquet(f"{path}.loaded")) if known else batch
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch_id").parquet(path)
    counts = new.groupBy("_batch_id").agg(F.count("*").alias("rows")).persist()
    n = counts.agg(F.sum("rows")).first()[0] or 0
    if n:
        counts.write.mode("append").parquet(f"{path}.loaded")
    counts.unpersist()
    return n


#: The order categories of generated rows.
CATEGORIES = "electronics fashion home beauty sports toys books garden".split()


def drawn(key: str, seed: int, salt: str, field: int, n: int) -> Column:
    """A number under n for each key: the field-th 32 bits (from 0 to 3) of a digest of key, seed and salt, modulo n."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), F.lit(salt)).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1 + 8 * field, 8), 16, 10).cast("long"), F.lit(n))


def drawn_sql(key: str, seed: int, salt: str, field: int, n: int) -> str:
    return f"(CAST('0x' || substr(md5({key} || ':{seed}:{salt}'), {1 + 8 * field}, 8) AS BIGINT) % {n})"


#: How payments are made.
PAYMENT_TYPES = "credit_card boleto voucher debit_card".split()


def generated_orders(ids: DataFrame, seed: int, start: dt.datetime, days: int = 730, per_batch: int = 50_000_000) -> DataFrame:
    """Synthetic orders of a column ``id``: every field is drawn from a digest of (id, seed), so reruns agree, in any
    engine that has MD5, and parts can be made anywhere."""
    who, sale = (lambda field, n, salt=salt: drawn("id", seed, salt, field, n) for salt in ("who", "sale"))
    pick = lambda values, at_: F.element_at(F.array(*map(F.lit, values)), (at_ + 1).cast("int"))
    price, status = (sale(0, 100_000) + 100) / 100, sale(1, 100)
    return ids.select(
        F.concat(F.lit("O"), F.lpad(F.hex("id"), 12, "0")).alias("order_id"), F.concat(F.lit("C"), F.lpad(who(0, 100_000).cast("string"), 5, "0")).alias("customer_id"),
        F.concat(F.lit("P"), F.lpad(who(1, 1_000_000).cast("string"), 6, "0")).alias("product_id"), pick(CATEGORIES, who(2, len(CATEGORIES))).alias("product_category"),
        F.concat(F.lit("S"), F.lpad(who(3, 10_000).cast("string"), 4, "0")).alias("seller_id"), price.alias("price"), rounded(price * 0.1, 2).alias("freight_value"),
        F.when(status < 8, "canceled").when(status < 80, "delivered").otherwise("shipped").alias("order_status"), sale(2, 27).cast("string").alias("state"),
        F.timestamp_add("SECOND", sale(3, days * 86_400).cast("int"), at(start)).alias("event_time"), F.floor(F.col("id") / per_batch).alias("_batch_id"),
    )


def generated_payments(ids: DataFrame, seed: int, start: dt.datetime, days: int = 730) -> DataFrame:
    """One payment for each generated order, from the same ids, so that the two join."""
    o = generated_orders(ids.select("id"), seed, start, days)
    paid = lambda field, n: drawn("order_id", seed, "paid", field, n)
    return o.select(
        F.concat(F.lit("PAY"), F.substring("order_id", 2, 12)).alias("payment_id"), "order_id", F.element_at(F.array(*map(F.lit, PAYMENT_TYPES)), (paid(0, len(PAYMENT_TYPES)) + 1).cast("int")).alias("payment_type"),
        (F.col("price") + F.col("freight_value")).alias("payment_value"), (paid(1, 12) + 1).cast("int").alias("installments"), F.timestamp_add("SECOND", paid(2, 300).cast("int"), F.col("event_time")).alias("event_time"),
    )
