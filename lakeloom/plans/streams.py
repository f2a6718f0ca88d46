"""Queries of streams, storage and text.

Streams run over the given events as files, to their end; a row far in the future closes the last window. A row without a
time belongs to no window, hour or day, in batch and stream alike.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import AS_OF, STATES, ago, at, device_class, ip_state, rounded, time_decay
from ..operators import layers as L
from ..operators import text as T
from ..sources import adapters as A
from ..sources import landing, storage, topic
from ..sources.adapters import money_sql, rounded_sql, sql
from ..streaming import jobs as J
from ..streaming import progress, state
from .layers import GMV, NOW, raw_orders, raw_payments
from .registry import query


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under the checkpoint folder if one is set, else the warehouse."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/lakeloom-{uuid.uuid4().hex}"


#: The events come in slices of the order of time, each of files in any order; between slices no row is later than
#: the delay, so that the streams run under the few seconds that they are about.
SLICES, DELAY = 6, "5 seconds"
SLICE_FILE_ROWS = 100_000
#: Rows are dealt to a slice's files by hash, so that no file of so many rows on average stays empty.
FILE_LEAST = 64


def time_slices(rows: DataFrame, late: Column) -> tuple[Column, list[int], int]:
    """The number of each row's slice, all such numbers in order, and how many files make a slice. Late rows' number is -1.

    Every slice has to fill all its files, as a batch is so many files: where many rows share a time, small slices go with their neighbours.
    """
    us = F.unix_micros("event_time")
    found = rows.agg(F.percentile_approx(us, [k / SLICES for k in range(1, SLICES)], 10_000).alias("cuts"), F.count("*").alias("n")).first()
    cuts = sorted(set(found.cuts or []))
    files = max(1, found.n // SLICES // SLICE_FILE_ROWS)
    numbered = lambda cuts: F.when(late, -1).otherwise(sum((F.coalesce((us >= c).cast("int"), F.lit(0)) for c in cuts), F.lit(0)))
    if files > 1:
        sizes = dict(rows.groupBy(numbered(cuts)).count().collect())  # a row a slice
        files = max(1, min(files, sizes.get(-1, found.n) // FILE_LEAST))
        kept, held = [], 0
        for k, c in enumerate(cuts):
            held += sizes.get(k, 0)
            if held >= files * FILE_LEAST:
                kept, held = [*kept, c], 0
        cuts = kept[:-1] if held + sizes.get(len(cuts), 0) < files * FILE_LEAST else kept
    return numbered(cuts), list(range(len(cuts) + 1)), files


def event_files(spark: SparkSession, sf: str, adapter=A.order_stream, closed: bool = False, delayed: Column | None = None) -> tuple[str, int]:
    """A folder with the adapter's rows as files, slice after slice, and how many files make a slice.

    Slices are cut at quantiles of the times that there are; rows without a time come in the first. closed: a row of
    the year 2100 comes behind them, which ends all windows before. delayed: which rows come after all others. The table is read and
    dealt to slices and files once, so that slices are written by many tasks even if the table is in order of time.
    """
    folder, rows = scratch(spark), adapter(spark, sf)
    number, slices, files = time_slices(rows, F.coalesce(delayed, F.lit(False)) if delayed is not None else F.lit(False))
    file = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files)).cast("int")
    dealt = rows.withColumns({"_slice": number, "_file": file})
    dealt = dealt.repartitionById((len(slices) + 1) * files, (F.col("_slice") + 1) * files + F.col("_file")).persist()
    one = lambda k: dealt.filter(F.col("_slice") == k).repartitionById(files, F.col("_file")).drop("_slice", "_file")
    for k in slices:
        one(k).write.mode("append").parquet(folder)
    ends = ["2100-01-01 00:00:00"] * closed + ["2101-01-01 00:00:00"] * (delayed is not None)
    for end in ends:
        last = rows.limit(1).withColumn("event_time", F.to_timestamp(F.lit(end))).withColumn("order_id", F.lit("end"))
        spark.range(0, files, 1, files).crossJoin(F.broadcast(last)).drop("id").write.mode("append").parquet(folder)
    if delayed is not None:
        one(-1).write.mode("append").parquet(folder)
    dealt.unpersist()
    return folder, files


def read_files(spark: SparkSession, folder: str, files: int) -> DataFrame:
    """The files of a folder as a stream, in the order of writing, so many at a time."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files).parquet(folder)


def event_stream(spark: SparkSession, sf: str, adapter=A.order_stream, closed: bool = False, delayed: Column | None = None) -> DataFrame:
    """The adapter's rows as a stream, a slice at a time."""
    return read_files(spark, *event_files(spark, sf, adapter, closed, delayed))


def finished(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives in all, read from its table."""
    folder = scratch(spark)
    J.run_available(stream, J.table_sink(f"{folder}/out"), f"{folder}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/*")


BUCKET = "time_bucket(INTERVAL {0}, event_time) AS window_start, time_bucket(INTERVAL {0}, event_time) + INTERVAL {0} AS window_end"
MEASURES = f"count(*) AS order_cnt, {GMV} AS total_gmv, {GMV} / count(*) AS avg_price, count(*) FILTER (order_status = 'canceled') AS cancel_cnt"
T1 = f"SELECT {BUCKET.format('1 MINUTE')}, {MEASURES}, count(DISTINCT customer_id) AS unique_customers, arg_min(product_category, (-n, product_category)) AS top_category FROM (SELECT *, count(*) OVER (PARTITION BY time_bucket(INTERVAL 1 MINUTE, event_time), product_category) AS n FROM order_stream WHERE price >= 0 AND event_time IS NOT NULL) GROUP BY 1"


@query("T1_minute_stats", sql("order_stream", T1))
def t1(spark, sf):
    return J.minute_statistics(A.order_stream(spark, sf))


@query("T1_minute_stats_stream", sql("order_stream", T1))
def t1s(spark, sf):
    return finished(spark, J.minute_statistics(event_stream(spark, sf, closed=True), DELAY, exact=True))


T2 = f"SELECT {BUCKET.format('1 MINUTE')}, product_category, {MEASURES} FROM order_stream WHERE event_time IS NOT NULL GROUP BY 1, 3"


@query("T2_category_minutes", sql("order_stream", T2))
def t2(spark, sf):
    return J.category_statistics(A.order_stream(spark, sf))


@query("T2_category_minutes_stream", sql("order_stream", T2))
def t2s(spark, sf):
    return finished(spark, J.category_statistics(event_stream(spark, sf, closed=True), DELAY))


T3 = "SELECT * FROM (SELECT time_bucket(INTERVAL 5 MINUTE, event_time) AS window_start, product_category, count(*) FILTER (order_status = 'canceled')::DOUBLE / count(*) * 100.0 AS cancel_rate, count(*) AS total_orders FROM order_stream WHERE event_time IS NOT NULL GROUP BY 1, 2) WHERE cancel_rate > 15"


@query("T3_cancel_alerts", sql("order_stream", T3))
def t3(spark, sf):
    return J.cancel_alerts(A.order_stream(spark, sf))


@query("T3_cancel_alerts_stream", sql("order_stream", T3))
def t3s(spark, sf):
    return finished(spark, J.cancel_alerts(event_stream(spark, sf, closed=True), DELAY))


T4 = f"SELECT customer_id, date_trunc('hour', event_time) AS window_start, count(*) AS order_count, {GMV} AS gmv, {GMV} / count(price) AS avg_price, count(DISTINCT product_category) AS category_cnt, date_trunc('hour', event_time) + INTERVAL 1 HOUR AS feature_time FROM order_stream WHERE event_time IS NOT NULL GROUP BY 1, 2"


@query("T4_customer_features", sql("order_stream", T4))
def t4(spark, sf):
    return J.customer_features(A.order_stream(spark, sf))


@query("T4_customer_features_stream", sql("order_stream", T4))
def t4s(spark, sf):
    """Categories of a customer's hour are few, so their estimate is exact here."""
    return finished(spark, J.customer_features(event_stream(spark, sf, closed=True), DELAY))


@query("T5_running_user_features", sql("order_stream", f"SELECT customer_id, count(*) AS order_count, {money_sql('price')} AS gmv, max(event_time) AS last_time FROM order_stream GROUP BY 1"))
def t5(spark, sf):
    """The last row of each customer that the stateful stream gives."""
    rows = finished(spark, J.running_user_features(event_stream(spark, sf), DELAY, ttl_ms=365 * 86_400_000), "update")
    return rows.groupBy("customer_id").agg(F.max_by(F.struct("order_count", "gmv", "last_time"), "order_count").alias("r")).select("customer_id", "r.*")


@query("T6_orders_with_payments", sql("order_stream payments", "SELECT o.order_id, coalesce(p.payment_type, '') AS payment_type, coalesce(p.payment_value, 0.0::DOUBLE) AS payment_value FROM order_stream o LEFT JOIN payments p ON o.order_id = p.order_id AND p.event_time >= o.event_time AND p.event_time <= o.event_time + INTERVAL 1 HOUR"))
def t6(spark, sf):
    pay = event_stream(spark, sf, A.payments, closed=True)
    both = J.orders_with_payments(event_stream(spark, sf, closed=True), pay, DELAY)
    return finished(spark, both).filter("order_id <> 'end'").select("order_id", "payment_type", "payment_value")


@query("T7_replay", sql("order_stream", f"SELECT date_trunc('hour', event_time) AS hour_start, product_category, state, count(DISTINCT order_id) AS order_cnt, {GMV} AS total_gmv, count(*) FILTER (order_status = 'canceled') AS cancel_cnt FROM order_stream WHERE event_time IS NOT NULL GROUP BY 1, 2, 3"))
def t7(spark, sf):
    """Four replays into one table, the last two by one job, their batches cut in four ways: the hours are those of one."""
    out, (folder, files) = scratch(spark), event_files(spark, sf)
    for n, (job, at_once) in enumerate((("job-9", files), ("job-10", 2 * files), ("job-11", files), ("job-11", 100 * files))):
        J.replay(read_files(spark, folder, at_once), job, f"{out}/hours", f"{out}/checkpoint-{n}", version=n)
    return J.replayed_hours(spark, f"{out}/hours")


@query("T8_late_rows", sql("order_stream", "SELECT CAST(event_time AS DATE) AS day, count(*) AS order_cnt FROM order_stream WHERE _kafka_offset % 10 <> 3 AND event_time IS NOT NULL GROUP BY 1"))
def t8(spark, sf):
    """Days of a stream of which every tenth row comes after the watermark has passed all days: those rows are dropped."""
    stream = event_stream(spark, sf, closed=True, delayed=F.col("_kafka_offset") % 10 == 3)
    g = J.late(stream, DELAY).groupBy(F.window("event_time", "1 day").alias("w")).agg(F.count("*").alias("order_cnt"))
    return finished(spark, g.select(F.to_date("w.start").alias("day"), "order_cnt")).filter("day < DATE '2100-01-01'")


@query("T9_stream_dedup", sql("order_stream", "SELECT order_id, price FROM order_stream"))
def t9(spark, sf):
    twice = lambda s, d: A.order_stream(s, d).unionByName(A.order_stream(s, d))
    return finished(spark, J.deduplicated(event_stream(spark, sf, twice), ["order_id"], DELAY).select("order_id", "price"))


@query("T10_restart", sql("order_stream", "SELECT count(*) AS rows, count(DISTINCT order_id) AS orders FROM order_stream"))
def t10(spark, sf):
    """The same query started twice on one checkpoint: the second run finds nothing new."""
    folder, stream = scratch(spark), event_stream(spark, sf)
    for _ in range(2):
        J.run_available(stream, J.table_sink(f"{folder}/out"), f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out/*").agg(F.count("*").alias("rows"), F.count_distinct("order_id").alias("orders"))


@query("T11_replay_job", sql("order_stream", "SELECT 'job-1' AS job_id, 'done' AS status, count(*) AS processed FROM order_stream"))
def t11(spark, sf):
    folder = scratch(spark)
    q = J.replay(event_stream(spark, sf), "job-1", f"{folder}/hours", f"{folder}/checkpoint", version=1)
    return J.replay_job_row(spark, q, "job-1").select("job_id", "status", "processed")


@query("L12_lag_snapshot", sql("consumer_lag", "SELECT consumer_group, topic, partition_id, lag FROM consumer_lag"))
def l12(spark, sf):
    return J.lag_snapshot(A.consumer_lag(spark, sf).drop("lag")).select("consumer_group", "topic", "partition_id", "lag")


def json_files(spark, raw: DataFrame) -> str:
    folder = scratch(spark)
    raw.repartition(4).write.text(folder)
    return folder


@query("S1_order_stream_source", sql("order_stream", "SELECT order_id, product_category FROM order_stream WHERE _kafka_offset % 97 <> 0"))
def s1(spark, sf):
    stream = landing.json_stream(spark, json_files(spark, raw_orders(spark, sf)), landing.ORDER_JSON, "order_id", max_files=2)
    return finished(spark, stream.select("order_id", "product_category"))


@query("S2_payment_stream_source", sql("payments", "SELECT payment_id, payment_type FROM payments WHERE CAST(payment_id AS BIGINT) % 97 <> 0"))
def s2(spark, sf):
    stream = landing.json_stream(spark, json_files(spark, raw_payments(spark, sf)), landing.PAYMENT_JSON, "payment_id", max_files=2)
    return finished(spark, stream.select("payment_id", "payment_type"))


TEXT_TIME = "yyyy-MM-dd HH:mm:ss"


#: A topic of the given orders: partition by id, two appends, cut at a time.
PARTITIONS, CUT = 3, "2024-01-20 00:00:00"
PART = f"_kafka_offset % {PARTITIONS}"


def order_topic(spark: SparkSession, sf: str) -> tuple[str, list]:
    """An empty topic, and two functions that append the orders before the cut and those from it on."""
    path, rows = f"{scratch(spark)}/orders", A.order_stream(spark, sf)
    topic.create(path, PARTITIONS, batch_rows=5_000)
    json = rows.select(F.col("event_time").alias("timestamp"), F.to_json(F.struct(*[c for c in rows.columns])).alias("value"), "_kafka_offset", "event_time")
    before = F.col("event_time") < F.lit(CUT).cast("timestamp")
    return path, [lambda p=p: topic.publish(json.filter(p), path, PART, ["_kafka_offset"]) for p in (before, ~before)]


def decoded(stream: DataFrame) -> DataFrame:
    orders = landing.parsed(stream, landing.ORDER_JSON, "order_id")
    return orders.select("order_id", "product_category", "price")


@query("S1_topic_earliest", sql("order_stream", "SELECT order_id, product_category, price FROM order_stream"))
def s1_earliest(spark, sf):
    """A topic from its start, stopped in the middle and started again: every order once."""
    path, (first, second) = order_topic(spark, sf)
    out = scratch(spark)
    sink = J.table_sink(f"{out}/rows")
    first()
    run = lambda: J.until_head(decoded(topic.read_topic(spark, path, group="all", maxOffsetsPerTrigger=50_000)), f"{out}/checkpoint", sink)
    run()
    second()
    run()
    return spark.read.parquet(f"{out}/rows/*")


@query("S1_topic_latest", sql("order_stream", f"SELECT order_id, product_category, price FROM order_stream WHERE event_time >= TIMESTAMP '{CUT}'"))
def s1_latest(spark, sf):
    """A stream that starts at the end of a topic: only what comes later."""
    path, (first, second) = order_topic(spark, sf)
    out = scratch(spark)
    first()
    J.until_head(decoded(topic.read_topic(spark, path, startingOffsets="latest")), f"{out}/checkpoint", J.table_sink(f"{out}/rows"), meanwhile=second)
    return spark.read.parquet(f"{out}/rows/*")


@query("S1_topic_offsets", sql("order_stream", f"SELECT order_id, part AS partition, nr AS \"offset\" FROM (SELECT order_id, CAST(_kafka_offset % {PARTITIONS} AS INT) AS part, row_number() OVER (PARTITION BY _kafka_offset % {PARTITIONS} ORDER BY event_time >= TIMESTAMP '{CUT}', _kafka_offset) - 1 AS nr FROM order_stream) WHERE nr >= 100 * part"))
def s1_offsets(spark, sf):
    """A topic as a table, from an offset of its own in each partition."""
    path, appends = order_topic(spark, sf)
    for append in appends:
        append()
    topic.register(spark)
    rows = spark.read.format("lakeloom_topic").options(path=path, startingOffsets='{"0": 0, "1": 100, "2": 200}').load()
    return rows.select(F.from_json("value", landing.ORDER_JSON)["order_id"].alias("order_id"), "partition", "offset")


@query("S2_payment_topic", sql("payments", "SELECT payment_id, payment_type, payment_value FROM payments"))
def s2_topic(spark, sf):
    """Payments through a topic, in batches of bounded size."""
    path, rows, out = f"{scratch(spark)}/payments", A.payments(spark, sf), scratch(spark)
    topic.create(path, PARTITIONS)
    number = F.col("payment_id").cast("long")
    topic.publish(rows.select(F.col("event_time").alias("timestamp"), F.to_json(F.struct(*rows.columns)).alias("value"), number.alias("nr")), path, f"nr % {PARTITIONS}", ["nr"])
    most = max(1, sum(topic.head(path).values()) // 3)
    paid = landing.parsed(topic.read_topic(spark, path, group="payments", maxOffsetsPerTrigger=most), landing.PAYMENT_JSON, "payment_id").select("payment_id", "payment_type", "payment_value")
    J.until_head(paid, f"{out}/checkpoint", J.table_sink(f"{out}/rows"))
    return spark.read.parquet(f"{out}/rows/*")


@query("L12_stream_lag", sql("order_stream", f"SELECT 'orders-landing' AS consumer_group, CAST(_kafka_offset % {PARTITIONS} AS INT) AS partition_id, count(*) FILTER (event_time < TIMESTAMP '{CUT}') AS current_offset, count(*) AS log_end_offset, count(*) FILTER (event_time >= TIMESTAMP '{CUT}') AS lag FROM order_stream GROUP BY 2"))
def l12_stream(spark, sf):
    """The lag of a running query by partition, from what it reports: it stands at the first append's end when the second one comes."""
    path, (first, second) = order_topic(spark, sf)
    out, log = scratch(spark), progress.ProgressLog(f"{scratch(spark)}/progress")
    first()
    spark.streams.addListener(log)
    try:
        J.until_head(decoded(topic.read_topic(spark, path)), f"{out}/checkpoint", J.table_sink(f"{out}/rows"), name="orders-landing")
        progress.settled(spark)
    finally:
        spark.streams.removeListener(log)
    second()
    return progress.lag(spark, log.folder, path).drop("query_id")


#: Customers' orders, each with the number of absences of over a day before it.
ABSENCES = """SELECT *, sum(CASE WHEN event_time - before > INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY customer_id ORDER BY event_time, order_id) AS absences FROM (
    SELECT *, lag(event_time) OVER (PARTITION BY customer_id ORDER BY event_time, order_id) AS before FROM order_stream WHERE event_time IS NOT NULL)"""


@query("T5_totals_since_absence", sql("order_stream", f"""SELECT order_id, customer_id, count(*) OVER w AS order_count, CAST(sum(CAST(price AS DECIMAL(18,2))) OVER w AS DOUBLE) AS gmv,
    count(*) OVER (PARTITION BY customer_id ORDER BY event_time RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS hour_count
    FROM ({ABSENCES}) WINDOW w AS (PARTITION BY customer_id, absences ORDER BY event_time, order_id ROWS UNBOUNDED PRECEDING)"""))
def t5_absence(spark, sf):
    """Running totals that end with a day's absence, from a stream in slices of time."""
    with state.rocksdb(spark):
        return finished(spark, state.running_totals(event_stream(spark, sf, closed=True), DELAY)).filter("order_id <> 'end'")


@query("T5_state_left", sql("order_stream", f"""SELECT customer_id, n AS order_count, last_time FROM (
    SELECT customer_id, count(*) AS n, max(event_time) AS last_time, row_number() OVER (PARTITION BY customer_id ORDER BY absences DESC) AS nr FROM ({ABSENCES}) GROUP BY customer_id, absences)
    WHERE nr = 1 AND date_trunc('milliseconds', last_time) + INTERVAL 1 DAY > date_trunc('milliseconds', (SELECT max(event_time) FROM order_stream)) - INTERVAL 5 SECOND"""))
def t5_state(spark, sf):
    """What the store holds when the stream has ended: customers who were away for a day have no state left."""
    out = scratch(spark)
    with state.rocksdb(spark):
        J.run_available(state.running_totals(event_stream(spark, sf), DELAY), J.table_sink(f"{out}/rows"), f"{out}/checkpoint")
    left = state.state_left(spark, f"{out}/checkpoint")
    return left.select("key.customer_id", "value.order_count", F.timestamp_micros("value.last_micros").alias("last_time"))


def failing(spark: SparkSession, *points: str) -> str:
    """A folder that asks a sink to fail once at each of the points, such as before-1."""
    folder = f"{scratch(spark)}/faults"
    for p in points:
        topic.write_json(f"{folder}/{p}.json", {})
    return folder


@query("T10_commit", sql("order_stream", "SELECT count(*) AS rows, count(DISTINCT order_id) AS orders, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS gmv, 4 AS failures FROM order_stream"))
def t10_commit(spark, sf):
    """A stream that fails twice between write and commit, and twice behind its commit, and is started anew each time: every order once."""
    out, faults = scratch(spark), failing(spark, "before-0", "before-2", "after-1", "after-3")
    topic.register(spark)
    files = event_files(spark, sf)
    run = lambda: J.until_head(read_files(spark, *files).select("order_id", "price"), f"{out}/checkpoint", path=f"{out}/orders", faults=faults)
    _, failures = J.recovering(run)
    rows = topic.committed(spark, f"{out}/orders", "order_id string, price double")
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("order_id").alias("orders"), F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("gmv")).withColumn("failures", F.lit(failures))


@query("S7_topic_sink", sql("order_stream", "SELECT order_id, product_category, price FROM order_stream"))
def s7_topic(spark, sf):
    """Orders of a stream appended to a topic, with failures before and behind the append: every order once, offsets without gaps."""
    path, out, faults = f"{scratch(spark)}/orders", scratch(spark), failing(spark, "before-1", "after-2")
    topic.create(path, PARTITIONS)
    files = event_files(spark, sf)
    stream = read_files(spark, *files)
    rows = stream.select(F.col("event_time").alias("timestamp"), F.to_json(F.struct(*stream.columns)).alias("value"), "_kafka_offset")
    J.recovering(lambda: J.until_head(rows, f"{out}/checkpoint", J.topic_sink(path, PART, ["_kafka_offset"], "orders", faults)))
    topic.register(spark)
    return decoded(spark.read.format("lakeloom_topic").options(path=path).load())


#: The database of S7_jdbc_sink: on a cluster ``lakeloom.jdbc.url`` has to name one that all executors reach.
LOCAL_DATABASE = "jdbc:derby:memory:lakeloom{};create=true"


@query("S7_jdbc_sink", sql("order_stream", f"SELECT {BUCKET.format('1 HOUR')}, {MEASURES} FROM order_stream WHERE price >= 0 AND event_time IS NOT NULL GROUP BY 1"))
def s7_jdbc(spark, sf):
    """Hours of a stream in update mode, merged into a database's table by window; one batch fails before and one behind its transaction."""
    url = spark.conf.get("lakeloom.jdbc.url", None) or LOCAL_DATABASE.format(uuid.uuid4().hex)
    out, faults = scratch(spark), failing(spark, "before-1", "after-2")
    files = event_files(spark, sf)
    stats = J.minute_statistics(read_files(spark, *files), DELAY, "1 hour").drop("unique_customers", "top_category")
    sink = J.jdbc_sink(url, "hours", ["window_start"], "hours", faults)
    J.recovering(lambda: J.until_head(stats, f"{out}/checkpoint", sink, mode="update"))
    return spark.read.jdbc(url, "hours")


@query("S5_land_minute_stats", sql("order_stream", "SELECT time_bucket(INTERVAL 1 HOUR, event_time) AS window_start, count(*) AS order_cnt FROM order_stream GROUP BY 1 HAVING count(*) % 5 <> 0"))
def s5(spark, sf):
    """Statistics with times as texts, of which every fifth count has a broken one."""
    stats = L.minute_stats(A.order_stream(spark, sf), "1 hour")
    raw = stats.withColumns({"window_start": F.when(F.col("order_cnt") % 5 == 0, "?").otherwise(F.date_format("window_start", TEXT_TIME)), "window_end": F.date_format("window_end", TEXT_TIME)})
    return landing.land_minute_stats(raw).select("window_start", "order_cnt")


@query("S6_land_wide", sql("order_stream payments", "SELECT o.order_id, date_trunc('second', o.event_time) AS event_time, CAST(o.event_time AS DATE) AS event_date, coalesce(p.payment_type, '') AS payment_type FROM order_stream o LEFT JOIN payments p USING (order_id)"))
def s6(spark, sf):
    wide = L.with_payment(A.order_stream(spark, sf), A.payments(spark, sf)).withColumn("event_time", F.date_format("event_time", TEXT_TIME))
    return landing.land_wide(wide).select("order_id", "event_time", "event_date", "payment_type")


@query("S7_aggregate_sink", sql("order_stream", f"SELECT {BUCKET.format('1 HOUR')}, {MEASURES} FROM order_stream WHERE price >= 0 AND event_time IS NOT NULL GROUP BY 1"))
def s7(spark, sf):
    """Hours of a stream in update mode, merged by window: later states of a window replace earlier ones."""
    folder = scratch(spark)
    stats = J.minute_statistics(event_stream(spark, sf), DELAY, "1 hour").drop("unique_customers", "top_category").withColumn("day", F.to_date("window_start"))
    J.run_available(stats, J.upsert_sink(f"{folder}/hours", ["window_start", "day"], ["order_cnt"], "day"), f"{folder}/checkpoint", "update")
    return spark.read.parquet(f"{folder}/hours").drop("day")


@query("S8_training_export", sql("feature_labels", "SELECT label_id, label FROM feature_labels"))
def s8(spark, sf):
    path = scratch(spark)
    storage.write_training_set(A.feature_labels(spark, sf).select("label_id", "label"), path)
    return spark.read.parquet(path)


@query("S9_feature_export", sql("order_stream payments", f"SELECT 'orders' AS view, count(*) AS rows FROM order_stream WHERE event_time BETWEEN {NOW} - INTERVAL 7 DAY AND {NOW} UNION ALL SELECT 'payments', count(*) FROM payments WHERE event_time BETWEEN {NOW} - INTERVAL 7 DAY AND {NOW}"))
def s9(spark, sf):
    views = {"orders": A.order_stream(spark, sf), "payments": A.payments(spark, sf)}
    paths = storage.export_views(views, "event_time", ago(AS_OF, days=7), at(AS_OF), scratch(spark))
    one = lambda n: spark.read.parquet(paths[n]).agg(F.count("*").alias("rows")).select(F.lit(n).alias("view"), "rows")
    return one("orders").union(one("payments"))


@query("S10_archive", sql("order_stream", f"SELECT CAST(event_time AS DATE) AS archive_date, count(*) AS rows FROM order_stream WHERE event_time >= {NOW} - INTERVAL 7 DAY AND event_time < {NOW} GROUP BY 1"))
def s10(spark, sf):
    path = scratch(spark)
    for _ in range(2):  # again: the same partitions
        storage.archive(A.order_stream(spark, sf), "event_time", AS_OF, 7, path)
    return spark.read.parquet(path).groupBy("archive_date").agg(F.count("*").alias("rows"))


@query("S11_compaction", sql("order_stream", "SELECT order_id, price FROM order_stream"))
def s11(spark, sf):
    path = scratch(spark)
    A.order_stream(spark, sf).select("order_id", "price").repartition(16).write.parquet(path)
    storage.compact(spark, path, f"{path}-compact")
    return spark.read.parquet(f"{path}-compact")


@query("S12_filtered_read", "SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity > 40")
def s12(spark, sf):
    return storage.read_where(spark, f"{sf}/lineitem.parquet", "l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity > 40")


def generated_sql() -> str:
    who, sale = (lambda field, n, salt=salt: storage.drawn_sql("event_id", 7, salt, field, n) for salt in ("who", "sale"))
    paid = lambda field, n: storage.drawn_sql("order_id", 7, "paid", field, n)
    return f"""SELECT *, {storage.PAYMENT_TYPES}[{paid(0, len(storage.PAYMENT_TYPES))} + 1] AS payment_type, price + freight_value AS payment_value, CAST({paid(1, 12)} + 1 AS INT) AS installments, event_time + to_seconds({paid(2, 300)}) AS paid_time FROM (
        SELECT *, {rounded_sql("price * 0.1::DOUBLE", 2)} AS freight_value FROM (
        SELECT 'O' || format('{{:012X}}', event_id) AS order_id, 'PAY' || format('{{:012X}}', event_id) AS payment_id, 'C' || format('{{:05}}', {who(0, 100_000)}) AS customer_id, 'P' || format('{{:06}}', {who(1, 1_000_000)}) AS product_id,
            {storage.CATEGORIES}[{who(2, len(storage.CATEGORIES))} + 1] AS product_category, 'S' || format('{{:04}}', {who(3, 10_000)}) AS seller_id, ({sale(0, 100_000)} + 100)::DOUBLE / 100 AS price,
            CASE WHEN {sale(1, 100)} < 8 THEN 'canceled' WHEN {sale(1, 100)} < 80 THEN 'delivered' ELSE 'shipped' END AS order_status, CAST({sale(2, 27)} AS VARCHAR) AS state,
            TIMESTAMP '2023-01-01' + to_seconds({sale(3, 730 * 86_400)}) AS event_time, event_id // 50000000 AS _batch_id FROM events))"""


@query("S13_generated_orders", generated_sql())
def s13(spark, sf):
    """Synthetic orders with their payments, one for each given event."""
    ids = A.table(spark, sf, "events").select(F.col("event_id").alias("id"))
    o, p = storage.generated_orders(ids, 7, dt.datetime(2023, 1, 1)), storage.generated_payments(ids, 7, dt.datetime(2023, 1, 1))
    return o.join(p.withColumnRenamed("event_time", "paid_time"), "order_id")


@query("S14_missing_batches", sql("order_stream", "SELECT order_id, _kafka_offset // 1000 AS _batch_id FROM order_stream WHERE _kafka_offset // 1000 % 2 = 1"))
def s14(spark, sf):
    rows = A.order_stream(spark, sf).select("order_id", F.floor(F.col("_kafka_offset") / 1000).alias("_batch_id"))
    return storage.missing_batches(rows, rows.filter("_batch_id % 2 = 0"))


def chunks_sql(text: str) -> str:
    """Paragraphs folded from the left: what is held, and the chunks that are done."""
    blank, white = "chr(10) || chr(10)", "E' \\t\\n\\x0b\\f\\r'"
    some = lambda x: f"list_filter([{x}], lambda y: y <> '')"
    return f"""SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS chunk_no, unnest(parts) AS chunk FROM (SELECT doc_id, r.done || {some("r.held")} AS parts FROM (
        SELECT doc_id, list_reduce(list_transform(paragraphs, lambda x: {{'held': x, 'done': []::VARCHAR[]}}), lambda a, x: CASE
            WHEN length(a.held) + length(x.held) <= 400 THEN {{'held': CASE WHEN a.held = '' THEN x.held ELSE a.held || {blank} || x.held END, 'done': a.done}}
            WHEN length(x.held) > 400 THEN {{'held': '', 'done': a.done || {some("a.held")} || list_filter(list_transform(range(0, length(x.held), 320), lambda b: substr(x.held, b + 1, 400)), lambda y: trim(y, {white}) <> '')}}
            ELSE {{'held': trim("right"(a.held, 80) || {blank} || x.held, {white}), 'done': a.done || {some("a.held")}}} END, {{'held': '', 'done': []::VARCHAR[]}}) AS r
        FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({text}, '\\n\\s*\\n'), lambda x: trim(x, {white})), lambda x: x <> '') AS paragraphs FROM documents WHERE {text} IS NOT NULL)))"""


@query("K1_chunks", chunks_sql("text"))
def k1(spark, sf):
    return T.chunks(A.table(spark, sf, "documents"), "doc_id", "text")


@query("K1_packed_paragraphs", chunks_sql("regexp_replace(text, '([.!?]) ', '\\1' || chr(10) || chr(10), 'g')"))
def k1_packed(spark, sf):
    """Each sentence is a paragraph, so that chunks hold several and overlap."""
    docs = A.table(spark, sf, "documents").withColumn("text", F.regexp_replace("text", "([.!?]) ", "$1\n\n"))
    return T.chunks(docs, "doc_id", "text")


@query("K2_cosine_top_k", f"""SELECT query_id, CAST(rank AS INT) AS rank, vec_id, {rounded_sql('distance', 6)} AS distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, r.vec_id, 1.0 - list_cosine_similarity(r.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 3""")
def k2(spark, sf):
    e = A.table(spark, sf, "embeddings")
    return T.cosine_top_k(e, e.filter("vec_id % 20 = 0")).withColumn("distance", rounded(F.col("distance"), 6))


@query("A22_sessions", sql("chat_sessions", "SELECT session_id, arg_min(content, turn_index) FILTER (role = 'user') AS first_question, count(*) AS turns, count(*) FILTER (role = 'user') AS questions, min(turn_index) AS first_turn FROM chat_sessions GROUP BY 1"))
def a22(spark, sf):
    return T.sessions(A.chat_sessions(spark, sf))


AGENTS = ["Mozilla/5.0 (iPhone)", "Mozilla/5.0 (Linux; Android 14)", "Mozilla/5.0 (iPad)", "Mozilla/5.0 (Windows NT 10.0)"]


@query("V1_device_class", "SELECT event_id, CASE WHEN user_id % 9 = 0 THEN 'UNKNOWN' ELSE ['MOBILE', 'MOBILE', 'TABLET', 'DESKTOP'][event_id % 4 + 1] END AS device FROM events")
def v1(spark, sf):
    agent = F.when(F.col("user_id") % 9 != 0, A.pick(F.col("event_id"), AGENTS))
    return A.table(spark, sf, "events").select("event_id", device_class(agent).alias("device"))


@query("V2_ip_state", f"SELECT event_id, {STATES}[event_id % 256 % 27 + 1] AS state FROM events")
def v2(spark, sf):
    ip = F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"))
    return A.table(spark, sf, "events").select("event_id", ip_state(ip).alias("state"))


@query("V3_decayed_sum", f"SELECT user_id, {rounded_sql('CAST(sum(CAST(value * pow(0.5::DOUBLE, date_sub(' + chr(39) + 'second' + chr(39) + ', ts, ' + NOW + ') / 3600.0::DOUBLE / 168.0::DOUBLE) AS DECIMAL(24,10))) AS DOUBLE)', 4)} AS decayed FROM events GROUP BY 1")
def v3(spark, sf):
    """Amounts by user, each halved for every week of its age."""
    hours = F.floor((F.unix_micros(at(AS_OF)) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000) / 3600.0
    weighed = (F.col("value") * time_decay(hours, 168.0)).cast("decimal(24,10)")
    return A.table(spark, sf, "events").groupBy("user_id").agg(rounded(F.sum(weighed).cast("double"), 4).alias("decayed"))
