"""Offsets, progress, keyed state, commits and replays: restarts, failures and edge cases."""

from __future__ import annotations

import time
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakeloom import plans
from lakeloom.plans import streams
from lakeloom.sources import adapters as A
from lakeloom.sources import topic
from lakeloom.streaming import jobs as J
from lakeloom.streaming import progress, state

from .test_oracles import differences

PART = "nr % 2"


def log_of(spark, path, *parts, batch_rows=7):
    topic.create(path, 2, batch_rows)
    for start, end in parts:
        topic.publish(rows_of(spark, start, end), path, PART, ["nr"])


def rows_of(spark, start, end):
    return spark.range(start, end).select(F.timestamp_seconds("id").alias("timestamp"), F.concat(F.lit("v"), F.col("id")).alias("value"), F.col("id").alias("nr"))


def table_of(spark, path, **options):
    topic.register(spark)
    return spark.read.format("lakeloom_topic").options(path=path, **options).load()


def test_topic_numbers_rows(spark, tmp_path):
    path = f"{tmp_path}/t"
    log_of(spark, path, (0, 31), (31, 40), (40, 40))
    assert topic.head(path) == {"0": 20, "1": 20}
    rows = table_of(spark, path).collect()
    assert sorted((r.partition, r.offset, r.value) for r in rows) == [(p, k, f"v{2 * k + p}") for p in (0, 1) for k in range(20)]
    assert rows[0].timestamp.year == 1970
    some = table_of(spark, path, startingOffsets='{"0": 3}', endingOffsets='{"0": 15, "1": 8}', rowsPerTask=4)
    assert sorted((r.partition, r.offset) for r in some.collect()) == [(0, k) for k in range(3, 15)] + [(1, k) for k in range(8)]
    for bad in ('{"0": 21}', '{"7": 0}', '{"0": -1}'):
        with pytest.raises(PySparkException, match="doesn't have"):
            table_of(spark, path, startingOffsets=bad).collect()


def test_topic_misses_no_rows_silently(spark, tmp_path):
    path = f"{tmp_path}/t"
    log_of(spark, path, (0, 40))
    topic.remove(next(f for p, n, f in topic.files_of(path) if (p, n) == (1, 1)))
    with pytest.raises(PySparkException, match="of the 20 rows"):
        table_of(spark, path).collect()


def test_append_that_fails_is_replaced(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    log_of(spark, path, (0, 10))
    with monkeypatch.context() as m:
        m.setattr(topic, "advance", lambda *a: (_ for _ in ()).throw(OSError("no space")))
        with pytest.raises(OSError):
            topic.publish(rows_of(spark, 10, 30), path, PART, ["nr"])
    assert table_of(spark, path).count() == 10
    topic.publish(rows_of(spark, 100, 104), path, PART, ["nr"])
    assert sorted(r.value for r in table_of(spark, path).collect()) == sorted(f"v{k}" for k in [*range(10), *range(100, 104)])


def test_stream_restarts_where_it_was(spark, tmp_path):
    """Bounded batches, stopped and started: offsets go on without gaps, and the group's position follows."""
    path, log = f"{tmp_path}/t", progress.ProgressLog(f"{tmp_path}/log")
    log_of(spark, path, (0, 50))
    spark.streams.addListener(log)
    try:
        for upto in (50, 80):
            J.until_head(topic.read_topic(spark, path, group="g", maxOffsetsPerTrigger=12), f"{tmp_path}/c", J.table_sink(f"{tmp_path}/out"), name="g")
            progress.settled(spark)
            assert sorted(r.value for r in spark.read.parquet(f"{tmp_path}/out/*").collect()) == sorted(f"v{k}" for k in range(upto))
            assert {r.partition_id: (r.current_offset, r.lag) for r in progress.lag(spark, log.folder, path).collect()} == {p: (upto // 2, 0) for p in (0, 1)}
            if upto == 50:
                topic.publish(rows_of(spark, 50, 80), path, PART, ["nr"])
                assert [r.lag for r in progress.lag(spark, log.folder, path).collect()] == [15, 15]
    finally:
        spark.streams.removeListener(log)
    read = [r for r in progress.batches(spark, log.folder).collect() if r.input_rows]
    assert len(read) >= 7 and max(r.input_rows for r in read) <= 13 and sum(r.input_rows for r in read) == 80


def test_latest_sees_only_what_comes(spark, tmp_path):
    path = f"{tmp_path}/t"
    log_of(spark, path, (0, 20))
    add = lambda: topic.publish(rows_of(spark, 20, 25), path, PART, ["nr"])
    J.until_head(topic.read_topic(spark, path, startingOffsets="latest"), f"{tmp_path}/c", J.table_sink(f"{tmp_path}/out"), meanwhile=add)
    assert sorted(r.value for r in spark.read.parquet(f"{tmp_path}/out/*").collect()) == [f"v{k}" for k in range(20, 25)]


def faults(tmp_path, *points):
    for p in points:
        topic.write_json(f"{tmp_path}/faults/{p}.json", {})
    return f"{tmp_path}/faults"


def numbers_stream(spark, tmp_path):
    folder = f"{tmp_path}/in"
    for k in range(4):
        spark.range(k * 10, k * 10 + 10, 1, 2).selectExpr("id", "id * 0.5D AS x", "cast(null as timestamp) AS t", "if(id % 2 = 0, null, 'é') AS s").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("id long, x double, t timestamp, s string").option("maxFilesPerTrigger", 1).parquet(folder)


def test_staged_commits_once(spark, tmp_path):
    path, asked = f"{tmp_path}/out", faults(tmp_path, "before-0", "after-1", "before-3", "after-3")
    topic.register(spark)
    stream = numbers_stream(spark, tmp_path)
    _, failures = J.recovering(lambda: J.until_head(stream, f"{tmp_path}/c", path=path, faults=asked))
    schema = "id long, x double, t timestamp, s string"
    got = topic.committed(spark, path, schema)
    assert failures == 4 and sorted(r.id for r in got.collect()) == list(range(40))
    assert got.filter("s = 'é'").count() == 20 and got.filter("t IS NOT NULL").count() == 0
    assert topic.orphans(path) == []  # what failed was taken back
    topic.write_json(f"{path}/data/left.parquet", {})
    assert topic.vacuum(path) == 1 and topic.committed(spark, path, schema).count() == 40
    J.until_head(stream, f"{tmp_path}/c2", path=path, writer="second")  # another stream into the same table
    assert topic.committed(spark, path, schema).count() == 80
    assert topic.committed(spark, f"{tmp_path}/none", schema).count() == 0


@pytest.mark.parametrize("asked", [(), ("before-0", "after-0", "before-2", "after-3")])
def test_rows_in_a_database_once(spark, tmp_path, asked):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    stream = numbers_stream(spark, tmp_path).selectExpr("id % 15 AS k", "id", "x", "t")
    folder = faults(tmp_path, *asked)
    _, failures = J.recovering(lambda: J.until_head(stream, f"{tmp_path}/c", J.jdbc_sink(url, "t", ["k", "id"], "w", folder)))
    assert failures == len(asked)
    got = sorted(tuple(r) for r in spark.read.jdbc(url, "t").collect())
    assert got == sorted((k % 15, k, k * 0.5, None) for k in range(40))


def test_topic_sink_appends_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    topic.create(path, 2, 7)
    stream = numbers_stream(spark, tmp_path).selectExpr("timestamp_seconds(id) AS timestamp", "concat('v', id) AS value", "id AS nr")
    folder = faults(tmp_path, "before-1", "after-2")
    _, failures = J.recovering(lambda: J.until_head(stream, f"{tmp_path}/c", J.topic_sink(path, PART, ["nr"], "w", folder)))
    assert failures == 2 and sorted(r.value for r in table_of(spark, path).collect()) == sorted(f"v{k}" for k in range(40))


ORDER = "order_id string, customer_id string, product_category string, state string, order_status string, price double, event_time timestamp"


def order_files(spark, folder, *batches):
    for rows in batches:
        df = spark.createDataFrame([(f"o{i}", c, "a", "SP", "created", p, None) for i, c, p, _ in rows], ORDER)
        times = spark.createDataFrame([(f"o{i}", t) for i, _, _, t in rows], "order_id string, s long")
        df.drop("event_time").join(times, "order_id").select("*", F.timestamp_seconds("s").alias("event_time")).drop("s").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_totals_end_with_an_absence(spark, tmp_path):
    day = 86_400
    first = [(1, "c", 1.0, 10), (2, "c", 2.0, 20), (3, "d", 5.0, 30), (4, None, 1.0, 40), (5, "c", 1.0, None)]
    second = [(6, "c", 4.0, 20 + day), (7, "d", 1.0, 31 + day), (8, "c", 8.0, 21 + day)]
    stream = order_files(spark, f"{tmp_path}/in", first, second, [(9, "e", 1.0, 31 + 3 * day)])
    with state.rocksdb(spark):
        J.run_available(state.running_totals(stream), J.table_sink(f"{tmp_path}/out"), f"{tmp_path}/c")
    got = {r.order_id: (r.customer_id, r.order_count, r.gmv, r.hour_count) for r in spark.read.parquet(f"{tmp_path}/out/*").collect()}
    assert got == {"o1": ("c", 1, 1.0, 1), "o2": ("c", 2, 3.0, 2), "o3": ("d", 1, 5.0, 1), "o6": ("c", 3, 7.0, 1), "o8": ("c", 4, 15.0, 2), "o7": ("d", 1, 1.0, 1), "o9": ("e", 1, 1.0, 1)}
    assert [r.key.customer_id for r in state.state_left(spark, f"{tmp_path}/c").collect()] == ["e"]


def test_store_ends_idle_state(spark, tmp_path):
    """By the machine's clock: a customer idle for longer than the state lives starts anew."""
    folder, c = f"{tmp_path}/in", f"{tmp_path}/c"
    for k, wait in enumerate((0, 4)):
        time.sleep(wait)
        stream = order_files(spark, folder, [(k, "c", 1.0, 10 + k)])
        with state.rocksdb(spark):
            totals = state.running_totals(stream, ttl_ms=3_000, by_events=False)
            q = totals.writeStream.foreachBatch(J.table_sink(f"{tmp_path}/out")).option("checkpointLocation", c).trigger(once=True).start()
        assert q.awaitTermination(60) and q.exception() is None
        counts = {r.order_id: r.order_count for r in spark.read.parquet(f"{tmp_path}/out/*").collect()}
    assert counts == {"o0": 1, "o1": 1}


def test_replay_again_replaces_itself(spark, tmp_path):
    """The same job run again with a new checkpoint, another cut and other days: its own hours are those of the last run."""
    day, out = 86_400, f"{tmp_path}/hours"
    one = order_files(spark, f"{tmp_path}/a", [(1, "c", 1.0, 10), (2, "c", 2.0, 3700)], [(3, "c", 4.0, 20), (4, "c", 8.0, day), (5, "c", 16.0, None)])
    for k in range(2):
        J.replay(one, "job", out, f"{tmp_path}/c{k}", version=1)
        rows = {r.hour_start.timestamp(): r.total_gmv for r in J.replayed_hours(spark, out).collect()}
        assert rows == {0: 5.0, 3600: 2.0, day: 8.0}
    assert len(J.folders(spark, f"{out}_staged/job/rows")) == 1
    two = order_files(spark, f"{tmp_path}/b", [(1, "c", 1.0, 10), (9, "c", 3.0, 2 * day)])
    J.replay(two, "job", out, f"{tmp_path}/c3", version=1)
    assert {r.hour_start.timestamp(): r.total_gmv for r in J.replayed_hours(spark, out).collect()} == {0: 1.0, 2 * day: 3.0}


def test_rows_without_a_time(spark, tmp_path, sf):
    """Batch and stream alike leave them out of windows, hours and days."""
    given = A.order_stream(spark, sf)
    lost = given.withColumn("event_time", F.when(F.col("_kafka_offset") % 7 != 0, F.col("event_time")))
    lost.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(lost.schema).parquet(f"{tmp_path}/in")
    for k, f in enumerate((J.minute_statistics, J.category_statistics, J.customer_features, J.cancel_alerts)):
        want = f(lost).select("window_start").filter("window_start IS NULL").count()
        J.run_available(f(stream), J.table_sink(f"{tmp_path}/out{k}"), f"{tmp_path}/c{k}", "update")
        assert want == 0 == spark.read.parquet(f"{tmp_path}/out{k}/*").filter("window_start IS NULL").count()
    J.replay(stream, "j", f"{tmp_path}/hours", f"{tmp_path}/c", 1)
    assert J.replayed_hours(spark, f"{tmp_path}/hours").agg(F.sum("order_cnt")).first()[0] == lost.filter("event_time IS NOT NULL").count()


def test_customers_share_a_group(spark, tmp_path):
    """Many customers in one group: totals, ends and what is left are those of each customer, and so are the running features."""
    day, people = 86_400, [f"c{k}" for k in range(40)]
    first = [(k, c, 1.0 + k, 100 * k + 10) for k, c in enumerate(people)]
    second = [(100 + k, c, 2.0, 100 * k + (day + 20 if k % 2 else 4000)) for k, c in enumerate(people)]
    stream = order_files(spark, f"{tmp_path}/in", first, second, [(999, "z", 1.0, 4390 + day)])
    with state.rocksdb(spark):
        J.run_available(state.running_totals(stream, buckets=1), J.table_sink(f"{tmp_path}/out"), f"{tmp_path}/c")
    got = {r.order_id: (r.order_count, r.gmv, r.hour_count) for r in spark.read.parquet(f"{tmp_path}/out/*").collect()}
    want = {f"o{k}": (1, 1.0 + k, 1) for k in range(40)} | {f"o{100 + k}": (1, 2.0, 1) if k % 2 else (2, 3.0 + k, 1) for k in range(40)} | {"o999": (1, 1.0, 1)}
    assert got == want
    left = {r.key.customer_id: r.value.order_count for r in state.state_left(spark, f"{tmp_path}/c").collect()}
    assert left == {c: 1 if k % 2 else 2 for k, c in enumerate(people) if k % 2 or 100 * k + 4000 > 4385} | {"z": 1}
    J.run_available(J.running_user_features(stream, ttl_ms=day * 1000, buckets=1), J.table_sink(f"{tmp_path}/f"), f"{tmp_path}/d", "update")
    rows = [(r.customer_id, r.order_count, r.gmv) for r in spark.read.parquet(f"{tmp_path}/f/*").collect()]
    assert len(rows) == 81 and max(rows, key=lambda r: (r[0] == "c4", r[1])) == ("c4", 2, 7.0)


def test_rows_are_numbered_by_many_tasks(spark, tmp_path):
    """A partition's rows are put in order by ranges, over appends: offsets without gaps, in order, and no window over a whole partition."""
    path = f"{tmp_path}/t"
    topic.create(path, 2, 1000)
    for start, end in ((0, 6000), (6000, 6001), (6001, 9000)):
        topic.publish(rows_of(spark, start, end).orderBy(F.xxhash64("nr")).repartition(5), path, PART, ["nr"])
    got = sorted((r.partition, r.offset, r.value) for r in table_of(spark, path).collect())
    assert got == sorted((k % 2, k // 2, f"v{k}") for k in range(9000))
    assert not [f for f in topic.listed(f"{path}/_staged", "ordered")]


def test_slices_fill_their_files(spark, tmp_path, monkeypatch):
    """Most rows share a time and few lack one: each batch of files is a slice of the order of time, and no file is missing or empty."""
    monkeypatch.setattr(streams, "SLICE_FILE_ROWS", 250)
    time = F.when(F.col("id") % 3000 == 0, None).when(F.col("id") % 10 < 7, F.lit(1_000_000)).otherwise(1_000_000 + F.col("id") * 60)
    rows = lambda s, _: s.range(6000).select(F.timestamp_seconds(time).alias("event_time"), F.col("id").cast("string").alias("order_id"))
    folder, files = streams.event_files(spark, "", rows, closed=True, delayed=F.col("order_id").cast("long") % 10 == 9)
    assert files == 4
    J.run_available(streams.read_files(spark, folder, files).withColumn("file", F.input_file_name()), J.table_sink(f"{tmp_path}/out"), f"{tmp_path}/c")
    read = spark.read.parquet(f"{tmp_path}/out")
    batches = read.groupBy("batch").agg(F.count_distinct("file").alias("files"), F.min("event_time").alias("first"), F.max("event_time").alias("last"), F.count("*").alias("n")).orderBy("batch").collect()
    assert [b.files for b in batches] == [4] * len(batches) and len(batches) >= 5
    *early, first_end, second_end, late = batches
    assert (first_end.n, first_end.last.year, second_end.n, second_end.last.year, late.n) == (4, 2100, 4, 2101, 600)
    assert all(a.last < b.first for a, b in zip(early, early[1:])) and sum(b.n for b in early) == 5400
    assert read.filter("order_id <> 'end'").agg(F.count_distinct("order_id")).first()[0] == 6000


@pytest.mark.parametrize("name", ["T7_replay", "T8_late_rows", "S7_aggregate_sink"])
def test_slices_of_several_files(spark, sf, monkeypatch, name):
    monkeypatch.setattr(streams, "SLICE_FILE_ROWS", 40)
    monkeypatch.setattr(streams, "FILE_LEAST", 8)
    assert streams.event_files(spark, sf)[1] == 4
    assert differences(plans.QUERIES[name](spark, sf), plans.ORACLE[name], sf) == []


def test_a_task_writes_few_partitions(spark, tmp_path):
    """Days are written by the tasks of their ranges, not each by every task."""
    rows = spark.range(0, 4000, 1, 4).selectExpr("id AS k", "date_add(DATE '2024-01-01', CAST(id % 40 AS INT)) AS day", "id AS v")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in").groupBy("k", "day").agg(F.max("v").alias("v"))
    J.run_available(stream, J.upsert_sink(f"{tmp_path}/t", ["k", "day"], ["v"], "day"), f"{tmp_path}/c", "update")
    written = spark.read.parquet(f"{tmp_path}/t")
    assert written.count() == 4000 and len(written.inputFiles()) <= 40 + 4
