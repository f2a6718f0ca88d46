"""Vectors worked out by hand, invariants and edge cases of the operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeloom.functions.columns import AS_OF, at, device_class, ip_state, raised, time_decay
from lakeloom.operators import alerts, asof, features, lineage, quality, stats, text
from lakeloom.operators import layers as L
from lakeloom.operators import versioned as V
from lakeloom.sources import adapters as A
from lakeloom.sources import landing, storage
from lakeloom.streaming import jobs


def holt(spark, values):
    df = spark.createDataFrame([(values,)], "v array<double>")
    return df.select(F.inline(stats.holt(F.col("v")))).collect()


def test_holt_short(spark):
    rows = holt(spark, [10.0, 12.0])
    assert [(r.predicted, round(r.lower_bound, 6), round(r.upper_bound, 6)) for r in rows] == [(12.0, 9.6, 14.4)] * 10


def test_holt_line(spark):
    assert [(round(r.predicted, 9), round(r.lower_bound, 9), round(r.upper_bound, 9)) for r in holt(spark, [1.0, 2.0, 3.0, 4.0, 5.0])] == [(k, k, k) for k in map(float, range(6, 16))]


def test_holt_five_points(spark):
    rows = holt(spark, [10.0, 12.0, 11.0, 15.0, 14.0])
    assert [round(r.predicted, 4) for r in rows[:2]] == [17.6222, 19.4247]
    assert (round(rows[0].lower_bound, 4), round(rows[0].upper_bound, 4), round(rows[9].upper_bound, 4)) == (13.5980, 21.6465, 41.4902)


def test_psi(spark):
    assert stats.population_stability([0.5, 0.5], [0.5, 0.5]) == 0 and stats.population_stability([0.5, 0.5], [0.25, 0.75]) == 0.274653
    h = lambda *s: spark.createDataFrame([("g", k + 1, x) for k, x in enumerate(s)], "k string, bucket long, share double")
    assert stats.psi(h(0.25, 0.75), h(0.5, 0.5), ["k"], 2).first().psi == pytest.approx(0.274653)
    labels = spark.createDataFrame([(0.0999,), (0.1,), (0.25,)], "x double").select(stats.psi_label(F.col("x")).alias("l")).collect()
    assert [r.l for r in labels] == ["stable", "monitor", "drift"]


def test_buckets(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0), (10.0, 0.0, 10.0), (99.0, 0.0, 10.0), (-5.0, 0.0, 10.0), (5.0, 5.0, 5.0), (None, 0.0, 1.0), (3.0, 0.0, 10.0)], "v double, l double, h double")
    assert [r.b for r in df.select(stats.bucket_of(F.col("v"), F.col("l"), F.col("h")).alias("b")).collect()] == [1, 10, 10, 1, 1, None, 4]


def test_histogram_shares_sum_to_one(spark, sf):
    h = A.feature_history(spark, sf)
    bounds = h.groupBy("group_name", "feature_name").agg(F.min("feature_value").alias("low"), F.max("feature_value").alias("high"))
    sums = stats.histogram(h, ["group_name", "feature_name"], "feature_value", bounds).groupBy("feature_name").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)


def test_score_and_repair(spark, sf):
    one = spark.createDataFrame([("price", "negative", 5, 0.05)], "field string, issue string, cnt long, rate double")
    assert quality.quality_score(one).first().quality_score == 80.0
    orders = A.dirty_orders(spark, sf)
    fixed = quality.repair(orders)
    ids = {r.order_id for r in fixed.select("order_id").collect()}
    back = orders.join(fixed.select("order_id"), "order_id", "left_semi")
    assert ids and fixed.exceptAll(back).count() == fixed.count()  # each row rewritten
    for c in ("event_time", "_kafka_offset"):
        assert fixed.select("order_id", c).exceptAll(orders.select("order_id", c)).count() == 0
    assert quality.repair(fixed).count() == 0
    merged = V.upsert(orders.withColumn("v", F.lit(1)), fixed.withColumn("v", F.lit(2)), ["order_id"], ["v"])
    assert merged.count() == orders.count() and quality.issues(quality.profile(merged)).filter("field = 'price'").count() == 0


T0 = dt.datetime(2024, 1, 1)


def alert_rows(spark, seconds, print_="f"):
    return spark.createDataFrame([(f"{print_}{s}", print_, T0 + dt.timedelta(seconds=s)) for s in seconds], "alert_id string, fingerprint string, fired_at timestamp")


def test_dedup_timeline(spark):
    both = alert_rows(spark, [0, 600, 900, 1700]).unionByName(alert_rows(spark, [600], "g"))
    assert {r.alert_id for r in alerts.dedup_alerts(both).collect()} == {"f0", "f900", "g600"}
    assert alerts.dedup_alerts(both.limit(0)).count() == 0


def test_dedup_is_a_plain_scan(spark):
    """Frequent and rare fingerprints over many days, ties, repeats and null times against a scan row by row."""
    import random

    r = random.Random(5)
    rows = [(f"{k}", r.choice("aaaabc"), T0 + dt.timedelta(seconds=r.randrange(6 * 86_400))) for k in range(1500)] + [(f"t{k}", "d", T0) for k in range(3)] + [("n", "a", None)]
    df = spark.createDataFrame(rows, "alert_id string, fingerprint string, fired_at timestamp").repartition(7)
    for window in (60, 900, 7200):
        want, last = set(), {}
        for id_, print_, time in sorted((x for x in rows if x[2]), key=lambda x: (x[1], x[2], x[0])):
            if print_ not in last or (time - last[print_]).total_seconds() >= window:
                last[print_] = time
                want.add(id_)
        assert {x.alert_id for x in alerts.dedup_alerts(df, window).collect()} == want


def test_silence(spark):
    a = spark.createDataFrame([("1", "s", "cpu_load"), ("2", "s", "disk"), ("3", "t", "cpu"), ("4", None, "x"), ("5", "u", None)], "alert_id string, source string, metric_name string")
    rule = lambda *rows: spark.createDataFrame([(x, y, T0 + dt.timedelta(days=d)) for x, y, d in rows], "source string, metric string, expires_at timestamp")
    left = lambda rules: sorted(r.alert_id for r in alerts.silence(a, rules, at(T0)).collect())
    assert left(rule(("s", "cpu", 1), ("t", "", -1))) == ["2", "3", "4", "5"]
    assert left(rule(("", "cpu", 1))) == ["2", "4", "5"] and left(rule(("", "", 1))) == [] and left(rule(("u", "", 1), ("s", "k", 1))) == ["1", "3", "4"]


def test_gate_counts_by_action(spark):
    at_ = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    rows = [("a", "high", at_(0)), ("a", "high", at_(30)), ("b", "high", at_(31)), ("a", "high", at_(60)), ("a", "high", at_(121)), ("a", "critical", at_(300))]
    df = spark.createDataFrame([(x, y, t, 1, 0) for x, y, t in rows], "action_type string, risk_level string, log_time timestamp, allowed int, dry_run int")
    got = {(r.action_type, r.log_time): (r.recent, r.may_run) for r in alerts.gate_actions(df).collect()}
    assert [got[x, t] for x, _, t in rows] == [(0, 1), (1, 0), (0, 1), (2, 0), (0, 1), (0, 0)]


def test_replay_under_any_cut(spark, tmp_path):
    """Orders that several batches share count once, whatever the batches and the job; a later job replaces its hours."""
    schema = "order_id string, customer_id string, product_category string, state string, order_status string, price double, event_time timestamp"
    row = lambda n, price=1.0: (str(n), "c", "k", "s", "created", price, T0 + dt.timedelta(minutes=n % 90))
    for k in range(5):
        spark.createDataFrame([row(n) for n in range(k, 60)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda files: spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/in")
    want = {(r.hour_start, r.order_cnt, r.total_gmv) for r in L.hourly_by_dimension(spark.read.schema(schema).parquet(f"{tmp_path}/in")).collect()}
    for version, (job, files) in enumerate((("job-9", 1), ("job-10", 2), ("job-11", 100), ("job-9", 1))):
        jobs.replay(stream(files), job, f"{tmp_path}/t", f"{tmp_path}/{job}-{version}", version)
        got = jobs.replayed_hours(spark, f"{tmp_path}/t").collect()
        assert {(r.hour_start, r.order_cnt, r.total_gmv) for r in got} == want and len(got) == len(want)
    jobs.replay(stream(3).withColumn("price", F.lit(0.0)), "older", f"{tmp_path}/t", f"{tmp_path}/older", -1)
    assert {(r.hour_start, r.order_cnt, r.total_gmv) for r in jobs.replayed_hours(spark, f"{tmp_path}/t").collect()} == want
    jobs.replay(stream(3).withColumn("price", F.lit(0.0)), "newer", f"{tmp_path}/t", f"{tmp_path}/newer", 99)
    assert {r.total_gmv for r in jobs.replayed_hours(spark, f"{tmp_path}/t").collect()} == {0.0}


def test_cosine_top_k_in_blocks(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 8))
    x[7] = x[3]
    rows = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(60)] + [(80, [0.0] * 8), (81, None), (82, [1.0])], "vec_id long, embedding array<float>")
    got = text.cosine_top_k(rows, rows.filter("vec_id % 20 = 0"), 3, block_rows=7, block_queries=2).collect()
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    for q in (0, 20, 40):
        best = sorted((1 - float(u[k] @ u[q]), k) for k in range(60) if k != q)[:3]
        mine = sorted((r.rank, r.vec_id, r.distance) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == [k for _, k in best] and all(abs(m[2] - d) < 1e-9 for m, (d, _) in zip(mine, best))
    assert {r.query_id for r in got} == {0, 20, 40}


def test_hour_baselines(spark):
    rows = [(1.0, T0 - dt.timedelta(hours=h), "c", "x") for h in (0.5, 23.5, 24.5)]
    orders = spark.createDataFrame(rows, "price double, event_time timestamp, customer_id string, order_status string")
    assert [L.hour_and_baseline(orders, T0, legacy).first().base_orders for legacy in (False, True)] == [1, 2]


def test_topic_options(spark, monkeypatch):
    """The Kafka source asks for the topic from its start and reads the value's JSON; no broker is needed to see that."""
    seen = {}

    class Reader:
        def format(self, x):
            seen["format"] = x
            return self

        def option(self, k, v):
            seen[k] = v
            return self

        def load(self):
            return spark.createDataFrame([(b'{"order_id":"1","price":2}',), (b"{broken",)], "value binary")

    class Session:
        readStream = Reader()

    got = landing.topic_stream(Session(), "host:9092", "orders", landing.ORDER_JSON, "order_id").collect()
    assert [r.order_id for r in got] == ["1"]
    assert seen == {"format": "kafka", "kafka.bootstrap.servers": "host:9092", "subscribe": "orders", "startingOffsets": "earliest"}


def test_severities(spark):
    df = spark.createDataFrame([("P3",), ("P2",), ("P1",), ("P4",)], "s string")
    assert [r.r for r in df.select(raised(F.col("s")).alias("r")).collect()] == ["P2", "P1", "P1", "P4"]
    a = spark.createDataFrame([("1", "P3", ["a"]), ("2", "P3", ["b"]), ("3", "P2", None)], "alert_id string, severity string, affected_tables array<string>")
    e = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("a", "a"), ("b", "x")], "source string, target string")
    got = {r.alert_id: (r.severity, r.downstream_tables) for r in lineage.enrich_alerts(a, e).collect()}
    assert got["1"] == ("P2", ["x", "y", "z"]) and got["2"] == ("P3", ["x"]) and got["3"][0] == "P2"


def test_lineage_chain(spark):
    chain = ["kafka.orders", "ods.orders", "dwd.detail", "dws.stats", "ads.hourly"]
    edges = spark.createDataFrame(list(zip(chain, chain[1:])), "source string, target string")
    pairs = lineage.closure(edges)
    assert {r.descendant for r in pairs.filter("ancestor = 'kafka.orders'").collect()} == set(chain[1:])
    root = lineage.impact(pairs).filter("node = 'kafka.orders'").first()
    assert (root.descendants, root.score, root.severity) == (4, 0.4, "P2")
    assert lineage.downstream(edges, "ads.hourly").count() == 0
    assert {r.node for r in lineage.downstream(edges, "kafka.orders", 3).collect()} == set(chain[1:4]) and {r.node for r in lineage.upstream(edges, "ads.hourly", 9).collect()} == set(chain[:4])
    loop = edges.unionByName(spark.createDataFrame([("ads.hourly", "kafka.orders")], edges.schema))
    assert lineage.closure(loop).count() == 20
    assert lineage.closure(edges.limit(0)).count() == 0


def test_edges_of_sql(spark):
    texts = [
        "INSERT INTO a.b SELECT 1 FROM c.d x JOIN e ON 1", "SELECT * FROM z.z", "DROP TABLE q", None, "-- INSERT INTO n.o SELECT * FROM n.p\nSELECT 1 /* FROM x.y\n */ FROM k.l", "insert into table A.B select * from system.parts join a.b on 1 join E.f using (x)",
        "CREATE OR REPLACE VIEW v.v AS SELECT * FROM c.d; CREATE TABLE IF NOT EXISTS m.t AS SELECT * FROM v.v JOIN c.d USING (x)", "CREATE MATERIALIZED VIEW m.v TO m.t AS SELECT to_date(x) FROM c.e", "ALTER TABLE c.d MOVE TO q.q",
    ]
    log = spark.createDataFrame([(x,) for x in texts], "query_sql string")
    assert {tuple(r) for r in lineage.edges_of_sql(log).collect()} == {("c.d", "a.b"), ("e.f", "a.b"), ("c.d", "v.v"), ("v.v", "m.t"), ("c.d", "m.t"), ("c.e", "m.v"), ("m.v", "m.t")}


def test_point_in_time(spark):
    h = spark.createDataFrame([("u", "f", 1.0, T0, 1), ("u", "f", 2.0, T0, 2), ("u", "f", 3.0, T0 + dt.timedelta(days=20), 3), ("u", "g", 9.0, T0 + dt.timedelta(days=1), 1), (None, "f", 5.0, T0, 1), ("u", "f", 7.0, None, 9)], "entity_id string, feature_name string, feature_value double, feature_time timestamp, version int")
    labels = [("u", T0 - dt.timedelta(seconds=1)), ("u", T0), ("u", T0), ("u", T0 + dt.timedelta(days=19)), ("u", T0 + dt.timedelta(days=20)), ("v", T0), (None, None), (None, T0 + dt.timedelta(days=1)), ("u", None), ("u", None)]
    df = spark.createDataFrame(labels, "entity_id string, event_time timestamp")
    got = sorted((str(r.event_time), r.entity_id or "", r.f, r.g) for r in asof.point_in_time(df, h, ["f", "g"]).collect())
    assert got == sorted([
        (str(labels[0][1]), "u", None, None), (str(T0), "u", 2.0, None), (str(T0), "u", 2.0, None), (str(labels[3][1]), "u", 2.0, 9.0), (str(labels[4][1]), "u", 3.0, 9.0), (str(T0), "v", None, None), ("None", "", None, None), (str(labels[7][1]), "", None, None), ("None", "u", None, None), ("None", "u", None, None),
    ])
    ttl = asof.point_in_time(df, h, ["f"], ttl_seconds=86_400).filter("event_time > '2024-01-10'").collect()
    assert sorted((r.f or 0) for r in ttl) == [0, 3.0]


def test_asof_reads_each_side_once(spark, sf):
    found = asof.point_in_time(A.feature_labels(spark, sf), A.feature_history(spark, sf), ["amount", "items"])
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 2 and plan.count("ReusedExchange") == 1


def test_asof_null_keys_and_times(spark):
    """A null in one of two keys finds nothing, not even a feature row that has it too; nor does a label without a time."""
    left = spark.sql("SELECT * FROM VALUES (1, 'a', TIMESTAMP '2024-03-01', 1), (1, null, TIMESTAMP '2024-03-01', 2), (1, 'a', null, 3), (null, null, null, 4), (1, 'a', TIMESTAMP '2024-03-01', 1) AS t(k, m, at, n)")
    right = spark.sql("SELECT * FROM VALUES (1, 'a', TIMESTAMP '2024-01-01', 5.0D, 1), (1, 'a', TIMESTAMP '2024-01-01', 6.0D, 2), (1, null, TIMESTAMP '2024-01-01', 7.0D, 3), (1, 'a', null, 8.0D, 4) AS t(k, m, since, x, v)")
    got = asof.asof_join(left, right, ["k", "m"], "at", "since", {"x": F.col("x")}, "v").select("n", "x.value").collect()
    assert sorted((r.n, r.value) for r in got) == [(1, 6.0), (1, 6.0), (2, None), (3, None), (4, None)]


def test_no_value_from_the_future(spark, sf):
    found = asof.asof_join(A.feature_labels(spark, sf), A.feature_history(spark, sf), ["entity_id"], "event_time", "feature_time", {"x": F.col("feature_value")}, "version", bucket_seconds=3600)
    assert found.count() == A.feature_labels(spark, sf).count()
    assert found.filter("x.time > event_time").count() == 0 and found.filter("x IS NOT NULL").count() > 0


def test_breach(spark):
    v = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 2.0), ("g", "c", 3.0)], "group_name string, feature_name string, feature_value double")
    f = spark.createDataFrame([("g", "a", 1, "use_default", 7.0), ("g", "b", 1, "skip_feature", 0.0), ("g", "c", 0, "raise_error", 0.0)], "group_name string, feature_name string, is_stale int, on_breach_action string, default_value_float double")
    assert {(r.feature_name, r.feature_value) for r in features.apply_breach(v, features.breach_actions(f)).collect()} == {("a", 7.0), ("c", 3.0)}
    with pytest.raises(Exception, match="stale feature c"):
        features.apply_breach(v, features.breach_actions(f.withColumn("is_stale", F.lit(1)))).collect()


def test_serving_view(spark, sf):
    orders = A.order_stream(spark, sf)
    hours = L.hourly_by_dimension(orders.filter("event_time < '2024-01-20 00:30:00'"))
    view = L.serving_hours(hours, L.minute_stats(orders))
    assert view.count() == view.select("hour_start").distinct().count()  # no hour counts twice
    none = L.serving_hours(hours.limit(0), L.minute_stats(orders))
    assert none.agg(F.sum("order_cnt")).first()[0] == orders.count()


def test_latest_version_is_idempotent(spark, sf):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    once = V.latest_version(A.lines(spark, sf), ["l_orderkey", "l_linenumber"], order)
    assert V.latest_version(once, ["l_orderkey", "l_linenumber"], order).exceptAll(once).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([("x Mobile",), ("Android tablet",), ("iPad",), ("PC",), (None,)], "ua string")
    assert [r.d for r in df.select(device_class(F.col("ua")).alias("d")).collect()] == ["MOBILE", "MOBILE", "TABLET", "DESKTOP", "UNKNOWN"]
    ips = spark.createDataFrame([("1.2.3.0",), ("1.2.3.28",), ("x",), (None,)], "ip string")
    assert [r.s for r in ips.select(ip_state(F.col("ip")).alias("s")).collect()] == ["AC", "AL", None, None]
    assert spark.range(1).select(time_decay(F.lit(5.0), 5.0).alias("x")).first().x == 0.5


def test_chunks():
    assert text.chunk_text("") == [] and text.chunk_text("a\n\n b ") == ["a\n\nb"]
    long = "x" * 1000
    assert [len(c) for c in text.chunk_text(long)] == [400, 400, 360, 40]
    three = text.chunk_text("a" * 300 + "\n\n" + "b" * 90 + "\n \t\n" + "c" * 200)
    assert three == ["a" * 300 + "\n\n" + "b" * 90, "b" * 80 + "\n\n" + "c" * 200]
    assert text.chunk_text("a\r\n\r\nb\n\n" + "c" * 401 + "\n\nd") == ["a\n\nb", "c" * 400, "c" * 81, "d"]


def test_landing(spark):
    raw = ['{"order_id":"1","price":5,"event_time":"2024-01-01 00:00:00"}', '{"order_id":"2","price":-1,"event_time":"2024-01-01 00:00:00"}', '{"order_id":"3","price":1,"event_time":"x"}', "{broken", "", None, '{"price":1}']
    df = spark.createDataFrame([(r,) for r in raw], "value string")
    assert [r.order_id for r in landing.land_orders(landing.parsed(df, landing.ORDER_JSON, "order_id")).collect()] == ["1"]


def test_storage(spark, tmp_path, sf):
    orders = A.order_stream(spark, sf).select("order_id", "price", "event_time")
    path = str(tmp_path / "a")
    orders.repartition(8).write.parquet(path)
    assert storage.compact(spark, path, path + "c") == 1
    assert spark.read.parquet(path + "c").exceptAll(orders).count() == 0
    batch = orders.withColumn("_batch_id", F.lit(1))
    assert storage.append_once(spark, batch, path + "b") == orders.count() and storage.append_once(spark, batch, path + "b") == 0
    halves = orders.withColumn("_batch_id", F.when(F.col("price") < 100, 1).otherwise(2))
    halves.filter("price < 50").write.partitionBy("_batch_id").parquet(path + "d")  # a run that failed inside its first batch
    assert storage.append_once(spark, halves.filter("_batch_id = 1"), path + "d") == halves.filter("_batch_id = 1").count()
    assert storage.append_once(spark, halves, path + "d") == halves.filter("_batch_id = 2").count()
    again = spark.read.parquet(path + "d").select(*halves.columns)
    assert again.exceptAll(halves).count() == 0 and again.count() == halves.count()
    g = storage.generated_orders(spark.range(1000), 3, T0)
    assert g.exceptAll(storage.generated_orders(spark.range(1000).repartition(7), 3, T0)).count() == 0
    assert g.join(storage.generated_payments(spark.range(1000), 3, T0), "order_id").count() == 1000


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "order_id string, customer_id string, product_category string, order_status string, price double, event_time timestamp"
    row = lambda n, minutes: (str(n), "c", "k", "created", 1.0, T0 + dt.timedelta(minutes=minutes))
    folder = str(tmp_path / "in")
    # Spark holds rows against the watermark of the batch before last: 3 comes after that of 2
    for part in ([row(1, 0), row(2, 10)], [row(5, 10)], [row(3, 1)], [row(4, 60)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.run_available(jobs.minute_statistics(stream, "5 seconds"), jobs.table_sink(str(tmp_path / "out")), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "out/*")).collect()
    assert sorted(r.window_start.minute for r in got) == [0, 10]


def test_upsert_runs_twice(spark, tmp_path, sf):
    rows = A.order_stream(spark, sf).select("order_id", "price", F.to_date("event_time").alias("day"), F.lit(1).alias("v"))
    sink = jobs.upsert_sink(str(tmp_path / "t"), ["order_id", "day"], ["v"], "day")
    sink(rows, 0)
    sink(rows, 0)
    sink(rows.limit(3).withColumns({"price": F.lit(-1.0), "v": F.lit(2)}), 1)
    got = spark.read.parquet(str(tmp_path / "t"))
    assert got.count() == rows.count() and got.filter("price = -1").count() == 3


def test_empty_inputs(spark, sf):
    none = A.order_stream(spark, sf).limit(0)
    for df in (L.hourly_sales(none), L.category_ranking(none), L.minute_stats(none), L.state_ranks(none), L.gmv_share(none), features.materialize_features(none, AS_OF), quality.repair(none), stats.drift_report(A.feature_history(spark, sf).limit(0), at(AS_OF))):
        assert df.count() == 0


def test_steady_alerts_are_spread(spark):
    """A fingerprint that fires each minute for forty days: every fifteenth passes, and no Python runs."""
    rows = spark.range(40 * 1440).select(F.col("id").cast("string").alias("alert_id"), F.lit(None).cast("string").alias("fingerprint"), F.timestamp_seconds(F.col("id") * 60).alias("fired_at"))
    out = alerts.dedup_alerts(rows)
    assert out.agg(F.count("*"), F.sum(F.col("alert_id").cast("long") % 15)).first()[:] == (40 * 96, 0)
    assert "Python" not in out._jdf.queryExecution().toString() and "MapInPandas" not in out._jdf.queryExecution().toString()
    assert alerts.dedup_alerts(rows, 0).count() == 40 * 1440


def test_closure_of_chains_and_cycles(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "source string, target string")
    chain = lineage.closure(pairs([(f"{k}", f"{k + 1}") for k in range(400)]))
    assert chain.count() == 400 * 401 // 2
    cycle = lineage.closure(pairs([(f"{k}", f"{(k + d) % 60}") for k in range(60) for d in (0, 1, 7)]))
    assert cycle.count() == 60 * 59
    import random

    r = random.Random(4)
    edges = [(f"{r.randrange(25)}", f"{r.randrange(25)}") for _ in range(30)]
    want = {e for e in edges}
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    assert {tuple(x) for x in lineage.closure(pairs(edges)).collect()} == {(a, b) for a, b in want if a != b}


def test_edges_of_real_statements(spark):
    """Names of WITH, subqueries, quotes, strings, comments, functions and names without a database."""
    cases = {
        "INSERT INTO dws.a WITH x AS (SELECT * FROM ods.b), y AS (SELECT * FROM x JOIN ods.c USING (id)) SELECT * FROM y, x": {("ods.b", "dws.a"), ("ods.c", "dws.a")},
        "INSERT INTO a SELECT 'FROM ods.z; it''s', \"FROM\" FROM \"ods\".\"B c\" -- JOIN ods.y\n JOIN `ods`.`d` ON 1 = 1 /* FROM ods.w; */": {("ods.b c", "default.a"), ("ods.d", "default.a")},
        "CREATE OR REPLACE VIEW v.a AS SELECT * FROM (SELECT * FROM ods.b WHERE id IN (SELECT id FROM ods.c)) q LEFT JOIN LATERAL (SELECT 1 FROM ods.d) ON true": {("ods.b", "v.a"), ("ods.c", "v.a"), ("ods.d", "v.a")},
        "CREATE TABLE IF NOT EXISTS m.a AS SELECT extract(day FROM t), trim(both 'x' FROM s) FROM ods.b b, ods.c WHERE x IS DISTINCT FROM y GROUP BY a, ods.q": {("ods.b", "m.a"), ("ods.c", "m.a")},
        "INSERT OVERWRITE TABLE m.a (k, v) SELECT * FROM numbers(10) JOIN cat.ods.b UNION ALL SELECT * FROM ods.c ORDER BY 1, 2": {("ods.b", "m.a"), ("ods.c", "m.a")},
        "MERGE INTO m.a t USING ods.s ON t.k = s.k WHEN MATCHED THEN UPDATE SET v = s.v": {("ods.s", "m.a")},
        "CREATE MATERIALIZED VIEW mv.a TO m.b AS SELECT * FROM ods.c; INSERT INTO m.d SELECT * FROM m.b": {("ods.c", "mv.a"), ("mv.a", "m.b"), ("m.b", "m.d")},
        "INSERT INTO m.a SELECT * FROM (WITH x AS (SELECT 1 FROM ods.b) SELECT * FROM x) JOIN x": {("ods.b", "m.a"), ("default.x", "m.a")},
        "INSERT INTO m.a WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n FROM r JOIN ods.e) SELECT * FROM r": {("ods.e", "m.a")},
        "SELECT * FROM ods.b; DELETE FROM ods.c; SYSTEM FLUSH LOGS; INSERT INTO m.a SELECT * FROM system.parts": set(),
    }
    for sql, want in cases.items():
        got = {tuple(r) for r in lineage.edges_of_sql(spark.createDataFrame([(sql,), (None,)], "query_sql string"), default="default").collect()}
        assert got == want, sql
