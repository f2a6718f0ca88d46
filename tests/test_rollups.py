"""Sketches, range joins, views and compaction: brute force, tolerances and edge cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lakeloom.functions.columns import AS_OF, at
from lakeloom.operators import features, ranges, sketches, stats
from lakeloom.sources import adapters as A
from lakeloom.sources import compaction


def test_addresses(spark):
    given = {"0.0.0.0": 0, "255.255.255.255": (1 << 32) - 1, "10.1.2.3": (10 << 24) + (1 << 16) + (2 << 8) + 3, "256.1.1.1": None, "1.2.3": None, "1.2.3.4.5": None, "1.2.3.4.": None, "a.b.c.d": None, "": None, "01.2.3.4": None, None: None}
    df = spark.createDataFrame([(x,) for x in given], "ip string")
    assert {r.ip: r.n for r in df.select("ip", ranges.address(F.col("ip")).alias("n")).collect()} == given


def test_blocks_cover_each_range_once(spark):
    r = random.Random(3)
    top = (1 << 32) - 1
    given = [(0, top), (5, 5), (0, 255), (1, 256), (255, 256), (65_535, 131_073), (top, top), (9, 3), (None, 4), (4, None), (-1, 3), (0, top + 1)]
    given += [tuple(sorted((r.randrange(top), r.randrange(top)))) for _ in range(40)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(given)], "k int, start long, end long")
    found: dict = {}
    for b in ranges.blocks(df).collect():
        size = 1 << 32 - b.level
        found.setdefault(b.k, []).append((b.block * size, (b.block + 1) * size - 1))
    for k, (start, end) in enumerate(given):
        if start is None or end is None or not 0 <= start <= end <= top:
            assert k not in found
            continue
        parts = sorted(found[k])
        assert (parts[0][0], parts[-1][1]) == (start, end) and all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:])) and len(parts) <= 256 + 3 * 510


def test_enclosing_is_the_smallest(spark):
    r = random.Random(4)
    known = [(f"r{k}", s := r.randrange(5000) * 97, s + r.randrange(1, 40_000)) for k in range(300)] + [("r7", 0, 1 << 24), ("tie", 0, 1 << 24), ("none", None, 5)]
    asked = [None, 0, (1 << 32) - 1, *(r.randrange(600_000) for _ in range(500))]
    df = spark.createDataFrame([(k, n, "x") for k, n in enumerate(asked)], "k int, n long, level string")
    got = {x.k: x.region for x in ranges.enclosing(df, F.col("n"), spark.createDataFrame(known, "region string, start long, end long"), "region").collect()}
    best = lambda n: min(((e - s, s, v) for v, s, e in known if n is not None and s is not None and s <= n <= e), default=(0, 0, None))[2]
    assert got == {k: best(n) for k, n in enumerate(asked)}
    assert ranges.enclosing(df, F.col("n"), spark.createDataFrame([], "region string, start long, end long"), "region").filter("region IS NULL").count() == len(asked)


def test_covers_are_few(spark):
    """Two rows a range at most, whatever its ends, and each number of a range finds it by one block; the lookup broadcasts no ranges."""
    r, top = random.Random(5), (1 << 32) - 1
    given = [(0, top), (5, 5), (0, 255), (255, 256), (1, top), (top, top), (9, 3), (None, 4), (-1, 3), (0, top + 1), (8003, 20_000)]
    given += [(s := r.randrange(top - (1 << 24)), s + r.randrange(1 << r.randrange(1, 24))) for _ in range(60)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(given)], "k int, start long, end long")
    found: dict = {}
    for c in ranges.covers(df).collect():
        found.setdefault(c.k, []).append((c.level, c.block))
    for k, (start, end) in enumerate(given):
        if start is None or not 0 <= start <= end <= top:
            assert k not in found
            continue
        assert len(found[k]) <= 2 and 1 << found[k][0][0] < 2 * (end - start + 1)
        for n in (start, (start + end) // 2, end):
            assert sum(n >> level == block for level, block in found[k]) == 1
    asked = spark.range(1000).withColumn("n", F.col("id") * 4_000_000)
    plan = ranges.enclosing(asked, F.col("n"), df.selectExpr("cast(k AS string) AS v", "start", "end"), "v")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [level" in plan


def test_distinct_counts_roll_up(spark):
    """Within two percent of exact for many customers, from hours, whatever the order of merging; nothing is expanded."""
    rows = spark.range(400_000).select(F.concat(F.lit("o"), F.col("id")).alias("order_id"), F.concat(F.lit("c"), F.col("id") % 60_000).alias("customer_id"), F.lit(1.0).alias("price"), F.lit("canceled").alias("order_status"), F.timestamp_seconds(F.col("id") % (72 * 3600)).alias("event_time"))
    hours = sketches.sales_sketches(rows)
    plan = hours._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and hours.count() == 72
    got = {r.period_start.day: r for r in sketches.sales_of(hours, "day").collect()}
    want = rows.groupBy(F.dayofmonth("event_time").alias("d")).agg(F.count_distinct("order_id").alias("o"), F.count_distinct("customer_id").alias("c"), F.count("*").alias("n")).collect()
    for w in want:
        assert abs(got[w.d].order_cnt / w.o - 1) < 0.02 and abs(got[w.d].unique_customers / w.c - 1) < 0.02 and got[w.d].total_gmv == w.n == got[w.d].cancel_cnt
    month = sketches.sales_of(hours, "month").first()
    assert abs(month.unique_customers / 60_000 - 1) < 0.02
    assert sketches.sales_of(sketches.sales_sketches(rows.limit(0)), "day").count() == 0


def test_ids_roll_up_exactly(spark):
    """More orders and customers than a sketch counts exactly, null ids and a null category: with the hours' ids the counts are exact."""
    rows = spark.range(120_000).select(F.expr("if(id % 11 = 0, null, concat('o', id % 90000))").alias("order_id"), F.expr("if(id % 5 = 0, null, concat('c', id % 30000))").alias("customer_id"), F.expr("nullif(concat('k', id % 3), 'k2')").alias("product_category"), F.lit(1.0).alias("price"), F.lit("created").alias("order_status"), F.timestamp_seconds(F.col("id") % (50 * 3600)).alias("event_time"))
    rows = rows.union(spark.sql("SELECT null, null, 'none', 1.0D, 'created', timestamp_seconds(5)"))
    by = ["product_category"]
    for period, names in (("day", []), ("week", by)):
        got = sketches.sales_of(sketches.sales_sketches(rows, by), period, names, sketches.sales_ids(rows, by))
        want = rows.groupBy(F.date_trunc(period, "event_time").alias("t"), *names).agg(F.count_distinct("order_id"), F.count_distinct("customer_id"))
        assert sorted(map(str, (tuple(r) for r in got.select("period_start", *names, "order_cnt", "unique_customers").collect()))) == sorted(map(str, (tuple(r) for r in want.collect())))


def test_drift_of_sketches(spark, sf):
    """As the exact index within the sketches' rank error; features without values in a period have no index."""
    h = A.feature_history(spark, sf)
    for folder in (sf, sf.replace("0.001", "0.01")):
        h = A.feature_history(spark, folder)
        exact = {r.feature_name: r for r in stats.drift_report(h, at(AS_OF)).collect()}
        for r in sketches.drift(sketches.feature_sketches(h), at(AS_OF)).collect():
            e = exact[r.feature_name]
            assert abs(r.psi - e.psi) < 0.05 + 0.2 * e.psi and r.current_cnt == e.current_cnt and r.null_rate == e.null_rate
    lost = h.withColumn("feature_value", F.when(F.col("feature_name") != "dwell", F.col("feature_value"))).filter("feature_name <> 'items' OR feature_time < TIMESTAMP '2024-01-30'")
    got = {r.feature_name: (r.psi is None, r.is_drifted) for r in sketches.drift(sketches.feature_sketches(lost), at(AS_OF)).collect()}
    assert got["dwell"] == (True, 1) and got["items"] == (True, 0) and not got["amount"][0]


def test_views_of_sellers_and_categories(spark):
    rows = [("o1", "p1", "a", "s1", 80.0, 1), ("o1", "p2", "a", "s1", 20.0, 1), ("o2", "p1", "a", "s2", 60.0, 20), ("o3", "p1", "a", "s3", 40.0, 20), ("o4", "p1", None, None, None, 1), ("o5", "p9", "b", "s1", 0.0, 400)]
    df = spark.createDataFrame([(*r[:5], r[5]) for r in rows], "order_id string, product_id string, product_category string, seller_id string, price double, age int")
    df = df.withColumn("event_time", at(AS_OF) - F.make_dt_interval(F.col("age")))
    got = {r.seller_id: tuple(r)[1:] for r in features.seller_statistics(df, at(AS_OF)).collect()}
    assert got == {"s1": (100.0, 1, 3), "s2": (0.0, 0, 1), "s3": (0.0, 0, 1), None: (0.0, 1, 1)}
    got = {r.product_category: tuple(r)[1:] for r in features.category_statistics(df, at(AS_OF)).collect()}
    assert got == {"a": (50.0, 2), None: (None, 0), "b": (0.0, 0)}
    for buckets in (1, 3, 64):
        many = spark.range(3000).selectExpr("cast(id as string) AS order_id", "'p' AS product_id", "'c' AS product_category", "cast(id AS string) AS seller_id", "pow(id % 500, 2) AS price").withColumn("event_time", at(AS_OF) - F.make_dt_interval(F.lit(1)))
        prices = sorted((float(k % 500) ** 2 for k in range(3000)), reverse=True)
        running = n = 0
        while running < 0.8 * sum(prices):
            running, n = running + prices[n], n + 1
        assert features.category_statistics(many, at(AS_OF), buckets=buckets).first().top_seller_cnt == n


def test_bins():
    r = random.Random(1)
    for _ in range(50):
        sizes = [r.randrange(1, 60) for _ in range(r.randrange(0, 200))]
        bins = compaction.packed(sizes, 100)
        assert sorted(k for b in bins for k in b) == list(range(len(sizes)))
        filled = [sum(sizes[k] for k in b) for b in bins]
        assert all(f <= 100 for f in filled) and sum(f >= 90 for f in filled) >= len(filled) - 1 - len(filled) // 4


def test_compaction_touches_small_files_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    small = spark.range(4000).selectExpr("id", "uuid() AS u", "id % 2 AS part").persist()
    small.repartition(12).write.partitionBy("part").parquet(path)
    spark.range(90_000).selectExpr("id + 10000 AS id", "uuid() AS u", "0 AS part").coalesce(1).write.mode("append").partitionBy("part").parquet(path)
    before = {r.file: r.length for r in compaction.file_sizes(spark, path).collect()}
    rows = {tuple(r) for r in spark.read.parquet(path).collect()}
    target = 4 * max(n for n in before.values() if n < 1_000_000)
    large = {f for f, n in before.items() if n >= target}
    bins = compaction.plan(spark, path, target).collect()
    assert large and not large & {f for b in bins for f in b.files} and all(b.bytes <= target and len(b.files) > 1 for b in bins)
    assert compaction.compact(spark, path, target) == 24
    after = {r.file for r in compaction.file_sizes(spark, path).collect()}
    assert large <= after and len(after) == len(large) + len(bins) < len(before)
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == rows
    assert compaction.compact(spark, path, 1000) == 0
