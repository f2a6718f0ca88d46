"""Lineage: edges from query texts, neighbours, closures, impact; query-log analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ago, raised, settle
from .sqltext import effects, visible


#: Databases whose tables are no part of lineage.
SYSTEM = ("system", "information_schema")


def statements(log: DataFrame, text: str = "query_sql") -> DataFrame:
    """One row a statement of the distinct texts, comments and strings taken out."""
    return log.select(text).distinct().select(F.explode(F.split(visible(F.col(text)), ";")).alias("statement")).filter(F.trim("statement") != "")


def edges_of_sql(log: DataFrame, text: str = "query_sql", default: str | None = None) -> DataFrame:
    """(source, target) of the statements in some texts, names in lower case as database.table.

    What a statement reads feeds the table that it inserts or merges into, and the view or table that it
    creates; a materialized view feeds the table behind its TO. Names that a WITH gives aren't tables, nor is what stands in
    strings and comments; names may be quoted; one without a database is of the default one, or doesn't count if there is none;
    of one with a catalog the last two parts count. Tables of the system are left out. Texts may hold several statements; null ones hold none.
    """
    home = F.lit(f"{default}.") if default else F.lit(None).cast("string")
    full = lambda c: F.when(F.instr(c, ".") > 0, F.substring_index(c, ".", -2)).otherwise(F.concat(home, F.translate(c, '"', "")))
    rows = statements(log, text).select(effects(F.col("statement")).alias("e")).select(F.transform("e.sources", full).alias("sources"), *(full(F.col(f"e.{c}")).alias(c) for c in ("filled", "made", "view", "written")))
    targets = F.array_distinct(F.array_compact(F.array("filled", F.coalesce("view", "made"))))
    pairs = rows.select(F.explode(targets).alias("target"), "sources").select(F.explode("sources").alias("source"), "target")
    pairs = pairs.unionByName(rows.select(F.col("view").alias("source"), F.col("written").alias("target")))
    ours = lambda c: ~F.substring_index(c, ".", 1).isin(*SYSTEM)
    return pairs.filter(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("source") != F.col("target")) & ours("source") & ours("target")).distinct()


def reached(edges: DataFrame, node: str, here: str, there: str, depth: int) -> DataFrame:
    """(node, depth) of what up to so many edges lead to; each at its least depth, the start apart."""
    out = edges.filter(F.col(here) == node).select(F.col(there).alias("node")).filter(F.col("node") != node).distinct().withColumn("depth", F.lit(1))
    for n in range(2, depth + 1):
        out = settle(edges.sparkSession, out) if n > 2 else out
        ends = out.filter(F.col("depth") == n - 1).select(F.col("node").alias(here))
        if n > 2 and not ends.limit(1).count():
            break
        step = edges.join(ends, here).select(F.col(there).alias("node")).filter(F.col("node") != node).distinct()
        out = out.unionByName(step.join(out.select("node"), "node", "left_anti").withColumn("depth", F.lit(n)))
    return out


def upstream(edges: DataFrame, node: str, depth: int = 1) -> DataFrame:
    """What feeds a node over up to depth edges."""
    return reached(edges, node, "target", "source", depth).select("node")


def downstream(edges: DataFrame, node: str, depth: int = 1) -> DataFrame:
    """What a node feeds over up to depth edges."""
    return reached(edges, node, "source", "target", depth).select("node")


def closure(edges: DataFrame) -> DataFrame:
    """All (ancestor, descendant) pairs of different nodes.

    Round r knows the pairs of walks of up to 2**r edges, and apart from them those of exactly 2**r. Only the first are
    joined with the second, never with themselves: so each new pair comes from one cut of its walk, not from all
    of them, and a chain costs what its pairs are. Of the second only pairs that were new in their round stay, as parts of shortest
    walks are shortest walks; so cycles end. Rounds are the logarithm of the longest of these.
    """
    spark = edges.sparkSession
    exact = settle(spark, edges.select("source", "target").filter("source <> target").distinct())
    pairs = exact.select(F.col("source").alias("ancestor"), F.col("target").alias("descendant"))
    while True:
        step = exact.select(F.col("source").alias("descendant"), F.col("target").alias("next"))
        longer = pairs.join(step, "descendant").select("ancestor", F.col("next").alias("descendant")).filter("ancestor <> descendant").distinct()
        new = settle(spark, longer.join(pairs, ["ancestor", "descendant"], "left_anti"))
        if not new.limit(1).count():
            return pairs
        pairs = settle(spark, pairs.unionByName(new))
        onward = exact.select(F.col("source").alias("target"), F.col("target").alias("next"))
        exact = settle(spark, exact.join(onward, "target").select("source", F.col("next").alias("target")).filter("source <> target").distinct().join(new.select(F.col("ancestor").alias("source"), F.col("descendant").alias("target")), ["source", "target"], "left_semi"))


def impact(pairs: DataFrame) -> DataFrame:
    """Score and severity of each node by the number of its descendants."""
    n = pairs.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("descendants"))
    score = F.least(F.col("descendants") / 10, F.lit(1.0))
    return n.withColumn("score", score).withColumn("severity", F.when(score > 0.7, "P1").when(score > 0.3, "P2").otherwise("P3"))


def two_hops(edges: DataFrame) -> DataFrame:
    """(node, affected, hop) of direct successors, and of theirs that aren't direct ones."""
    one = edges.select(F.col("source").alias("node"), F.col("target").alias("affected")).distinct()
    two = one.join(edges.select(F.col("source").alias("affected"), F.col("target").alias("next")), "affected").select("node", F.col("next").alias("affected")).distinct()
    two = two.filter("node <> affected").join(one, ["node", "affected"], "left_anti")
    return one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2)))


def enrich_alerts(alerts: DataFrame, edges: DataFrame, wide: int = 3) -> DataFrame:
    """Alerts with the direct successors of their tables, and one severity higher if those are ``wide`` or more.

    Successors are gathered by table before the join; alerts are exploded by table and put together again.
    """
    after = edges.groupBy(F.col("source").alias("_table")).agg(F.collect_set("target").alias("_after"))
    tables = alerts.select("alert_id", "affected_tables", F.explode_outer("affected_tables").alias("_table"))
    found = tables.join(after, "_table", "left").groupBy("alert_id").agg(F.array_distinct(F.flatten(F.collect_list("_after"))).alias("_all"))
    out = alerts.join(found, "alert_id", "left").withColumn("downstream_tables", F.array_sort(F.array_except(F.coalesce("_all", F.array().cast("array<string>")), F.col("affected_tables"))))
    return out.drop("_all").withColumn("severity", F.when(F.size("downstream_tables") >= wide, raised(F.col("severity"))).otherwise(F.col("severity")))


def slow_queries(log: DataFrame, as_of: Column, slow_ms: int = 3000, hours: int = 1, limit: int = 50) -> DataFrame:
    """The slowest queries of the last hours, but for those of the system."""
    text = F.lower(F.ltrim("query_sql"))
    hit = log.filter((F.col("query_time") >= ago(as_of, hours=hours)) & (F.col("query_time") < as_of) & (F.col("duration_ms") > slow_ms) & ~F.startswith(text, F.lit("system")))
    return hit.orderBy(F.desc("duration_ms"), "query_time").limit(limit)


def not_seen(queries: DataFrame, seen: DataFrame) -> DataFrame:
    """Queries whose text hasn't been analysed yet."""
    return queries.join(seen.select("query_sql"), "query_sql", "left_anti")


def slow_summary(log: DataFrame, slow_ms: int = 3000) -> DataFrame:
    """Slow queries by kind: count, mean, longest, total."""
    kind = F.when(F.lower("query_sql").contains(" join "), "join").when(F.lower("query_sql").contains("count("), "aggregate").otherwise("other")
    return log.filter(F.col("duration_ms") > slow_ms).groupBy(kind.alias("kind")).agg(F.count("*").alias("query_cnt"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"), F.sum("duration_ms").alias("total_ms"))
