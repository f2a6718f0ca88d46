"""The canonical inputs, derived from the given tables: one function and one SQL text for each.

Every adapter is a projection or a join of given tables, so what is built on it grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import fingerprint, rounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(n: F.Column, values: list[str]) -> F.Column:
    """The value at n modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


STATUSES = ["created", "approved", "invoiced", "processing", "shipped", "delivered", "canceled", "unavailable"]
PAYMENT_TYPES = ["credit_card", "boleto", "voucher", "debit_card"]
SOURCES = ["rule_engine", "anomaly_detector", "trend_predictor", "drift_monitor"]
RISKS = ["low", "medium", "high", "critical"]


def order_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").cast("string").alias("order_id"),
        F.concat(F.lit("C"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("customer_id"),
        F.concat(F.lit("P"), F.lpad(k.cast("string"), 6, "0")).alias("product_id"),
        F.col("event_type").alias("product_category"),
        F.concat(F.lit("S"), F.lpad((k % 20).cast("string"), 4, "0")).alias("seller_id"),
        F.col("value").alias("price"),
        rounded(F.col("value") * 0.1, 2).alias("freight_value"),
        F.when(F.col("event_type") == "error", "canceled").when(F.col("event_type") == "purchase", "delivered").otherwise("created").alias("order_status"),
        (F.col("user_id") % 15).cast("string").alias("state"),
        F.concat(F.lit("city"), (F.col("user_id") % 7).cast("string")).alias("city"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.col("event_id").alias("_kafka_offset"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    key = F.col("event_id").cast("string")
    return e.select(
        key.alias("payment_id"),
        key.alias("order_id"),
        pick(F.col("event_id"), PAYMENT_TYPES).alias("payment_type"),
        (F.col("value") + rounded(F.col("value") * 0.1, 2)).alias("payment_value"),
        (1 + F.col("event_id") % 12).cast("int").alias("installments"),
        F.col("ts").cast("timestamp").alias("event_time"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their real dimensions, by day. Keys are given, so each join keeps the lines."""
    t = lambda name: table(spark, sf_dir, name)
    joined = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("p_type").alias("product_category"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_returnflag") == "R", "canceled").otherwise("delivered").alias("order_status"),
        F.col("n_name").alias("state"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"),
    )


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_stream with damage that a producer's anomalies would do."""
    o, n = order_stream(spark, sf_dir), F.col("_kafka_offset")
    return o.withColumns({
        "price": F.when(n % 50 == 0, -F.col("price")).when(n % 61 == 0, F.col("price") * 1000).otherwise(F.col("price")),
        "product_category": F.when(n % 53 == 0, "").otherwise(F.col("product_category")),
        "customer_id": F.when(n % 59 == 0, F.concat(F.lit("INVALID_"), n.cast("string"))).otherwise(F.col("customer_id")),
        "order_status": F.when(n % 67 == 0, "lost").otherwise(F.col("order_status")),
        "state": F.when(n % 71 == 0, None).otherwise(F.col("state")),
    })


def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    n, u = F.col("event_id"), F.col("user_id")
    source, metric = pick(u, SOURCES), F.concat(F.lit("metric_"), (u % 10).cast("string"))
    category = pick(u, ["BUSINESS", "DATA", "INFRA"])
    return e.select(
        n.cast("string").alias("alert_id"), F.col("ts").cast("timestamp").alias("fired_at"), source.alias("source"), category.alias("category"),
        pick(n, ["P1", "P2", "P3", "P4"]).alias("severity"), F.concat(metric, F.lit(" out of range on node "), (n % 7).cast("string")).alias("title"), metric.alias("metric_name"),
        F.col("value").alias("current_value"), F.lit(250.0).alias("threshold_value"),
        F.when(n % 2 == 0, F.array(F.lit("dws.minute_stats"))).otherwise(F.array(F.lit("ods.orders"))).alias("affected_tables"),
        (n % 3 == 0).cast("int").alias("resolved"), fingerprint(source, metric, category).alias("fingerprint"),
    )


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was done about alerts: an action for each alert that isn't the fifth, by id."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error' AND event_id % 5 <> 0")
    n, u = F.col("event_id"), F.col("user_id")
    return e.select(
        (F.col("ts").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(5))).alias("log_time"), n.cast("string").alias("alert_id"),
        pick(u, ["restart", "replay", "repair"]).alias("skill_name"), pick(n, ["clear_stale_features", "restart_job", "drop_data"]).alias("action_type"),
        F.concat(F.lit("table_"), (u % 6).cast("string")).alias("target"), pick(u, RISKS).alias("risk_level"), (n % 4 == 1).cast("int").alias("dry_run"),
        (n % 7 != 1).cast("int").alias("allowed"), (n % 3 == 1).cast("int").alias("success"),
    )


def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'view'")
    n, u = F.col("event_id"), F.col("user_id")
    start = n * 10
    end = start + F.floor(F.col("value") * 1000).cast("long") - 5000
    return e.select(
        F.col("ts").cast("timestamp").alias("check_time"), F.concat(F.lit("group_"), (u % 5).cast("string")).alias("consumer_group"), F.concat(F.lit("topic_"), (u % 2).cast("string")).alias("topic"),
        (n % 3).cast("int").alias("partition_id"), start.alias("current_offset"), end.alias("log_end_offset"), F.greatest(F.lit(0), end - start).alias("lag"), (u % 5 == 4).cast("int").alias("is_replay"),
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's text names the tables it reads and the one it fills; some hold comments, views and two statements."""
    e = table(spark, sf_dir, "events")
    n, u = F.col("event_id"), F.col("user_id")
    name = lambda layer, k: F.concat(F.lit(layer), F.lit(".t"), k.cast("string"))
    sql = (
        F.when(n % 11 == 0, F.lit("  SYSTEM FLUSH LOGS"))
        .when(n % 13 == 0, F.concat(F.lit("-- copied FROM ods.t9\nCREATE MATERIALIZED VIEW "), name("mv", u % 3), F.lit(" TO "), name("dws", u % 6), F.lit(" AS SELECT * FROM /* JOIN ods.t8 */ "), name("DWD", n % 8), F.lit("; INSERT INTO "), name("ads", u % 4), F.lit(" SELECT * FROM "), name("dws", n % 6), F.lit(" JOIN system.parts")))
        .when(n % 2 == 0, F.concat(F.lit("INSERT INTO "), name("dwd", u % 8), F.lit(" SELECT * FROM "), name("ods", u % 5), F.lit(" JOIN "), name("ods", 1 + u % 7), F.lit(" USING (id)")))
        .otherwise(F.concat(F.lit("INSERT INTO "), name("dws", u % 6), F.lit(" SELECT count(*) FROM "), name("dwd", n % 8)))
    )
    return e.select(
        F.col("ts").cast("timestamp").alias("query_time"), F.floor(F.col("value") * 20).cast("long").alias("duration_ms"), sql.alias("query_sql"), (n * 100).alias("read_rows"), (n * 6400).alias("read_bytes")
    )


def replay_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    n, start = F.col("event_id"), F.col("ts").cast("timestamp")
    status = pick(n, ["done", "running", "failed", "done"])
    return e.select(
        n.cast("string").alias("job_id"), status.alias("status"), start.alias("started_at"),
        F.when(status != "running", F.timestamp_add("SECOND", (n % 600).cast("int"), start)).alias("finished_at"), (n * 50).alias("processed"),
    )


def feature_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long feature rows of users: a purchase gives amount and items, a view gives dwell."""
    e = table(spark, sf_dir, "events").filter("event_type IN ('purchase', 'view')")
    buy = F.col("event_type") == "purchase"
    rows = F.when(buy, F.array(F.struct(F.lit("amount").alias("f"), F.col("value").alias("v")), F.struct(F.lit("items").alias("f"), (F.col("event_id") % 9).cast("double").alias("v"))))
    rows = rows.otherwise(F.array(F.struct(F.lit("dwell").alias("f"), F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(F.col("value")).alias("v"))))
    return e.select("user_id", "ts", "event_id", F.explode(rows).alias("x")).select(
        F.col("user_id").cast("string").alias("entity_id"), F.lit("user").alias("group_name"), F.col("x.f").alias("feature_name"), F.col("x.v").alias("feature_value"),
        F.lit(None).cast("string").alias("feature_value_str"), F.col("ts").cast("timestamp").alias("feature_time"), F.col("ts").cast("timestamp").alias("computed_at"), F.col("event_id").alias("version"),
    )


def feature_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return e.select(F.col("event_id").alias("label_id"), F.col("user_id").cast("string").alias("entity_id"), F.col("ts").cast("timestamp").alias("event_time"), (F.col("event_id") % 2).cast("int").alias("label"))


def feature_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of the features that the history holds, but for one that has none."""
    names = feature_history(spark, sf_dir).select("group_name", "feature_name").distinct().filter("feature_name <> 'items'")
    amount = F.col("feature_name") == "amount"
    return names.select(
        "group_name", "feature_name", F.when(amount, -1.0).otherwise(0.5).alias("default_value_float"), F.when(amount, 86400).otherwise(3600).alias("max_staleness_seconds"),
        F.when(amount, "use_default").otherwise("skip_feature").alias("on_breach_action"),
    )


def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"), "role", F.col("text").alias("content"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with versions: lineitem by (l_orderkey, l_linenumber), its version the ship date."""
    return table(spark, sf_dir, "lineitem")


#: The same in SQL, as common table expressions.
CTE: dict[str, str] = {
    "order_stream": """order_stream AS (
        SELECT CAST(event_id AS VARCHAR) AS order_id, 'C' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS customer_id,
            'P' || lpad(json_extract_string(props, '$.k'), 6, '0') AS product_id, event_type AS product_category,
            'S' || lpad(CAST(CAST(json_extract_string(props, '$.k') AS INT) % 20 AS VARCHAR), 4, '0') AS seller_id,
            value AS price, floor(value * 0.1::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS freight_value,
            CASE event_type WHEN 'error' THEN 'canceled' WHEN 'purchase' THEN 'delivered' ELSE 'created' END AS order_status,
            CAST(user_id % 15 AS VARCHAR) AS state, 'city' || CAST(user_id % 7 AS VARCHAR) AS city, ts AS event_time, event_id AS _kafka_offset
        FROM events)""",
    "payments": """payments AS (
        SELECT CAST(event_id AS VARCHAR) AS payment_id, CAST(event_id AS VARCHAR) AS order_id,
            ['credit_card', 'boleto', 'voucher', 'debit_card'][event_id % 4 + 1] AS payment_type,
            value + floor(value * 0.1::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS payment_value, CAST(1 + event_id % 12 AS INT) AS installments, ts AS event_time
        FROM events WHERE event_type = 'purchase')""",
    "order_lines": """order_lines AS (
        SELECT l_orderkey AS order_id, o_custkey AS customer_id, p_type AS product_category, l_suppkey AS seller_id, l_extendedprice AS price, l_quantity AS quantity,
            CASE WHEN l_returnflag = 'R' THEN 'canceled' ELSE 'delivered' END AS order_status, n_name AS state, CAST(o_orderdate AS TIMESTAMP) AS event_time
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "dirty_orders": """dirty_orders AS (
        SELECT * REPLACE (
            CASE WHEN _kafka_offset % 50 = 0 THEN -price WHEN _kafka_offset % 61 = 0 THEN price * 1000 ELSE price END AS price,
            CASE WHEN _kafka_offset % 53 = 0 THEN '' ELSE product_category END AS product_category,
            CASE WHEN _kafka_offset % 59 = 0 THEN 'INVALID_' || _kafka_offset ELSE customer_id END AS customer_id,
            CASE WHEN _kafka_offset % 67 = 0 THEN 'lost' ELSE order_status END AS order_status,
            CASE WHEN _kafka_offset % 71 = 0 THEN NULL ELSE state END AS state)
        FROM order_stream)""",
    "alert_events": """alert_events AS (
        SELECT *, substr(md5(source || ':' || metric_name || ':' || category), 1, 16) AS fingerprint FROM (
            SELECT CAST(event_id AS VARCHAR) AS alert_id, ts AS fired_at, ['rule_engine', 'anomaly_detector', 'trend_predictor', 'drift_monitor'][user_id % 4 + 1] AS source,
                ['BUSINESS', 'DATA', 'INFRA'][user_id % 3 + 1] AS category, ['P1', 'P2', 'P3', 'P4'][event_id % 4 + 1] AS severity,
                'metric_' || (user_id % 10) || ' out of range on node ' || (event_id % 7) AS title, 'metric_' || (user_id % 10) AS metric_name,
                value AS current_value, 250.0::DOUBLE AS threshold_value, CASE WHEN event_id % 2 = 0 THEN ['dws.minute_stats'] ELSE ['ods.orders'] END AS affected_tables,
                CAST(event_id % 3 = 0 AS INT) AS resolved
            FROM events WHERE event_type = 'error'))""",
    "decision_log": """decision_log AS (
        SELECT ts + INTERVAL 5 MINUTE AS log_time, CAST(event_id AS VARCHAR) AS alert_id, ['restart', 'replay', 'repair'][user_id % 3 + 1] AS skill_name,
            ['clear_stale_features', 'restart_job', 'drop_data'][event_id % 3 + 1] AS action_type, 'table_' || (user_id % 6) AS target,
            ['low', 'medium', 'high', 'critical'][user_id % 4 + 1] AS risk_level, CAST(event_id % 4 = 1 AS INT) AS dry_run, CAST(event_id % 7 <> 1 AS INT) AS allowed, CAST(event_id % 3 = 1 AS INT) AS success
        FROM events WHERE event_type = 'error' AND event_id % 5 <> 0)""",
    "consumer_lag": """consumer_lag AS (
        SELECT *, greatest(0, log_end_offset - current_offset) AS lag FROM (
            SELECT ts AS check_time, 'group_' || (user_id % 5) AS consumer_group, 'topic_' || (user_id % 2) AS topic, CAST(event_id % 3 AS INT) AS partition_id, event_id * 10 AS current_offset,
                event_id * 10 + CAST(floor(value * 1000) AS BIGINT) - 5000 AS log_end_offset, CAST(user_id % 5 = 4 AS INT) AS is_replay
            FROM events WHERE event_type = 'view'))""",
    "query_log": """query_log AS (
        SELECT ts AS query_time, CAST(floor(value * 20) AS BIGINT) AS duration_ms,
            CASE WHEN event_id % 11 = 0 THEN '  SYSTEM FLUSH LOGS'
                WHEN event_id % 13 = 0 THEN '-- copied FROM ods.t9' || chr(10) || 'CREATE MATERIALIZED VIEW mv.t' || (user_id % 3) || ' TO dws.t' || (user_id % 6) || ' AS SELECT * FROM /* JOIN ods.t8 */ DWD.t' || (event_id % 8) || '; INSERT INTO ads.t' || (user_id % 4) || ' SELECT * FROM dws.t' || (event_id % 6) || ' JOIN system.parts'
                WHEN event_id % 2 = 0 THEN 'INSERT INTO dwd.t' || (user_id % 8) || ' SELECT * FROM ods.t' || (user_id % 5) || ' JOIN ods.t' || (1 + user_id % 7) || ' USING (id)'
                ELSE 'INSERT INTO dws.t' || (user_id % 6) || ' SELECT count(*) FROM dwd.t' || (event_id % 8) END AS query_sql,
            event_id * 100 AS read_rows, event_id * 6400 AS read_bytes
        FROM events)""",
    "replay_jobs": """replay_jobs AS (
        SELECT *, CASE WHEN status <> 'running' THEN started_at + to_seconds(CAST(job_id AS BIGINT) % 600) END AS finished_at FROM (
            SELECT CAST(event_id AS VARCHAR) AS job_id, ['done', 'running', 'failed', 'done'][event_id % 4 + 1] AS status, ts AS started_at, event_id * 50 AS processed
            FROM events WHERE event_type = 'signup'))""",
    "feature_history": """feature_history AS (
        SELECT CAST(user_id AS VARCHAR) AS entity_id, 'user' AS group_name, x.f AS feature_name, x.v AS feature_value, CAST(NULL AS VARCHAR) AS feature_value_str, ts AS feature_time, ts AS computed_at, event_id AS version
        FROM (SELECT *, unnest(CASE WHEN event_type = 'purchase' THEN [{'f': 'amount', 'v': value}, {'f': 'items', 'v': CAST(event_id % 9 AS DOUBLE)}]
            ELSE [{'f': 'dwell', 'v': CASE WHEN event_id % 10 = 0 THEN 0.0::DOUBLE ELSE value END}] END) AS x FROM events WHERE event_type IN ('purchase', 'view')))""",
    "feature_labels": """feature_labels AS (
        SELECT event_id AS label_id, CAST(user_id AS VARCHAR) AS entity_id, ts AS event_time, CAST(event_id % 2 AS INT) AS label FROM events WHERE event_type = 'error')""",
    "feature_contracts": """feature_contracts AS (
        SELECT DISTINCT group_name, feature_name, CASE WHEN feature_name = 'amount' THEN -1.0::DOUBLE ELSE 0.5::DOUBLE END AS default_value_float,
            CASE WHEN feature_name = 'amount' THEN 86400 ELSE 3600 END AS max_staleness_seconds, CASE WHEN feature_name = 'amount' THEN 'use_default' ELSE 'skip_feature' END AS on_breach_action
        FROM feature_history WHERE feature_name <> 'items')""",
    "chat_sessions": "chat_sessions AS (SELECT conv_id AS session_id, turn AS turn_index, role, text AS content FROM conversations)",
}
#: What an expression itself builds on.
NEEDS = {"dirty_orders": ["order_stream"], "feature_contracts": ["feature_history"]}


def sql(names: str, body: str) -> str:
    """body behind the expressions it names, separated by spaces; body may go on with further ones after a comma."""
    wanted: list[str] = []
    for n in names.split():
        wanted += [x for x in (*NEEDS.get(n, ()), n) if x not in wanted]
    body = body.strip()
    return "WITH RECURSIVE " + ",\n".join(CTE[n] for n in wanted) + (body if body.startswith(",") else "\n" + body)


def money_sql(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


def rounded_sql(x: str, digits: int) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5::DOUBLE) / 1e{digits})"
