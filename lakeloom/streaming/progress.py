"""What running streams report: offsets and rows by batch, written as they come, and the lag that follows from them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.topic import head, write_json

ROW = "query_id string, run_id string, name string, batch_id long, time string, input_rows long, rows_per_second double, watermark string, sources array<struct<description:string,start:map<string,long>,end:map<string,long>,rows:long>>"


class ProgressLog(StreamingQueryListener):
    """Writes a JSON file for each batch of each query into a folder; a batch reported twice is one file.

    Offsets are kept of sources whose offsets are numbers by partition, such as a topic's.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        sources = [{"description": s.description, "start": by_partition(s.startOffset), "end": by_partition(s.endOffset), "rows": s.numInputRows} for s in p.sources]
        row = {"query_id": str(p.id), "run_id": str(p.runId), "name": p.name, "batch_id": p.batchId, "time": p.timestamp, "input_rows": p.numInputRows, "rows_per_second": float(p.processedRowsPerSecond or 0), "watermark": (p.eventTime or {}).get("watermark"), "sources": sources}
        write_json(f"{self.folder}/{p.id}-{p.batchId:020d}-{p.numInputRows > 0:d}.json", row)

    def onQueryTerminated(self, event) -> None:
        pass


def by_partition(offset: str | None) -> dict[str, int] | None:
    try:
        found = json.loads(offset) if offset else None
    except ValueError:
        return None
    return found if isinstance(found, dict) and all(p.isdigit() and isinstance(n, int) for p, n in found.items()) else None


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """The batches that a ``ProgressLog`` has written."""
    return spark.read.schema(ROW).json(folder)


def settled(spark: SparkSession) -> None:
    """Waits until listeners have heard of all batches so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()


def lag(spark: SparkSession, folder: str, topic: str) -> DataFrame:
    """By query and partition of a topic: where the query stands, the topic's end, and the lag between them.

    The position is the end of the query's newest batch; partitions that it hasn't seen yet stand at 0. Queries of other
    sources have no rows.
    """
    newest = Window.partitionBy("query_id").orderBy(F.col("batch_id").desc(), F.col("input_rows").desc())
    last = batches(spark, folder).select("query_id", "name", "batch_id", "input_rows", F.explode("sources").alias("s")).filter(F.col("s.end").isNotNull())
    last = last.withColumn("nr", F.row_number().over(newest)).filter("nr = 1")
    ends = F.from_json(F.lit(json.dumps(head(topic))), "map<string,long>")  # an entry a partition
    out = last.select("query_id", F.col("name").alias("consumer_group"), F.col("s.end").alias("at"), F.explode(ends).alias("p", "log_end_offset"))
    at = F.coalesce(F.try_element_at("at", F.col("p")), F.lit(0).cast("long"))
    out = out.select("query_id", "consumer_group", F.col("p").cast("int").alias("partition_id"), at.alias("current_offset"), "log_end_offset")
    return out.withColumn("lag", F.greatest(F.lit(0).cast("long"), F.col("log_end_offset") - F.col("current_offset")))
