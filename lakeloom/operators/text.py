"""Text and vectors: chunking of documents, cosine top-k, sessions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


BLANK = re.compile(r"\n\s*\n")


def chunk_text(text: str, size: int = 400, overlap: int = 80) -> list[str]:
    """Paragraphs packed into chunks while their characters, separators apart, keep to size.

    Paragraphs stand between blank lines, which may hold white space. One that doesn't fit starts a chunk behind
    the last ``overlap`` characters of the chunk before; one longer than size is sliced, each slice
    ``size - overlap`` after the last, and nothing of it is carried on.
    """
    out: list[str] = []
    held = ""
    for paragraph in filter(None, map(str.strip, BLANK.split(text))):
        if len(held) + len(paragraph) <= size:
            held = f"{held}\n\n{paragraph}" if held else paragraph
            continue
        if held:
            out.append(held)
        if len(paragraph) > size:
            slices = (paragraph[at : at + size] for at in range(0, len(paragraph), size - overlap))
            out += (x for x in slices if x.strip())
            held = ""
        else:
            held = f"{held[-overlap:]}\n\n{paragraph}".strip() if held and overlap else paragraph
    return out + [held] * bool(held.strip())


def chunks(docs: DataFrame, id_column: str, text_column: str, size: int = 400, overlap: int = 80) -> DataFrame:
    """(id, chunk_no, chunk) of each document; empty and null texts have none."""
    kind = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [chunk_text(t or "", size, overlap) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.string()))], names=["id", "parts"])

    rows = docs.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(run, f"id {kind.simpleString()}, parts array<string>")
    return rows.select(F.col("id").alias(id_column), F.posexplode("parts").alias("chunk_no", "chunk"))


def cosine_top_k(rows: DataFrame, queries: DataFrame, k: int = 3, block_rows: int = 8192, block_queries: int = 8192) -> DataFrame:
    """query_id, rank, vec_id and cosine distance of each query's k nearest rows; ties go to the smaller id.

    A stated set of queries meets all rows, exactly: rows and queries are dealt into blocks by a hash of the id, each
    block of queries visits every block of rows, and of a query's distances there the best k go on. So a task holds
    one block of each however many there are, but the work is queries times rows: for large sets an index is the
    way. A row of the query's own id is no candidate. Null and zero vectors, and those of another length than most, take no part.
    """
    some = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL AND exists(embedding, x -> x <> 0) AND forall(embedding, x -> x IS NOT NULL)")
    r, q = some(rows), some(queries)
    most = r.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d, n = (most[0].d, most[0].n) if most else (0, 0)
    r, q = r.filter(F.size("embedding") == d), q.filter(F.size("embedding") == d)
    blocks, turns = max(1, -(-n // block_rows)), max(1, -(-q.count() // block_queries))
    part = lambda of: F.pmod(F.xxhash64("vec_id"), F.lit(of))
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
    r = r.withColumn("block", part(blocks)).withColumn("turn", each(turns))
    q = q.withColumn("turn", part(turns)).withColumn("block", each(blocks)).withColumnsRenamed({"vec_id": "query_id", "embedding": "query"})

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        x = np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)
        return x / np.sqrt((x * x).sum(axis=1))[:, None]

    def run(near: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if near.num_rows and asked.num_rows:
            ids, x, wanted = near.column("vec_id").to_numpy(), matrix(near.column("embedding")), matrix(asked.column("query"))
            for query_id, own in zip(asked.column("query_id").to_pylist(), wanted):
                distance = np.where(ids == query_id, np.inf, 1.0 - x @ own)
                best = np.flatnonzero(distance <= np.partition(distance, min(k, len(distance)) - 1)[min(k, len(distance)) - 1])
                best = best[np.lexsort((ids[best], distance[best]))][:k]
                out += ((query_id, int(ids[b]), float(distance[b])) for b in best if np.isfinite(distance[b]))
        return pa.table(dict(zip(("query_id", "vec_id", "distance"), map(pa.array, zip(*out), (pa.int64(), pa.int64(), pa.float64()))))) if out else EMPTY

    found = r.groupBy("block", "turn").cogroup(q.groupBy("block", "turn")).applyInArrow(run, "query_id long, vec_id long, distance double")
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


EMPTY = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})


def sessions(chats: DataFrame, limit: int | None = None) -> DataFrame:
    """Each session's first question, turns and questions; the newest ones first if there is a limit."""
    g = chats.groupBy("session_id").agg(
        F.min_by("content", F.when(F.col("role") == "user", F.col("turn_index"))).alias("first_question"), F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("questions"), F.min("turn_index").alias("first_turn")
    )
    return g.orderBy(F.desc("session_id")).limit(limit) if limit else g
