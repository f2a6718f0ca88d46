"""Cleans and mixes the corpus: each stage is one of the operators of lakeloom.llm."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import bpe, mixing, quality, simhash, substrings
from lakeloom.llm.common import materialize, row_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of two numbers that may be broadcast: some 15 MB.
HELD_ROWS = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs.select(*COLUMNS))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles), that of the smallest id.

    Rows of one id, or of none, are documents of their own: what tells them apart is a hash of the row. Of
    rows that are equal in all columns one stays. What goes out is written first, a few numbers a row, and
    counted: texts move only if it is too large for a broadcast, by its rows, as files hold a row in a tenth of its size.
    """
    docs = docs.select(*COLUMNS).withColumn("row_key", row_key(*COLUMNS[1:]))
    out = simhash.surplus(docs, "row_key", shingle=5, radius=4).withColumnsRenamed({"doc_id": "out_id", "row_key": "out_key"})
    out = materialize(out, "surplus")
    if out.count() > HELD_ROWS:
        out = out.hint("merge")
    same = docs.doc_id.eqNullSafe(out.out_id) & (docs.row_key == out.out_key)
    kept = docs.join(out, same, "left_anti")
    repeated = docs.join(out.filter("first"), same, "left_semi").dropDuplicates(["doc_id", "row_key"])
    return kept.unionByName(repeated).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that also stand earlier; n_chars is counted anew."""
    cut = substrings.remove_repeats(docs.select(*COLUMNS), texts=True, carry=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes them, in training order."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def training_order(docs: DataFrame) -> Column:
    """The place of each row in the order that docs was written in: by part of the table, file of the part and row."""
    try:
        row, name = F.col("_metadata.row_index"), F.col("_metadata.file_name")
        docs.select(row)
    except AnalysisException:  # not read from files: the order of the rows as they are
        return F.monotonically_increasing_id()
    number = lambda pattern: F.coalesce(F.try_to_number(F.regexp_extract(name, pattern, 1), F.lit("9999999999")).cast("long"), F.lit(0).cast("long"))
    return F.shiftleft(number(r"part-(\d+)"), 44) + F.shiftleft(number(r"-c(\d+)"), 34) + row


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, ready for training, with ``position``: ascending, it is the order of the curriculum."""
    docs = docs.withColumn("position", training_order(docs))
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), carry=("position",))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: No SQL expresses the histogram fit, the fingerprints and the merges; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
