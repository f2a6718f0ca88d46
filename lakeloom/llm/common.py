"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words in every operator here: \x20 and \x09-\x0D.
#: ``bytes.split()`` without arguments splits at exactly these.
SPACES = " \t\n\x0b\x0c\r"

#: Fixed value: the white space of Unicode, inside the brackets of a pattern.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Lower-cases A-Z in UTF-8 bytes and leaves all else.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent (a local session, as in tests), a temporary folder is set as the
    checkpoint folder once; on a cluster the setting has to be there.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("lakeloom.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("lakeloom.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage ends in replicated files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lakeloom-{uuid.uuid4().hex}-{tag}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives memory that Arrow and the C library hold back to the machine: a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's
    if trim:
        trim(0)


def tidied(f: Callable) -> Callable:
    """f, for one or two groups in Arrow, with memory released behind it."""

    def run(*tables: pa.Table) -> pa.Table:
        try:
            return f(*tables)
        finally:
            release()

    # Spark counts the arguments
    return (lambda one: run(one)) if len(inspect.signature(f).parameters) == 1 else (lambda one, other: run(one, other))


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow, with f giving one dict of columns for each batch it wants to return."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        for columns in f(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], type=x.type) for x in out], schema=out)
        release()

    return df.mapInArrow(run, kind)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*columns: str) -> Column:
    """A hash of a row's columns, nulls included: rows of one id that differ in them have different keys."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c).isNull(), F.col(c))))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
