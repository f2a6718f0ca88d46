"""Compaction as planned work: small files are packed into bins of about one target size, each bin written by one task.

Files of a target's size or more are never read. No row is shuffled: a bin's files are read by the job that writes its one
file, several bins at a time.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = 128 << 20
PLAN = "folder string, bin int, files array<string>, bytes long"


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """folder, file and length of a data set's files, from the file system's listing; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return found.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.col("path").alias("file"), "length")


def packed(sizes: list[int], target: int) -> list[list[int]]:
    """Numbers of the files in each bin: largest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    left: list[tuple[int, int]] = []  # what bins can still take, ascending
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = bisect_left(left, (sizes[k], -1))
        if at < len(left):
            room, n = left.pop(at)
        else:
            room, n = target, len(bins)
            bins.append([])
        bins[n].append(k)
        insort(left, (room - sizes[k], n))
    return bins


def plan(spark: SparkSession, path: str, target: int = TARGET, small: float = 0.9) -> DataFrame:
    """The bins of files to be written together: those under small * target, by folder, in bins of two and more.

    A folder's listing is packed by one task; folders (partitions of the table) are packed in many.
    """

    def pack(files: pd.DataFrame) -> pd.DataFrame:
        files = files.sort_values(["length", "file"], ascending=[False, True])
        bins = [b for b in packed(files["length"].tolist(), target) if len(b) > 1]
        named = [sorted(files["file"].iloc[k] for k in b) for b in bins]
        return pd.DataFrame({"folder": files["folder"].iloc[0], "bin": range(len(bins)), "files": named, "bytes": [int(files["length"].iloc[b].sum()) for b in bins]})

    return file_sizes(spark, path).filter(F.col("length") < small * target).groupBy("folder").applyInPandas(pack, PLAN)


def compact(spark: SparkSession, path: str, target: int = TARGET, at_once: int = 8) -> int:
    """Carries the plan out in place; gives the number of files that were put into others.

    A bin's new file is written apart, moved beside the old ones, and these are removed then: a run that breaks off leaves a
    bin either as it was or, in the moment between, twice; nothing is lost, and staged files lie outside of the table. Rows of
    a file stay together and in order. Tables should not be read or written meanwhile.
    """
    staged = f"{path.rstrip('/')}-compaction-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def rewrite(job: tuple[int, str, list[str]]) -> int:
        n, folder, files = job
        out = f"{staged}/{n}"
        spark.read.parquet(*files).coalesce(1).write.parquet(out)
        for f in fs.listStatus(hadoop.Path(out)):
            if f.getPath().getName().endswith(".parquet"):
                fs.rename(f.getPath(), hadoop.Path(f"{folder}/compacted-{uuid.uuid4().hex}.parquet"))
        for f in files:
            fs.delete(hadoop.Path(f), False)
        return len(files)

    jobs = ((n, r.folder, list(r.files)) for n, r in enumerate(plan(spark, path, target).toLocalIterator()))
    with ThreadPoolExecutor(at_once) as pool:
        done = sum(pool.map(rewrite, jobs))
    fs.delete(hadoop.Path(staged), True)
    return done
