"""Range joins of addresses: ranges cut at common prefixes, so that what encloses an address is found by equal keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of an address that stay as key: a range is cut into aligned blocks of these sizes, at most 510 of each but the first.
LEVELS = (8, 16, 24, 32)


def address(ip: Column) -> Column:
    """A dotted address as a long, null for what isn't one."""
    parts = F.split(ip, r"\.")
    number = sum((F.element_at(parts, k + 1).try_cast("long") * F.lit(1 << 8 * (3 - k)) for k in range(4)), F.lit(0).cast("long"))
    valid = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$")
    return F.when(valid, number)


def at_level(level: int) -> Callable[[Column], Column]:
    return lambda block: F.struct(F.lit(level).alias("level"), block.alias("block"))


def blocks(ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """The ranges with level and block: aligned blocks that cover each range, ends included, exactly once.

    From the coarsest level on, each level takes the whole blocks inside the range that the coarser ones have left. Ranges
    without an end, or whose end lies before their start, cover nothing.
    """
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<long>"))
    found, coarser = [], None
    for level in LEVELS:
        size = F.lit(1 << 32 - level).cast("long")
        first, last = F.ceil(F.col(start) / size).cast("long"), F.floor((F.col(end) + 1) / size).cast("long")  # blocks from first up to before last
        mine = run(first, last)
        if coarser:  # what it holds, the levels before it hold as well
            a, b = (x * (1 << level - coarser[0]) for x in coarser[1:])
            mine = F.when(a < b, F.concat(run(first, a), run(b, last))).otherwise(mine)
        found.append(F.transform(mine, at_level(level)))
        coarser = level, first, last
    inside = (F.col(start) <= F.col(end)) & (F.col(start) >= 0) & (F.col(end) < 1 << 32)
    return ranges.filter(inside).withColumn("_b", F.explode(F.concat(*found))).select(*ranges.columns, F.col("_b.level").alias("level"), F.col("_b.block").alias("block"))


def covers(ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """The ranges with level and block: at most two rows each, the blocks that a range touches at its level.

    A level is the bits of a block's size, the least that a range's length doesn't pass, so a block holds more than a range only
    within a few of its lengths: who looks a number up still has to compare it with both ends. The same ranges as in ``blocks`` cover nothing.
    """
    n = F.col(end).cast("long") - F.col(start)
    inside = (F.col(start) <= F.col(end)) & (F.col(start) >= 0) & (F.col(end) < 1 << 32)
    leveled = ranges.filter(inside).withColumn("level", F.when(n == 0, 0).otherwise(F.length(F.bin(n))))
    touched = F.expr(f"sequence(shiftright(cast(`{start}` AS long), level), shiftright(cast(`{end}` AS long), level))")
    return leveled.withColumn("block", F.explode(touched)).select(*ranges.columns, "level", "block")


def enclosing(rows: DataFrame, number: Column, ranges: DataFrame, value: str, start: str = "start", end: str = "end") -> DataFrame:
    """Rows with the value of the smallest range that holds their number (ties: least start, then value), null if none does.

    Distinct numbers look their blocks up, one key for each level that some range has (33 at most); what they found is joined to the rows. Ranges may be
    nested and overlap; equal ones are one. Both sides of the lookup are shuffled: Spark takes ranges with their blocks for as small as the
    table they come from, and would broadcast millions. A hot block is split by Spark's handling of skew.
    """
    keyed = rows.withColumn("_number", number)
    named = ranges.select(F.col(start).cast("long").alias("_start"), F.col(end).cast("long").alias("_end"), F.col(value).alias("_value"))
    covered = covers(named.groupBy("_start", "_end").agg(F.min("_value").alias("_value")), "_start", "_end")
    levels = covered.agg(F.collect_set("level").alias("_levels"))  # one row
    keys = F.expr("transform(_levels, s -> struct(s AS level, shiftright(_number, s) AS block))")
    asked = keyed.select(F.col("_number").cast("long").alias("_number")).filter("_number IS NOT NULL").distinct().crossJoin(F.broadcast(levels)).select("_number", F.inline(keys))
    found = asked.join(covered.hint("merge"), ["level", "block"]).filter("_number BETWEEN _start AND _end")
    best = found.groupBy("_number").agg(F.min_by("_value", F.struct(F.col("_end") - F.col("_start"), "_start", "_value")).alias(value))
    return keyed.join(best, "_number", "left").drop("_number")
