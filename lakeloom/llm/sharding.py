"""Sharding by sampled splitters.

Records get a key (a hash of the text, then the id), so that equal texts are neighbours. A size-weighted
sample of the keys gives quantile boundaries; records are range-partitioned by them, and a range that turns
out overfull draws a denser sample of its own and is cut again, all such ranges in one job. Inside its range each record then knows how
many bytes stand before it in key order, and the shard is cut from that: shards differ by one record's
bytes at most, whatever the sample was, so reruns agree.

Hot text: its copies differ in id, so boundaries fall among them like anywhere else; rows that are equal in text
and id are one record with a count until their slots are dealt out, in blocks. The text is read once; what is shuffled and sorted after that is a few numbers a record. The driver sees totals, splitters
(``max_ranges`` at most) and one row a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_key, text_or_empty

LOWEST = -(2**63)


def text_key(text: Column) -> Column:
    """The first 60 bits of the text's MD5, as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sample_splitters(ranged: DataFrame, rows: int, total: int, parts: int, per_part: int) -> list[tuple[int, int]]:
    """Quantile boundaries inside each overfull range of ranged (key, id, size, r), of all of them in one job.

    A range is overfull with over twice its share of the records or of the bytes; it asks for twice as many pieces as it
    has shares, ``parts`` at most. A record weighs its size and the mean size of its range, so that many light records
    beside a giant are drawn too. It enters the sample with a probability in proportion to its weight (surely,
    if that passes 1), by a hash and so alike in each run; ``per_part`` records a piece are expected. Behind a record
    of several pieces' weight there is a boundary as well as before it.
    """
    sizes = ranged.groupBy("r").agg(F.sum("size").alias("bytes"), F.count("*").alias("keys"))
    over = F.greatest(F.col("keys") * parts / max(rows, 1), F.col("bytes") * parts / max(total, 1))
    full = sizes.filter("keys > 1").withColumn("over", over).filter("over > 2").select("r", "bytes", (F.col("bytes") / F.col("keys")).alias("mean"), F.least(F.lit(parts), F.ceil(2 * F.col("over"))).alias("pieces"))
    weight = F.col("size") + F.col("mean")
    rate = F.least(F.lit(1.0), weight * F.col("pieces") * F.lit(float(per_part)) / (2 * F.col("bytes")))
    draw = F.pmod(F.xxhash64("key", "id"), F.lit(2**52)) / F.lit(float(2**52))
    sample = ranged.join(F.broadcast(full), "r").withColumn("rate", rate).filter(draw < F.col("rate")).withColumn("w", weight / F.col("rate"))  # a row a range
    whole = Window.partitionBy("r")
    order = whole.orderBy("key", "id")
    reached = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))
    quantile = lambda x: F.least(F.col("pieces") - 1, F.floor(x * F.col("pieces") / F.sum("w").over(whole)))
    passed = sample.withColumn("passed", quantile(reached) - quantile(reached - F.col("w")))
    cut = passed.withColumn("cut", (F.col("passed") > 0) | (F.lag("passed", 1, 0).over(order) > 1)).filter("cut")
    return [(x.key, x.id) for x in cut.select("key", "id").distinct().collect()]


def range_of(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters lie at or under (key, id), found over two levels of about equal width."""
    if not splitters:
        return F.lit(0)
    width = max(1, round(len(splitters) ** 0.5))
    me = F.struct(F.col("key"), F.col("id"))

    def array(part: list[tuple[int, int]]) -> Column:
        return F.expr("array(" + ",".join(f"named_struct('key',{k}L,'id',{f'{d}L' if d > LOWEST else f'({d + 1}L - 1L)'})" for k, d in part) + ")")

    coarse = F.size(F.filter(array(splitters[::width]), lambda x: x <= me))
    first = F.greatest(coarse - 1, F.lit(0)) * width
    return F.when(coarse == 0, 0).otherwise(first + F.size(F.filter(F.slice(array(splitters), first + 1, F.lit(width)), lambda x: x <= me)))


def cut_ranges(keys: DataFrame, rows: int, total: int, *, min_ranges: int, rows_per_range: int, max_ranges: int, per_part: int) -> tuple[DataFrame, DataFrame]:
    """keys with their range ``r``, and (r, bytes_before, rows_before) for each range.

    At first all keys are one range. Overfull ranges are cut again, all in one pass over the keys, as long as that gives
    new boundaries: what they end with are single keys. Where they fall changes how even the work is, not the result.
    """
    parts = min(max_ranges, max(min_ranges, -(-rows // rows_per_range)))
    splitters: list[tuple[int, int]] = []
    while parts > 1:
        more = set(sample_splitters(keys.withColumn("r", range_of(splitters)), rows, total, parts, per_part))
        if len(splitters) + len(more) > 2 * max_ranges or not more - set(splitters):
            break
        splitters = sorted({*splitters, *more})
    ranged = keys.withColumn("r", range_of(splitters))
    earlier = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("r").agg(F.sum("size").alias("bytes"), F.sum("n").alias("n")).select(
        "r",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
    )
    return ranged, bases


#: Equal rows whose slots one task deals out at once.
BLOCK = 100_000


def assign_shards(docs: DataFrame, shards: int = 40, *, overhead: int = 16, rows_per_range: int = 2_000_000, max_ranges: int = 8192, per_part: int = 64, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot and grown_shard (null) of each record.

    A null text has no bytes and the CRC of an empty one; a null doc_id sorts first. Repeated rows each get
    a slot of their own. With fewer records than shards some shards stay empty; an empty table gives no
    rows. The long columns in carry are handed on, other columns play no part.
    """
    text = text_or_empty()
    one = [F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("each"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key(text).alias("key"), *carry]
    names = ["doc_id", "each", "text_crc32", "key", *carry]
    keys = docs.select(*one).groupBy(*names).agg(F.count("*").alias("n"))
    keys = materialize(keys.withColumns({"id": F.coalesce("doc_id", F.lit(LOWEST)), "size": F.col("each") * F.col("n")}), "keys")
    all_ = keys.agg(F.count("*").alias("keys"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    ranged, bases = cut_ranges(keys, all_["keys"], all_.bytes, min_ranges=2 * shards, rows_per_range=rows_per_range, max_ranges=max_ranges, per_part=per_part)
    inside = Window.partitionBy("r").orderBy("key", "id", "each", "text_crc32", *carry).rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("bytes_before") + F.sum("size").over(inside) - F.col("size")
    first = F.col("rows_before") + F.sum("n").over(inside) - F.col("n")
    placed = ranged.join(F.broadcast(bases), "r").withColumns({"before": before, "first": first})  # a row a range, max_ranges and their cuts at most
    # a record of many equal rows is dealt out in blocks, and each block into its rows
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK)))
    dealt = placed.withColumn("block", blocks)
    copies = F.explode(F.sequence(F.col("block") * BLOCK, F.least(F.col("n"), (F.col("block") + 1) * BLOCK) - 1))
    dealt = dealt.withColumn("copy", copies)
    at = F.col("before") + F.col("copy") * F.col("each")
    placed = materialize(
        dealt.withColumn("shard", F.least(F.lit(shards - 1), F.floor((2 * at + F.col("each")) * shards / F.lit(2 * max(all_.bytes, 1)))).cast("int"))
        .select("doc_id", F.col("each").alias("size"), "text_crc32", "shard", (F.col("first") + F.col("copy")).alias("at"), *carry),
        "placed",
    )
    starts = placed.groupBy("shard").agg(F.min("at").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(  # a row a shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *carry
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, **params: int) -> None:
    """Writes docs as Parquet under path, one folder a shard, its records in slot order.

    A record is found again by two hashes of its whole row, so ids may repeat or be null; rows that are equal in all
    columns are written as often as they come. Columns of docs named shard or slot are written as shard_ and slot_. A
    shard is written by as many tasks as its slots fill, so that no task holds a whole shard. Map columns aren't
    hashed.
    """
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]
    keyed = docs.withColumns({"_key": row_key(*plain), "_key2": F.xxhash64(row_key(*plain), *reversed(plain), F.lit(2))})
    placed = assign_shards(keyed, shards, carry=("_key", "_key2"), **params).select("_key", "_key2", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    out = keyed.dropDuplicates(["_key", "_key2"]).join(placed, ["_key", "_key2"]).drop("_key", "_key2")
    out = out.withColumnsRenamed({c: f"{c}_" for c in ("shard", "slot") if c in docs.columns}).withColumnsRenamed({"_shard": "shard", "_slot": "slot"})
    piece = F.floor(F.col("slot") / BLOCK)
    out.repartition("shard", piece).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
