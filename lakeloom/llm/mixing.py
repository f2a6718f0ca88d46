"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time, a straight line from its first to its last weight.
Its integral is the source's share of all words; shares that would repeat a source more often than
``max_epochs`` stop there, and the excess is shared out anew by weight. A source's documents stand in a
fixed random order, repeated as often as its target asks; inverting the source's cumulative demand at a
document's token offset gives the training position of that copy, and copies are range-sorted by it.

Hot source: the offset comes from sums over buckets of the random order (``MAX_BUCKETS`` a source at most)
and a window inside each bucket, so no task sees a whole source. Text is read once for its size; what is
shuffled after that is a few numbers a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_key, text_or_empty

WEIGHTS = (5, 2, 1)
#: Of each weight in turn: by how much of its mean the weight changes from the middle to the end.
SLOPES = (-0.5, 0.0, 0.5)
MAX_EPOCHS = 3
MAX_BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def order_key(doc_id: Column) -> Column:
    """60 bits of the id's MD5: the fixed random order of documents."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, rank, source_size, slope and target for rows of (source, source_size, n): one row a source.

    Targets share the sum of all sizes by weight; none passes max_epochs times its source's size. Sources
    in order of their cap to weight: those before the first whose share at the common level fits are capped.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1).cast("int")
    ranked = sizes.withColumn("rank", turn)
    pick = lambda values: F.element_at(F.array(*(F.lit(float(x)) for x in values)), (F.col("rank") % len(values) + 1).cast("int"))
    ranked = ranked.withColumn("weight", pick(weights)).withColumn("slope", pick(slopes)).withColumn("cap", max_epochs * F.col("source_size").cast("double"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    earlier, whole = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0.0))
    level = (F.sum(F.col("source_size").cast("double")).over(whole) - before("cap")) / (F.sum("weight").over(whole) - before("weight"))
    ranked = ranked.withColumn("level", level).withColumn("fill", F.row_number().over(by_fill))
    fits = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("fill", "level"))
    common = F.min(fits).over(whole)["level"]
    return ranked.withColumn("common", common).select("source", "rank", "source_size", "n", "slope", F.least("cap", F.col("common") * F.col("weight")).alias("target"))


def invert_demand(share: Column, slope: Column) -> Column:
    """The time x in [0, 1] at which x + slope * (x * x - x), the integral of the schedule, reaches share."""
    a = F.lit(1.0) - slope
    return 2.0 * share / (a + F.sqrt(a * a + 4.0 * slope * share))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, max_epochs: int = MAX_EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, copies, positions (ascending).

    A source is taken in whole epochs, then as far as whole documents fit its target; of those left the one
    whose size comes nearest to the words still missing fills the gap, if that brings the source nearer. A null text has no words and is never taken; null sources form a source of
    their own, the last. Repeated rows are documents of their own. The columns
    in carry are handed on and settle the order of rows of one id and size; others play no part.
    """
    sized = materialize(
        docs.select(
            F.col("doc_id").cast("long"), F.col("source").cast("string"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), order_key(F.col("doc_id")).alias("h"), *carry
        ),
        "sizes",
    )
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, slopes, max_epochs)
    sources = materialize(sources, "sources")
    s = sources.withColumnRenamed("source", "s")
    buckets = F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("n") / 32))
    known = sized.join(s, sized.source.eqNullSafe(s.s)).withColumn("bucket", F.floor(F.col("h") / F.lit(float(2**60)) * buckets))
    known = known.select("doc_id", "size", "h", "rank", "bucket", "source_size", "slope", "target", *carry)
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = known.groupBy("rank", "bucket").agg(F.sum("size").alias("words")).select("rank", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rank", "bucket").orderBy("h", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, 0)
    placed = known.join(bases, ["rank", "bucket"]).withColumn("end", F.col("base") + F.sum("size").over(inside))
    # whole epochs of the source, and the words of the one after them
    placed = placed.withColumn("epochs", F.coalesce(F.least(F.lit(max_epochs), F.floor(F.try_divide(F.col("target"), F.col("source_size")))), F.lit(0)).cast("int"))
    placed = placed.withColumn("part", F.col("target") - F.col("epochs") * F.col("source_size"))
    placed = materialize(placed.select("doc_id", "size", "rank", "source_size", "slope", "target", "end", "epochs", "part", *carry), "placed")
    # the last gap goes to the document left that fits it best
    reached = placed.groupBy("rank").agg(F.coalesce(F.max(F.when(F.col("end") <= F.col("part"), F.col("end"))), F.lit(0)).alias("reached"))
    placed = placed.join(materialize(reached, "reached"), "rank")
    gap = F.col("part") - F.col("reached")
    off = F.abs(F.col("size") - gap)
    last = placed.filter((F.col("end") > F.col("part")) & (F.col("size") > 0) & (off < gap)).groupBy("rank").agg(F.min(F.struct(off.alias("off"), F.col("end"))).getField("end").alias("filler"))
    placed = placed.join(materialize(last, "fillers"), "rank", "left")
    middle = F.col("end") - F.col("size") / 2
    when_at = lambda taken, words: F.when((F.col("size") > 0) & taken, invert_demand(F.least(F.lit(1.0), words / F.col("target")), F.col("slope")))
    copies = [when_at(F.col("epochs") > k, middle + k * F.col("source_size")) for k in range(max_epochs)]
    copies.append(when_at(F.col("end") <= F.col("part"), middle + F.col("epochs") * F.col("source_size")))
    copies.append(when_at(F.col("end") == F.col("filler"), F.col("reached") + F.col("size") / 2 + F.col("epochs") * F.col("source_size")))
    return placed.withColumn("positions", F.array_compact(F.array(*copies))).select(
        "doc_id", "size", "source_size", "target", (F.size("positions") * F.col("size")).alias("taken"), F.size("positions").alias("copies"), "positions", *carry
    )


def mix(docs: DataFrame, **params: object) -> DataFrame:
    """docs in training order, each as often as the mix takes it, with its ``position`` in [0, 1].

    A document is found again by two hashes of its whole row, so ids may repeat or be null, and rows that are equal in
    all columns each have their place in the plan. A column of docs named position is replaced. Map columns aren't
    hashed.
    """
    plain = sorted(c for c, kind in docs.dtypes if "map<" not in kind)
    keyed = docs.withColumns({"_key": row_key(*plain), "_key2": F.xxhash64(row_key(*plain), *reversed(plain), F.lit(2))})
    plan = materialize(plan_mix(keyed, **params, carry=("_key", "_key2")).select("_key", "_key2", F.explode("positions").alias("_position")), "plan")
    # dropDuplicates has dealt the texts by these keys, so the plan, of up to a row a document and epoch, need not be broadcast
    both = keyed.dropDuplicates(["_key", "_key2"]).join(plan.hint("merge"), ["_key", "_key2"])
    ordered = both.orderBy("_position", "doc_id", "_key").drop("_key", "_key2")
    return ordered.select(*(c for c in docs.columns if c != "position"), F.col("_position").alias("position"))
