"""SimHash near-dedup over a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most ``radius`` bits
share at least ``8 - radius`` of them, the guaranteed minimum of matches. Lists of single bytes would hold
a 256th of all fingerprints each, so the index keeps lists of byte groups: the eight positions fall into
``groups`` groups of which any pair in reach shares ``groups - radius``, and each choice of so many groups
has a list. Pairs that meet in a list tally their shared positional bytes, those that reach the minimum are
verified bit by bit, and links are joined into components.

Only distinct fingerprints enter the index, so copies never make pairs. A list longer than ``list_cap`` is
not expanded into pairs: its fingerprints are linked through midpoints instead, which is exact as well and
linear. (Two fingerprints within an even radius have a value within half of it of both; each fingerprint
names all such values, and those that name the same one form a star.) Spark takes what an explode makes for
hardly larger than what it was made from, and for copies goes by files that are packed well; so postings, pairs,
midpoints and the rows of fingerprints are always joined by shuffles, never through a broadcast. Components are found by alternating
large and small stars on (document id, document id) links; nothing of them reaches the driver but a count
and a checksum a round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, map_batches, materialize, text_or_empty

SEED = 42


def fingerprint(text: str, shingle: int) -> int:
    """A bit is 1 if set in over half of the hashes of the text's word shingles, repeats included."""
    words = text.encode().translate(ASCII_LOWER).split()
    if len(words) > shingle:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    else:
        shingles = [b" ".join(words)] if words else []
    hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, the fingerprint as a signed long, and the long columns in carry. A text without words has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            prints = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield {"doc_id": batch.column(0), "fp": prints.view(np.int64)} | {c: batch.column(2 + k) for k, c in enumerate(carry)}

    schema = "doc_id long, fp long" + "".join(f", {c} long" for c in carry)
    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), *carry), run, schema)


def byte_groups(radius: int) -> list[list[int]]:
    """The eight byte positions in groups, so that a pair in reach shares two of them (three beyond radius 2)."""
    count = min(8, radius + (2 if radius <= 2 else 3))
    out: list[list[int]] = [[] for _ in range(count)]
    for k in range(8):
        out[k * count // 8].append(k)
    return out


def positional_keys(fp: Column, radius: int) -> Column:
    """The lists that a fingerprint stands in: (choice of groups, their bytes)."""
    groups = byte_groups(radius)
    keys = []
    for n, chosen in enumerate(combinations(range(len(groups)), len(groups) - radius)):
        mask = sum(0xFF << (8 * k) for g in chosen for k in groups[g])
        keys.append(F.struct(F.lit(n).alias("choice"), fp.bitwiseAND(F.lit(mask - 2**64 if mask >= 2**63 else mask)).alias("bytes")))
    return F.array(*keys)


def shared_bytes(x: Column) -> Column:
    """How many positional bytes two fingerprints share, by their exclusive or."""
    tally = F.lit(0)
    for k in range(8):
        tally = tally + F.when(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0)
    return tally


def fingerprint_links(nodes: DataFrame, radius: int, list_cap: int = 256) -> DataFrame:
    """Links (a, b) that connect the nodes (fp, node) as all pairs within radius bits would."""
    if radius % 2:
        raise ValueError("the radius has to be even")
    postings = nodes.select("fp", "node", F.inline(positional_keys(F.col("fp"), radius)))
    lists = postings.groupBy("choice", "bytes").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialize(postings.join(lists.hint("merge"), ["choice", "bytes"]), "met")
    short = met.filter(F.col("n") <= list_cap)
    other = short.select("choice", "bytes", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    pairs = short.join(other.hint("merge"), ["choice", "bytes"]).filter(F.col("fp") < F.col("fp2"))
    pairs = pairs.filter(shared_bytes(x) >= 8 - radius).filter(F.bit_count(x) <= radius).select(F.col("node").alias("a"), F.col("node2").alias("b"))
    long_ = met.filter(F.col("n") > list_cap).select("fp", "node").distinct()
    near = [0, *(1 << k for k in range(64))]
    for _ in range(radius // 2 - 1):
        near = sorted({m ^ (1 << k) for m in near for k in range(64)} | set(near))
    flips = F.expr("array(" + ",".join(f"{m - 2**64 if m >= 2**63 else m}L".replace("-9223372036854775808L", "(-9223372036854775807L - 1L)") for m in near) + ")")
    named = long_.select("node", F.explode(flips).alias("flip"), "fp").select("node", F.col("fp").bitwiseXOR(F.col("flip")).alias("midpoint"))
    centres = named.groupBy("midpoint").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    stars = named.join(centres.hint("merge"), "midpoint").filter("node > centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    return pairs.unionByName(stars).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable."""
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("sum")).first()
        if state == seen or not state.n:
            break
        seen = state
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(lowest.select("hi", "m"))
        edges = materialize(small.distinct(), "stars")
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def components(prints: DataFrame, radius: int, list_cap: int) -> DataFrame:
    """(fp, component) of every distinct fingerprint of prints; component is a fingerprint of the group."""
    nodes = materialize(prints.select("fp", F.col("fp").alias("node")).distinct(), "nodes")
    roots = connected_components(fingerprint_links(nodes, radius, list_cap))
    return materialize(nodes.join(roots.hint("merge"), "node", "left").select("fp", F.coalesce("root", "node").alias("component")), "components")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, list_cap: int = 256) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document.

    component_id is the smallest doc_id that links reach; a document without links has its own, or the
    smallest of those with the same fingerprint. Texts without words share fingerprint zero and are linked
    like any other. A null doc_id comes last: it is a component_id of null only among its like. Repeated
    rows are linked as they share a fingerprint. Other columns play no part.
    """
    prints = materialize(fingerprints(docs, shingle), "prints")
    named = components(prints, radius, list_cap)
    # what each fingerprint has first, then each component: a group however large is combined before it moves
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(named.hint("merge"), "fp")
    of_print = firsts.join(firsts.groupBy("component").agg(F.min("first").alias("component_id")).hint("merge"), "component").select("fp", "component_id")
    return prints.join(of_print.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def surplus(docs: DataFrame, key: str, shingle: int = 3, radius: int = 2, list_cap: int = 256) -> DataFrame:
    """(doc_id, key, first) of the rows beside the first of their group of near duplicates, and of first rows that repeat.

    The first has the smallest doc_id, then the smallest key, a long column; null ids come last. Groups are
    those of fingerprints, so ids may repeat or be null. Rows equal in id and key are not told apart: where
    the first is one of several such rows it is returned too, with first true.
    """
    prints = materialize(fingerprints(docs, shingle, (key,)).groupBy("doc_id", key, "fp").agg(F.count("*").alias("n")), "prints")
    named = components(prints, radius, list_cap)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col(key))
    firsts = prints.groupBy("fp").agg(F.min(rank).alias("least")).join(named.hint("merge"), "fp")
    of_print = firsts.join(firsts.groupBy("component").agg(F.min("least").alias("best")).hint("merge"), "component").select("fp", "best")
    out = prints.join(of_print.hint("merge"), "fp").withColumn("first", rank == F.col("best"))
    return out.filter(~F.col("first") | (F.col("n") > 1)).select("doc_id", key, "first")
