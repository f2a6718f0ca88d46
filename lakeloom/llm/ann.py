"""Nearest neighbours by inner product over a multi-index of learned binary codes.

A rotation is learned on a bounded sample (alternating between signs of the rotated vectors and the
rotation that fits them best) and turns each vector into a binary code. Codes are split into substrings of
16 bits, each with inverted lists by value. By the pigeonhole principle a code within Hamming radius r of a
query's has a substring within t of the query's, for any bounds t of the substrings that sum to
``r - substrings + 1``; probing the lists of all values so near retrieves every code within the radius. What is
retrieved is held to the radius, and its float vectors are reranked by the exact inner product. No other row
is touched.

The radius is the smallest that holds ``recall`` of the true neighbours, among all rows, of a bounded sample of
queries; those are found by one pass over all rows. Where fewer than ``k`` codes of a block lie within it, the
radius widens step by step. Rows are dealt into blocks of about ``block_rows`` by a hash; each block is
indexed where it lies, and all queries visit it, in blocks of about ``block_queries``, so a task holds one block of
each however many there are; each sends its best ``k`` on, which are merged by query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, tidied

#: All values of a substring, nearest to zero first, and how many of them have up to so many bits.
WIDTH = 16
MASKS = np.argsort(np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint32)), kind="stable").astype(np.int64)
WITHIN = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint32)), minlength=WIDTH + 1))


@dataclass(frozen=True)
class AnnParams:
    k: int = 20
    #: Rows that the rotation is learned on, and queries that the radius is learned on, at most about.
    sample_rows: int = 4096
    sample_queries: int = 256
    #: Share of the true neighbours of the sampled queries that the radius has to hold.
    recall: float = 0.94
    rounds: int = 30
    block_rows: int = 16384
    block_queries: int = 32768


@dataclass(frozen=True)
class Codes:
    """A fitted code: its mean and its rotation (one bit a column)."""

    mean: np.ndarray
    rotation: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        """A row of 16-bit substrings for each vector."""
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1).view(">u2").astype(np.uint16)


def sign_rotation(x: np.ndarray, rounds: int, seed: int = 7) -> np.ndarray:
    """The orthogonal rotation under which x loses least by keeping signs only."""
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(x.T @ np.where(x @ r > 0, 1.0, -1.0))
        r = u @ vt
    return r


def hamming(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ query).sum(axis=-1, dtype=np.int64)


def fit(sample: np.ndarray, rounds: int) -> Codes:
    """Learns the rotation; bits that a whole substring lacks repeat earlier ones."""
    mean, d = sample.mean(axis=0), sample.shape[1]
    rotation = sign_rotation(sample - mean, rounds)
    return Codes(mean, rotation[:, np.arange(-(-d // WIDTH) * WIDTH) % d])


def substring_bounds(radius: int, substrings: int) -> list[int]:
    """How far each substring has to be probed so that no code within the radius is missed; -1: not at all."""
    total = radius - substrings + 1
    return [min(WIDTH, total // substrings + (s < total % substrings)) for s in range(substrings)]


class MultiIndex:
    """Inverted lists of one block of codes by the value of each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.lists = []
        for s in range(codes.shape[1]):
            order = np.argsort(codes[:, s], kind="stable")
            values, first = np.unique(codes[order, s], return_index=True)
            self.lists.append((order, values.astype(np.int64), np.append(first, len(order))))

    def probe(self, s: int, value: int, bound: int) -> np.ndarray:
        """Rows in the lists of substring s whose value differs from this one in up to so many bits."""
        order, values, start = self.lists[s]
        if bound < 0:
            return order[:0]
        if WITHIN[bound] < len(values):  # look the values up one by one, else go through those there are
            near = np.sort(MASKS[: WITHIN[bound]] ^ value)
            at = np.searchsorted(values, near)
            at = at[at < len(values)][values[at[at < len(values)]] == near[at < len(values)]]
        else:
            at = np.flatnonzero(np.bitwise_count(values ^ value) <= bound)
        begin, size = start[at], start[at + 1] - start[at]
        return order[np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())] if len(at) else order[:0]

    def within(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, int]:
        """Rows whose code lies within the radius, ascending, and how many rows were probed for it."""
        hit = np.zeros(len(self.codes), dtype=bool)
        for s, bound in enumerate(substring_bounds(radius, self.codes.shape[1])):
            hit[self.probe(s, int(query[s]), bound)] = True
        probed = np.flatnonzero(hit)
        return probed[hamming(self.codes[probed], query) <= radius], len(probed)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return np.ascontiguousarray(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1), dtype=np.float64)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, of equal ones of the smaller ids."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))


def fit_radius(rows: DataFrame, codes: Codes, queries: np.ndarray, own: np.ndarray, params: AnnParams) -> int:
    """The radius that holds enough of the true neighbours of some queries; own: their ids, which are no candidates."""
    query_codes, k = codes.encode(queries), params.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                ids, x = batch.column(0).slice(at, 4096).to_numpy(), matrix(batch.column(1).slice(at, 4096))
                scores, coded = x @ queries.T, codes.encode(x)
                for q in range(len(queries)):
                    some = best_rows(np.where(ids == own[q], -np.inf, scores[:, q]), ids, k)
                    some = some[ids[some] != own[q]]
                    new = scores[some, q], ids[some], hamming(coded[some], query_codes[q])
                    both = [np.concatenate(x) for x in zip(held[q], new)]
                    keep = best_rows(both[0], both[1], k)
                    held[q] = tuple(x[keep] for x in both)
        for q, (score, ids, distance) in enumerate(held):
            if len(score):
                yield {"q": [q] * len(score), "score": score, "vec_id": ids, "distance": distance}

    near = map_batches(rows.select("vec_id", "embedding"), run, "q int, score double, vec_id long, distance int")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    counts = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).groupBy("distance").count().collect()  # a row a distance
    reach = np.bincount([r.distance for r in counts], weights=[r["count"] for r in counts], minlength=WIDTH * query_codes.shape[1] + 1)
    return int(np.argmax(np.cumsum(reach) >= params.recall * reach.sum()))


def search_block(codes: Codes, radius: int, params: AnnParams) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ("query_id", "query_no", "vec_id", "score", "n_probed", "n_reranked")

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            ids, vectors = rows.column("vec_id").to_numpy(), matrix(rows.column("embedding"))
            query_ids, numbers, wanted = queries.column("query_id").to_numpy(), queries.column("query_no").to_numpy(), matrix(queries.column("query"))
            index, query_codes = MultiIndex(codes.encode(vectors)), codes.encode(wanted)
            for n, q in enumerate(wanted):
                reach, probed = radius, 0
                while True:
                    found, more = index.within(query_codes[n], reach)
                    probed, found = max(probed, more), found[ids[found] != query_ids[n]]
                    if len(found) >= params.k or reach >= WIDTH * query_codes.shape[1]:
                        break
                    reach += 4
                near, reranked = vectors[found], len(found)
                rough = near @ q
                if len(found) > params.k:  # whatever ties with the last of them, up to rounding, stays
                    keep = rough >= np.partition(rough, len(rough) - params.k)[len(rough) - params.k] - 1e-9 * max(1.0, float(np.abs(rough).max()))
                    found, near = found[keep], near[keep]
                score = (near * q).sum(axis=1)
                best = best_rows(score, ids[found], params.k)
                once = np.zeros(len(best), np.int64)
                once[:1] = 1
                out.append((np.full(len(best), query_ids[n]), np.full(len(best), numbers[n]), ids[found[best]], score[best], once * probed, once * reranked))
        cat = [np.concatenate(x) for x in zip(*out)] if out else [[]] * len(names)
        return pa.table({x: pa.array(c, pa.float64() if x == "score" else pa.int64()) for x, c in zip(names, cat)})

    return run


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def nearest(rows: DataFrame, queries: DataFrame, params: AnnParams = AnnParams()) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest rows by inner product.

    rows: vec_id, embedding; queries: vec_id, embedding, and a row of the same vec_id is no candidate.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an
    id or of another length than most. Ties go to the smaller vec_id. Repeated rows are candidates of
    their own; repeated queries (same id, same vector) are one, and different vectors of one id are queries of
    their own, each with its ranks. n_probed and n_reranked: rows that the lists gave for the query, and those of
    them within the radius. No usable vector gives no rows. Other columns play no part.
    """
    pick = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows, queries = pick(rows), pick(queries).dropDuplicates(["vec_id", "embedding"])
    lengths = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d, n = (lengths[0].d, lengths[0].n) if lengths else (0, 0)
    rows, queries = rows.filter(F.size("embedding") == d), queries.filter(F.size("embedding") == d)
    # an even draw by a hash of the id: as many rows are expected as asked for; the first of them are the queries
    draw = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(2**40)) / F.lit(float(2**40))
    drawn = rows.filter(draw < params.sample_rows / max(n, 1)).select(draw.alias("at"), "vec_id", "embedding").orderBy("at", "vec_id").limit(2 * params.sample_rows).collect()
    sample = np.array([r.embedding for r in drawn]) if drawn else np.ones((1, max(d, 1)))
    own = np.array([r.vec_id for r in drawn] or [0])
    codes = fit(sample, params.rounds)
    radius = fit_radius(rows, codes, sample[: params.sample_queries], own[: params.sample_queries], params)
    blocks, turns = max(1, -(-n // params.block_rows)), max(1, -(-queries.count() // params.block_queries))
    part = lambda of, *columns: F.pmod(F.xxhash64(*columns), F.lit(of))
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
    left = rows.withColumn("block", part(blocks, "vec_id", "embedding")).withColumn("turn", each(turns))
    asked = queries.select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("query_no"), F.col("embedding").alias("query"))
    right = asked.withColumn("turn", part(turns, "query_id", "query_no")).withColumn("block", each(blocks))
    schema = "query_id long, query_no long, vec_id long, score double, n_probed long, n_reranked long"
    found = left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn")).applyInArrow(tidied(search_block(codes, radius, params)), schema)
    best = Window.partitionBy("query_id", "query_no")
    ranked = found.withColumn("rank", F.row_number().over(best.orderBy(F.desc("score"), "vec_id")))
    ranked = ranked.withColumns({c: F.sum(c).over(best) for c in ("n_probed", "n_reranked")})
    return ranked.filter(F.col("rank") <= params.k).select("query_id", "rank", "vec_id", "score", "n_probed", "n_reranked")
