"""Periodic run detection by block convolution.

A run is a longest stretch of words that repeats with a smallest period q, of at least ``max(shortest, 2 q)`` words. With a
period q some ``max(q, shortest - q)`` words or more in a row equal the word q further on, so they hold a whole
block of a grid of blocks of B words, if B is a power of two with 2 B - 1 no more than that. So, at each dyadic
scale B, every block of the grid is compared with all windows that start at the distances of that scale behind it: the sums of
squared differences of word numbers over a block come out of one convolution, done by an exact number-theoretic transform
modulo a prime. A sum of zero is an occurrence without mismatch (or a chance multiple of the prime, which the next step
sorts out); its distance seeds an extension to both sides, as far as words that distance apart stay equal. Of the stretches
with one start and one end the smallest distance is the period.

Before the transform blocks are left out in which some word doesn't come again within the scale's distances: such a block
can't occur again. Extensions use hashes of prefixes modulo two primes and doubling steps; each run found is then held
against its words, and the work is done again with another base if one differs. So results are exact.

Nothing moves: documents are read in chunks as they lie, whole, with a word of its own between two of them. Time grows as
n log² n with a chunk's words at worst, also for texts that are one long run; memory holds one chunk.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_or_empty

#: 15 * 2**27 + 1, a prime with 31 as a generator: transforms of up to 2**27 numbers.
PRIME, GENERATOR, ROOTS = 2013265921, 31, 27
#: Primes of the prefix hashes.
HASH_PRIMES = (2147483647, 2147483629)
#: Numbers that one batch of transforms holds.
BATCH = 1 << 20


@dataclass(frozen=True)
class RunParams:
    #: Words that a run has at least.
    shortest: int = 12
    #: Words of a chunk, but that a document is never cut.
    chunk_words: int = 500_000


def power(base: int, n: int, prime: int) -> np.ndarray:
    """base**0, ..., base**(n - 1) modulo prime, by doubling."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


@lru_cache(maxsize=64)
def roots(size: int, inverse: bool) -> np.ndarray:
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    return power(pow(root, PRIME - 2, PRIME) if inverse else root, size // 2, PRIME)


def transform(a: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of each row, whose size is a power of two (Stockham's order: no bit reversal)."""
    rows, size = a.shape
    if size > 1 << ROOTS:
        raise ValueError(f"a document has more than {1 << ROOTS} words")
    prime, x, half, width = np.uint64(PRIME), a.astype(np.uint64), size // 2, 1
    while half:
        x = x.reshape(rows, 2, half, width)
        w = roots(2 * half, inverse)[None, :, None] if half > 1 else np.ones((1, 1, 1), dtype=np.uint64)
        low, high = x[:, 0], x[:, 1]
        out = np.empty((rows, half, 2, width), dtype=np.uint64)
        out[:, :, 0] = (low + high) % prime
        out[:, :, 1] = (low + (prime - high)) % prime * w % prime
        x, half, width = out, half // 2, width * 2
    x = x.reshape(rows, size)
    return x * np.uint64(pow(size, PRIME - 2, PRIME)) % prime if inverse else x


def zero_mismatches(x: np.ndarray, starts: np.ndarray, block: int, near: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (their starts) and distances from near to far at which they occur again: all of them, and hardly any others."""
    prime, span = np.uint64(PRIME), far - near + block
    size = 1 << (span - 1).bit_length()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows = max(1, BATCH // size)
    for part in (starts[k : k + rows] for k in range(0, len(starts), rows)):
        pattern = np.zeros((len(part), size), dtype=np.uint64)
        pattern[:, :block] = x[part[:, None] + np.arange(block)]
        window = np.zeros((len(part), size), dtype=np.uint64)
        at = part[:, None] + near + np.arange(span)
        window[:, :span] = np.where(at < len(x), x[np.minimum(at, len(x) - 1)], 0)
        backwards = np.roll(pattern[:, ::-1], 1, axis=1)
        cross = transform(transform(backwards) * transform(window) % prime, inverse=True)[:, : far - near + 1]
        squares = np.cumsum(window * window % prime, axis=1)
        squares = squares[:, block - 1 : span] - np.concatenate([np.zeros((len(part), 1), dtype=np.uint64), squares[:, : span - block]], axis=1)
        own = (pattern * pattern % prime).sum(axis=1)[:, None]
        row, distance = np.nonzero((own + squares) % prime == cross * np.uint64(2) % prime)
        found.append((part[row], distance + near))
    return tuple(np.concatenate(p) for p in zip(*found)) if found else (starts, starts)


def scales(shortest: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """(block, nearest, farthest distance) of each scale, for runs of up to so many words.

    A distance q belongs to the largest block of which a stretch of max(q, shortest - q) words always holds a whole one.
    """
    block, most = 1, longest // 2
    while 2 * block - 1 <= max(most, shortest):
        own = [q for q in range(1, min(most, max(shortest, 4 * block - 2)) + 1) if 2 * block - 1 <= max(q, shortest - q) < 4 * block - 1]
        if own:
            yield block, own[0], own[-1]
        block *= 2


class Hashes:
    """Hashes of stretches of x by prefixes, modulo two primes."""

    def __init__(self, x: np.ndarray, seed: int) -> None:
        self.n, self.parts = len(x), []
        for k, prime in enumerate(HASH_PRIMES):
            own = power(1_000_003 + 7919 * seed + 104_729 * k, len(x) + 1, prime)
            sums = np.cumsum((x.astype(np.uint64) + np.uint64(1)) % np.uint64(prime) * own[:-1] % np.uint64(prime))
            self.parts.append((np.uint64(prime), own, np.append(np.uint64(0), sums) % np.uint64(prime)))

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether x[i : i + size] and x[j : j + size] have one hash; i < j."""
        out = np.ones(len(i), dtype=bool)
        for prime, own, sums in self.parts:
            left = (sums[i + size] + prime - sums[i]) % prime * own[j - i] % prime
            out &= left == (sums[j + size] + prime - sums[j]) % prime
        return out

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes from i and j on share."""
        out = np.zeros(len(i), dtype=np.int64)
        for step in (1 << k for k in range(self.n.bit_length() - 1, -1, -1)):
            fits = np.flatnonzero(j + out + step <= self.n)
            out[fits[self.equal(i[fits] + out[fits], j[fits] + out[fits], np.int64(step))]] += step
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the prefixes up to before i and j share."""
        out = np.zeros(len(i), dtype=np.int64)
        for step in (1 << k for k in range(self.n.bit_length() - 1, -1, -1)):
            fits = np.flatnonzero(i - out - step >= 0)
            out[fits[self.equal(i[fits] - out[fits] - step, j[fits] - out[fits] - step, np.int64(step))]] += step
        return out


def seeds(x: np.ndarray, longest: int, shortest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each scale its block, and places and distances at which blocks occur again."""
    order = np.argsort(x, kind="stable")
    again = np.full(len(x), len(x), dtype=np.int64)  # words to the next same word
    same = x[order[1:]] == x[order[:-1]]
    again[order[:-1][same]] = np.diff(order)[same]
    most, block = again, 1
    for want, near, far in scales(shortest, longest):
        while block < want:
            most = most[: len(most) // 2 * 2].reshape(-1, 2).max(axis=1)
            block *= 2
        live = np.flatnonzero(most <= far)
        if len(live):
            yield block, *zero_mismatches(x, live * block, block, near, far)


def find(x: np.ndarray, longest: int, shortest: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs of x, by start and end. longest: words that a run may have at most."""
    hashes, found = None, [np.zeros((3, 0), dtype=np.int64)]
    for block, at, distance in seeds(x, longest, shortest):
        hashes = hashes or Hashes(x, seed)
        inside = np.flatnonzero(at + distance + block <= len(x))
        at, distance = at[inside], distance[inside]
        alike = hashes.equal(at, at + distance, np.int64(block))  # chance multiples of the prime go
        at, distance = at[alike], distance[alike]
        order = np.lexsort((at, distance))
        at, distance = at[order], distance[order]
        first = np.append(True, (np.diff(distance) != 0) | (np.diff(at) != block))[: len(at)]
        at, distance = at[first], distance[first]  # blocks in a row with one distance lie in one stretch
        start = at - hashes.backward(at, at + distance)
        end = at + distance + hashes.forward(at, at + distance)
        long = end - start >= np.maximum(shortest, 2 * distance)
        found.append(np.stack([start[long], end[long], distance[long]]))
    start, end, distance = np.concatenate(found, axis=1)
    order = np.lexsort((distance, end, start))
    start, end, distance = start[order], end[order], distance[order]
    first = np.append(True, (np.diff(start) != 0) | (np.diff(end) != 0))[: len(start)]
    start, end, distance = start[first], end[first], distance[first]
    for s, e, q in zip(start.tolist(), end.tolist(), distance.tolist()):
        if not np.array_equal(x[s : e - q], x[s + q : e]):  # two stretches share a hash
            return find(x, longest, shortest, seed + 1)
    return start, end, distance


def chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[pa.Array], list[list[bytes]]]]:
    """Ids and words of whole documents, some limit words at a time."""
    ids: list[pa.Array] = []
    texts: list[list[bytes]] = []
    total = 0
    for batch in batches:
        start = 0
        for k in range(batch.num_rows):
            texts.append(batch.column(1)[k].as_py().split())
            total += len(texts[-1]) + 1
            if total >= limit:
                yield [*ids, batch.column(0).slice(start, k + 1 - start)], texts
                ids, texts, total, start = [], [], 0, k + 1
        if start < batch.num_rows:
            ids.append(batch.column(0).slice(start))
    if texts:
        yield ids, texts


def numbers(texts: list[list[bytes]]) -> np.ndarray:
    """The words of all texts as numbers from 0 on; behind each text a number of its own."""
    known: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    get = known.__getitem__
    parts = [np.fromiter(map(get, t), dtype=np.int64, count=len(t)) for t in texts]
    return np.concatenate([x for k, p in enumerate(parts) for x in (p, [len(known) + k])]).astype(np.int64)


FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>"


def find_runs(docs: DataFrame, params: RunParams = RunParams(), *, text: bool = False, digests: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_words, runs (start, length, period, by start and period) and, as asked for, more.

    Words are what ASCII white space separates, numbered from 0. A word goes if some run holds it after that run's first
    period. text: collapsed_text, the words that stay, joined by one space. digests: runs_sha256 (of ``start,length,period``
    and a line feed for each run) and collapsed_sha256.

    A null or empty text has no words and no runs; a null doc_id is handed on; repeated rows give repeated rows, an empty
    table no rows; other columns play no part. Runs may overlap and hold each other.
    """
    schema = f"doc_id long, {FOUND}" + ", collapsed_text string" * text + ", runs_sha256 string, collapsed_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, texts in chunks(batches, params.chunk_words):
            x = numbers(texts)
            counts = np.array([len(t) for t in texts], dtype=np.int64)
            base = np.cumsum(counts + 1) - counts - 1
            start, end, period = find(x, int(counts.max()), params.shortest)
            cover = np.bincount(start + period, minlength=len(x) + 1) - np.bincount(end, minlength=len(x) + 1)
            gone = np.cumsum(cover) > 0
            doc = np.searchsorted(base, start, "right") - 1
            runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for d, s, n, q in zip(doc.tolist(), (start - base[doc]).tolist(), (end - start).tolist(), period.tolist()):
                runs[d].append((s, n, q))
            kept = []
            for k, (t, own) in enumerate(zip(texts, runs)):
                own.sort(key=lambda r: (r[0], r[2]))
                kept.append(b" ".join(itertools.compress(t, ~gone[base[k] : base[k] + len(t)]) if own else t))
            yield {
                "doc_id": pa.concat_arrays(ids),
                "n_words": counts,
                "runs": [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs],
                "collapsed_text": [t.decode() for t in kept] if text else None,
                "runs_sha256": [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest() for own in runs] if digests else None,
                "collapsed_sha256": [hashlib.sha256(t).hexdigest() for t in kept] if digests else None,
            }

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary")), run, schema)


def damage(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts made periodic as the contract says; a document without an id stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text_or_empty(), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.size("words")
    a = F.col("g") % F.nullif(n, F.lit(0))
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    hurt = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g")).withColumns({"a": F.when(n > 0, a), "p": F.when(n > 0, p)})
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return hurt.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def greatest_run(found: DataFrame) -> DataFrame:
    """The digest of ``find_runs`` with digests: n_runs and the longest run (ties: least start, then period; none: nulls)."""
    longest = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))
    out = found.select("*", longest.alias("best"))
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period"))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
