"""Substring dedup over prefix-partitioned suffix trees.

Every word of a document starts a suffix. Suffixes are dealt into groups by a prefix of variable length: one
pass counts the suffixes under hashed prefixes of 1, 2, 4, 8, 16 words. A suffix goes by its shortest prefix
that no more than ``group_suffixes / 2`` share, and such prefixes are packed into groups of up to
``group_suffixes``; one without such a prefix goes by all the words of its window, which spread over as many
groups as the data asks. So groups stay memory-sized however large the data are. A group is the part of the
suffix tree below its prefixes, cut off at a depth of ``window`` words and held as a sorted array of leaves. A
node of that depth is a run of equal leaves; its earliest leaf stands for it. The other leaves of consecutive
positions whose earliest leaves are consecutive too are one maximal repeat of a passage that stands earlier.

Leaves are told apart by 48 bits of a hash of their window, so each maximal repeat is verified on its words: where
the repeat is found and where the earlier passage stands, a 128-bit digest of all its words is taken. Where
digests differ, a node holds windows of several kinds: all leaves of the passage's nodes are told apart anew, by
128-bit digests of their words, and each kind keeps its own earliest leaf. There are few such nodes or none, and
without any that step reads nothing. Inside a chunk words themselves are compared.

What moves: documents are dealt once, by a hash of the id, into chunks of about ``chunk_bytes``; a chunk
first folds its own repeats, so that a passage, word or copy however frequent sends one leaf a chunk; the
other leaves travel as packed arrays (bits of the hash, id and position as differences), an array for each
group. Of repeats only positions and digests travel. On a very large cluster ``chunk_bytes`` and
``group_suffixes`` should grow together with the executors' memory, so that an array stays long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, shuffle_partitions, text_or_empty, tidied

NO_ID = 2**63 - 1  # stands for a null doc_id, which comes last
#: Odd constants of the mixing function.
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass(frozen=True)
class RepeatParams:
    window: int = 20
    chunk_bytes: int = 3_000_000
    #: Bytes of text that a task should hold about.
    task_bytes: int = 32_000_000
    #: Suffixes that a group should hold at most, and hashed prefixes that are counted at each length.
    group_suffixes: int = 1_500_000
    buckets: int = 1 << 14
    #: Bytes of a window's hash that travel.
    print_bytes: int = 6


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, order-sensitive."""
    x = a * A
    x ^= (b << np.uint64(31)) | (b >> np.uint64(33))
    x *= B
    x ^= x >> np.uint64(29)
    x *= C
    x ^= x >> np.uint64(32)
    return x


class Words:
    """The words of some texts, one after the other."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        if not some.all():  # white space at either end of a text leaves an empty string
            bounds = np.append(0, np.cumsum(some))[bounds]
            flat = flat.filter(pa.array(some))
        self.flat, self.ends, self.n = flat, bounds[1:], len(flat)  # ends: of each text, in words
        at, data = flat.buffers()[1:] if self.n else (None, None)
        #: where each word begins in the bytes of all, and the end of the last
        self.at = np.frombuffer(at, dtype=np.int32)[flat.offset : flat.offset + self.n + 1].astype(np.int64) if self.n else np.zeros(1, dtype=np.int64)
        self.data = np.frombuffer(data, dtype=np.uint8) if self.n else np.zeros(0, dtype=np.uint8)

    def hashes(self, step: int = 200_000) -> np.ndarray:
        """64 bits of each word: a polynomial in its bytes, mixed with its length."""
        out = np.zeros(self.n, dtype=np.uint64)
        size = np.diff(self.at)
        powers = np.multiply.accumulate(np.full(int(size.max(initial=0)) + 1, C))
        for a in range(0, self.n, step):  # a word has eight numbers of eight bytes for each of its own here
            own = size[a : a + step]
            begin = self.at[a : a + len(own)] - self.at[a]
            data = self.data[self.at[a] : self.at[a] + int(own.sum())]
            place = np.arange(len(data)) - np.repeat(begin, own)
            out[a : a + step] = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[place], begin)
        return mix(out, size.astype(np.uint64))

    def same(self, one: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
        """Whether the n words from one position are those from another."""
        codes = self.flat.dictionary_encode().indices.to_numpy()
        out = np.ones(len(one), dtype=bool)
        for k in range(n):
            out &= codes[one + k] == codes[other + k]
        return out

    def digests(self, starts: list[int], sizes: list[int]) -> list[bytes]:
        """128 bits of the words of some passages: of their bytes and their lengths."""
        out = []
        for a, n in zip(starts, sizes):
            at = self.at[a : a + n + 1]
            h = hashlib.blake2b(self.data[at[0] : at[-1]].tobytes(), digest_size=16)
            h.update(np.diff(at).tobytes())
            out.append(h.digest())
        return out

    def joined(self, keep: np.ndarray) -> pa.Array:
        """Each text's words that are kept, joined by one space."""
        total = np.append(0, np.cumsum(keep))
        kept = self.flat.filter(pa.array(keep)) if not keep.all() else self.flat
        lists = pa.LargeListArray.from_arrays(pa.array(total[np.append(0, self.ends)], pa.int64()), kept)
        return pc.binary_join(lists, " ")

    def prefixes(self, window: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, hashes of so many words from each position) for lengths 1, 2, 4, ... and last the window.

        Positions too near the end of all words are missing from the end of an array.
        """
        powers, k = {1: self.hashes()}, 1
        yield 1, powers[1]
        while 2 * k < window:
            h = powers[k]
            powers[2 * k] = h = mix(h[: max(0, len(h) - k)], h[k:])
            k *= 2
            yield k, h
        whole, have = powers[k], k
        while have < window:
            k = max(x for x in powers if x <= window - have)
            n = max(0, self.n - have - k + 1)
            whole, have = mix(whole[:n], powers[k][have : have + n]), have + k
        yield window, whole

    def starts(self, window: int) -> np.ndarray:
        """Positions of windows that lie inside one text."""
        begins = np.append(0, self.ends[:-1])
        size = np.maximum(0, self.ends - begins - window + 1)
        if not len(size) or not size.sum():
            return np.zeros(0, dtype=np.int64)
        return np.repeat(begins - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())


def first_and_later(prints: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of windows that are the first of their kind here, of those that aren't, and of the first for each of these."""
    if not len(prints):
        return starts, starts, starts
    order = np.argsort(prints)
    run = prints[order]
    new = np.ones(len(run), dtype=bool)
    new[1:] = run[1:] != run[:-1]
    begin = np.flatnonzero(new)
    firsts = np.minimum.reduceat(order, begin)
    first_of = np.repeat(firsts, np.diff(np.append(begin, len(order))))
    later = order != first_of
    return starts[np.sort(firsts)], starts[order[later]], starts[first_of[later]]


def shrink(*columns: np.ndarray) -> bytes:
    """Compressed differences of some columns of equal length."""
    data = b"".join(np.diff(x, prepend=0).astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for x in columns)
    return zstandard.ZstdCompressor(level=1).compress(len(columns[0]).to_bytes(8, "little") + data)


def grow(blob: bytes, columns: int) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[:8], "little")
    parts = np.frombuffer(data, dtype=np.uint8, offset=8).reshape(columns, 8, n)
    return [np.cumsum(np.ascontiguousarray(x.T).view(np.int64).ravel()) for x in parts]


def pack(prints: np.ndarray, ids: np.ndarray, positions: np.ndarray, width: int) -> bytes:
    """positions ascend; ids and positions become compressed differences, of prints width bytes stay."""
    kept = prints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return len(prints).to_bytes(7, "little") + bytes([width]) + kept.tobytes() + shrink(ids, positions)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = int.from_bytes(blob[:7], "little"), blob[7]
    prints = np.zeros((n, 8), dtype=np.uint8)
    prints[:, :width] = np.frombuffer(blob, dtype=np.uint8, count=width * n, offset=8).reshape(-1, width)
    return prints.view("<u8").ravel(), *grow(blob[8 + width * n :], 2)


def prefix_counts(docs: DataFrame, params: RepeatParams) -> tuple[dict[int, np.ndarray], int, int]:
    """Suffixes under each hashed prefix by length, bytes of all texts, and suffixes. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        size = suffixes = 0
        for batch in batches:
            bytes_ = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False)
            size += int(bytes_.sum())
            # a batch can be long: its arrays are held for one slice at a time
            cuts = np.unique(np.searchsorted(np.cumsum(bytes_), np.arange(0, bytes_.sum() + params.chunk_bytes, params.chunk_bytes), side="left").clip(0, len(bytes_)))
            for a, b in zip(cuts, [*cuts[1:], len(bytes_)]):
                words = Words(batch.column(0).slice(a, b - a))
                starts = words.starts(params.window)
                suffixes += len(starts)
                for length, h in words.prefixes(params.window) if len(starts) else ():
                    if length < params.window:
                        sums[length] = sums.get(length, 0) + np.bincount((h[starts] % np.uint64(params.buckets)).astype(np.int64), minlength=params.buckets)
        rows = [(-1, 0, size), (0, 0, suffixes)] + [(k, b, n) for k, x in sums.items() for b, n in enumerate(x.tolist()) if n]
        yield dict(zip(("length", "bucket", "n"), zip(*rows)))

    rows = map_batches(docs.select(text_or_empty().alias("text")), run, "length int, bucket int, n long").groupBy("length", "bucket").agg(F.sum("n").alias("n")).collect()
    counts: dict[int, np.ndarray] = {}
    for r in rows:  # (window's bit length) * buckets + 1 at most
        if r.length > 0:
            counts.setdefault(r.length, np.zeros(params.buckets, dtype=np.int64))[r.bucket] = r.n
    return counts, sum(r.n for r in rows if r.length < 0), sum(r.n for r in rows if r.length == 0)


@dataclass(frozen=True)
class Prefixes:
    """Which group each suffix belongs to."""

    #: By length of the prefix: the group of each bucket, -1 where a longer prefix is asked.
    group_of: dict[int, np.ndarray]
    #: Groups of suffixes that go by their whole window.
    deep: int
    groups: int

    @classmethod
    def of(cls, counts: dict[int, np.ndarray], suffixes: int, params: RepeatParams) -> Prefixes:
        """Packs the prefixes that few enough suffixes share into groups, in order, and counts what is left."""
        group_of, at = {}, 0
        for length, n in sorted(counts.items()):
            fits = (n > 0) & (2 * n <= params.group_suffixes)
            # a group ends before it would pass half of what it may hold, and takes one bucket more at most
            group = np.cumsum(np.where(fits, n, 0)) * 2 // max(params.group_suffixes, 1)
            group_of[length] = np.where(fits, at + group, -1)
            at += int(group.max()) + 1
        deep = max(1, -(-2 * suffixes // max(params.group_suffixes, 1)))
        return cls(group_of, deep, at + deep)

    def groups_of(self, levels: list[tuple[int, np.ndarray]], starts: np.ndarray, window: int) -> np.ndarray:
        group = np.full(len(starts), -1, dtype=np.int64)
        for length, h in levels:
            open_ = np.flatnonzero(group < 0)
            h = h[starts[open_]]
            if length == window:
                group[open_] = self.groups - self.deep + ((h >> np.uint64(20)) % np.uint64(self.deep)).astype(np.int64)
            elif length in self.group_of:
                group[open_] = self.group_of[length][(h % np.uint64(len(self.group_of[length]))).astype(np.int64)]
        return group


def sorted_chunk(t: pa.Table) -> tuple[pa.Table, np.ndarray, pa.Array, pa.Array]:
    """A chunk in order of (id, text); its ids with NO_ID for null, ids as they are, and texts."""
    order = pc.fill_null(t.column("doc_id"), NO_ID)
    t = t.append_column("order", order).append_column("no_id", pc.is_null(t.column("doc_id")))
    t = t.sort_by([("order", "ascending"), ("no_id", "ascending"), ("text", "ascending")]).combine_chunks()
    flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return t, flat(t.column("order")).to_numpy(), flat(t.column("doc_id")), flat(t.column("text"))


def chunk_leaves(params: RepeatParams, prefixes: Prefixes) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        _, ids, _, texts = sorted_chunk(t)
        words = Words(texts)
        starts = words.starts(params.window)
        levels = list(words.prefixes(params.window))
        prints = levels[-1][1]
        first, _, _ = first_and_later(prints[starts], starts)
        group = prefixes.groups_of(levels, first, params.window)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        doc = np.searchsorted(words.ends, first, side="right")
        parts = [x for x in np.split(order, cuts) if len(x)]
        return pa.table(
            {
                "group": pa.array([int(group[x[0]]) for x in parts], pa.int64()),
                "chunk": pa.array([t.column("chunk")[0].as_py()] * len(parts), pa.int64()),
                "leaves": pa.array([pack(prints[first[x]], ids[doc[x]], first[x], params.print_bytes) for x in parts], pa.binary()),
            }
        )

    return run


def repeated_leaves(t: pa.Table) -> pa.Table:
    """Of one group's leaves those that aren't the earliest of their node, by chunk: positions, and where the earliest is."""
    found = [unpack(x) for x in t.column("leaves").to_pylist()]
    chunks = np.array(t.column("chunk").to_pylist(), dtype=np.int64)
    prints, ids, positions = (np.concatenate(x) for x in zip(*found))
    chunk = np.repeat(chunks, [len(x[0]) for x in found])
    order = np.lexsort((ids, prints))  # a chunk has one leaf of a kind, and the rows of an id lie in one chunk
    run = prints[order]
    new = np.ones(len(run), dtype=bool)
    new[1:] = run[1:] != run[:-1]
    later, earliest = order[~new], order[new][np.cumsum(new) - 1][~new]
    by_chunk = np.lexsort((positions[later], chunk[later]))
    later, earliest = later[by_chunk], earliest[by_chunk]
    parts = np.split(np.arange(len(later)), np.flatnonzero(np.diff(chunk[later])) + 1) if len(later) else []
    blobs = [shrink(positions[later[x]], chunk[earliest[x]], positions[earliest[x]]) for x in parts]
    return pa.table({"chunk": pa.array([int(chunk[later[x[0]]]) for x in parts], pa.int64()), "found": pa.array(blobs, pa.binary())})


def replies(t: pa.Table) -> list[np.ndarray]:
    """Position, chunk and position of the earliest leaf of all replies to a chunk, in order of position."""
    got = [grow(x, 3) for x in t.column("found").to_pylist() if x is not None]
    if not got:
        return [np.zeros(0, dtype=np.int64)] * 3
    columns = [np.concatenate(x) for x in zip(*got)]
    order = np.argsort(columns[0], kind="stable")
    return [x[order] for x in columns]


def maximal_repeats(params: RepeatParams) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The maximal repeats of a chunk, with digests of their words: chunk, at, of_chunk, of_at, n (words), digest."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        at, of_chunk, of_at = replies(found)
        out = [[], [], [], [], [], []]
        if len(at):
            new = np.ones(len(at), dtype=bool)
            new[1:] = (np.diff(at) != 1) | (np.diff(of_at) != 1) | (np.diff(of_chunk) != 0)
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(at))) + params.window - 1
            digests = Words(sorted_chunk(docs)[3]).digests(at[first].tolist(), size.tolist())
            out = [np.full(len(first), docs.column("chunk")[0].as_py()), at[first], of_chunk[first], of_at[first], size, digests]
        names = ("chunk", "at", "of_chunk", "of_at", "n", "digest")
        return pa.table({x: pa.array(c, pa.binary() if x == "digest" else pa.int64()) for x, c in zip(names, out)})

    return run


def doubtful_nodes(params: RepeatParams, prefixes: Prefixes) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(group, print) of the windows of a chunk's passages whose words have another digest than the repeat found of them."""
    mask = np.uint64(2 ** (8 * params.print_bytes) - 1)

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        group = prints = np.zeros(0, dtype=np.int64)
        if asked.num_rows:
            words = Words(sorted_chunk(docs)[3])
            passages = list(zip(asked.column("of_at").to_pylist(), asked.column("n").to_pylist()))
            own = words.digests(*map(list, zip(*passages)))
            wrong = [np.arange(at, at + n - params.window + 1) for (at, n), x, y in zip(passages, own, asked.column("digest").to_pylist()) if x != y]
            if wrong:
                starts = np.unique(np.concatenate(wrong))
                levels = list(words.prefixes(params.window))
                group, prints = prefixes.groups_of(levels, starts, params.window), (levels[-1][1][starts] & mask).view(np.int64)
        return pa.table({"group": pa.array(group, pa.int64()), "print": pa.array(prints, pa.int64())})

    return run


def leaves_of_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Of packed leaves (chunk, leaves, prints) those with one of the prints."""
    for batch in batches:
        for chunk, leaves, wanted in zip(*(batch.column(k) for k in range(3))):
            prints, ids, positions = unpack(leaves.as_py())
            hit = np.isin(prints.view(np.int64), wanted.values.to_numpy())
            yield {"chunk": np.full(hit.sum(), chunk.as_py()), "id": ids[hit], "at": positions[hit]}


def window_digests(params: RepeatParams) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        at = asked.column("at").to_pylist()
        digests = Words(sorted_chunk(docs)[3]).digests(at, [params.window] * len(at)) if at else []
        return pa.table({c: asked.column(c) for c in ("chunk", "id", "at")} | {"digest": pa.array(digests, pa.binary())})

    return run


def cut_chunk(params: RepeatParams, spans: bool, texts_too: bool, carry: tuple[str, ...]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        docs, _, ids, texts = sorted_chunk(docs)
        words = Words(texts)
        starts = words.starts(params.window)
        *_, (_, prints) = words.prefixes(params.window)
        _, later, first = first_and_later(prints[starts], starts)
        same = words.same(later, first, params.window)
        judged = found.select(["at", "repeats"]).drop_null()  # leaves of nodes that hold windows of several kinds
        at = judged.column("at").to_numpy()
        far = np.setdiff1d(replies(found)[0], at)
        begin = np.unique(np.concatenate([later[same], far, at[judged.column("repeats").to_numpy()]]).astype(np.int64))
        marks = np.zeros(words.n + 1, dtype=np.int32)
        np.add.at(marks, begin, 1)
        np.add.at(marks, begin + params.window, -1)
        gone = np.cumsum(marks)[:-1] > 0
        begins = np.append(0, words.ends[:-1])
        total = np.append(0, np.cumsum(gone))
        n_words, n_removed = words.ends - begins, total[words.ends] - total[begins]
        joined = words.joined(~gone)
        digests = [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined.cast(pa.large_binary() if pa.types.is_large_string(joined.type) else pa.binary())]
        kept = [a.as_py() if n else b.as_py() for n, a, b in zip(n_removed.tolist(), joined, texts)] if texts_too else []
        where = []
        for a, b, removed in zip(begins.tolist(), words.ends.tolist(), n_removed.tolist()) if spans else ():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b], [0]]))).tolist() if removed else []
            where.append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2])])
        out = {"doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if texts_too:
            out["kept_text"] = pa.array(kept, pa.string())
        if spans:
            out["removed_spans"] = pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table(out | {c: docs.column(f"carried_{c}") for c in carry})

    return run


def remove_repeats(docs: DataFrame, params: RepeatParams = RepeatParams(), *, spans: bool = False, texts: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256, and kept_text or removed_spans if asked for.

    A word goes if it lies in a window of ``window`` consecutive words of its document that also starts
    earlier: in a document of smaller id, or before in the same one. Windows are judged on the input. The
    digest is of the kept words joined by one space; kept_text is that too where a word went, else the text
    as it was. removed_spans are the maximal runs of removed words. A null or empty text has no words. Null
    ids come last; rows of the same id come in order of their texts. The columns in carry are handed on with
    their rows; others play no part. A text longer than a chunk is a chunk of its own.
    """
    counts, size, suffixes = prefix_counts(docs, params)
    chunks = max(1, -(-size // params.chunk_bytes))
    prefixes = Prefixes.of(counts, suffixes, params)
    parts = max(shuffle_partitions(docs.sparkSession), -(-size // params.task_bytes))
    dealt = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), *(F.col(c).alias(f"carried_{c}") for c in carry))
    # neither chunk nor group is ever null: said here, joins below don't say it and find the exchanges there are
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID))), F.lit(chunks))).filter("chunk IS NOT NULL").repartition(parts, "chunk")
    of_chunk = dealt.groupBy("chunk")
    leaves = of_chunk.applyInArrow(tidied(chunk_leaves(params, prefixes)), "group long, chunk long, leaves binary").filter("group IS NOT NULL").repartition(parts, "group")
    found = leaves.groupBy("group").applyInArrow(tidied(repeated_leaves), "chunk long, found binary").repartition(parts, "chunk")
    repeats = of_chunk.cogroup(found.groupBy("chunk")).applyInArrow(tidied(maximal_repeats(params)), "chunk long, at long, of_chunk long, of_at long, n long, digest binary").repartition(parts, "of_chunk")
    asked = repeats.select("of_chunk", "of_at", "n", "digest").distinct()  # a passage repeated in very many chunks is asked for once
    doubtful = of_chunk.cogroup(asked.groupBy("of_chunk")).applyInArrow(tidied(doubtful_nodes(params, prefixes)), "group long, print long")
    several = leaves.join(doubtful.groupBy("group").agg(F.collect_set("print").alias("prints")), "group").select("chunk", "leaves", "prints")
    several = map_batches(several, leaves_of_nodes, "chunk long, id long, at long").repartition(parts, "chunk")
    their = dealt.join(several.select("chunk").distinct(), "chunk").groupBy("chunk").cogroup(several.groupBy("chunk"))
    kinds = their.applyInArrow(tidied(window_digests(params)), "chunk long, id long, at long, digest binary")
    # a kind has one leaf a chunk, and the rows of an id lie in one chunk
    judged = kinds.select("chunk", "at", (F.col("id") > F.min("id").over(Window.partitionBy("digest"))).alias("repeats"))
    replies_ = found.unionByName(judged, allowMissingColumns=True).repartition(parts, "chunk")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts + ", removed_spans array<struct<start: long, end: long>>" * spans
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return of_chunk.cogroup(replies_.groupBy("chunk")).applyInArrow(tidied(cut_chunk(params, spans, texts, carry)), schema)
