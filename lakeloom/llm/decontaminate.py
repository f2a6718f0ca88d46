"""Benchmark decontamination over suffix arrays of the training documents.

A shard is a run of whole documents as they lie in a partition, some ``shard_words`` words of them. Its suffix array is
built in the task that reads them: words become numbers (of the words that any item has; all others, and the ends
of documents, are 0, where no match can go on), the first words of each suffix are packed into one integer and
sorted, and groups that are still equal are sorted on by prefix doubling, as deep as the longest item has words. Every
suffix of every item is then looked up by binary search, all at once: the range that shares its first ``window``
words holds all occurrences of that window, and its neighbours hold the longest verbatim match and where it stands.

What moves: nothing of the documents. Items are sent to the tasks in blocks of about ``block_bytes``, whose size is
checked before; a second block makes a second pass in the same stage. Memory holds one shard and one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_or_empty

#: A-Z in lower case; 0-9, a-z and all bytes of code points from U+0080 on stay; all else separates words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

LAST = 2**63 - 1  # stands for a null doc_id, which comes last


@dataclass(frozen=True)
class LeakParams:
    window: int = 10
    #: Words of a shard, but that a document is never cut; bytes of a block of items.
    shard_words: int = 1_000_000
    block_bytes: int = 8_000_000


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def arrange(counts: np.ndarray) -> np.ndarray:
    """0, 1, ..., c - 1 for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Block:
    """Items in numbers: their words, suffixes and distinct windows."""

    def __init__(self, items: list[tuple[Any, bytes]], window: int) -> None:
        self.number: dict[bytes, int] = {}
        own = [[self.number.setdefault(w, len(self.number) + 1) for w in words(text)] for _, text in items]
        names = sorted({i for i, _ in items}, key=str)
        at = {i: k for k, i in enumerate(names)}
        self.names = np.array([("" if i is None else str(i)) for i in names], dtype=object)
        size = np.array([len(x) for x in own], dtype=np.int64)
        self.depth = int(size.max(initial=0))
        #: Words of all items; behind each one a 0.
        self.words = np.array([w for x in own for w in (*x, 0)], dtype=np.int64)
        start = np.cumsum(size + 1) - size - 1
        #: For each suffix its place, words and item.
        self.place = np.repeat(start, size) + arrange(size)
        self.left = np.repeat(size, size) - arrange(size)
        self.item = np.repeat(np.array([at[i] for i, _ in items], dtype=np.int64), size)
        self.offset = arrange(size)
        whole = (self.left >= window) | ((self.offset == 0) & (self.left > 0))
        kinds: dict[bytes, int] = {}
        lists: list[set[int]] = []
        self.window_place, self.window_size = [], []
        for p, n, i in zip(self.place[whole].tolist(), np.minimum(self.left[whole], window).tolist(), self.item[whole].tolist()):
            k = kinds.setdefault(self.words[p : p + n].tobytes(), len(kinds))
            if k == len(lists):
                lists.append(set())
                self.window_place.append(p)
                self.window_size.append(n)
            lists[k].add(i)
        self.window_place, self.window_size = np.array(self.window_place, dtype=np.int64), np.array(self.window_size, dtype=np.int64)
        # windows of the same items share a number
        sets: dict[frozenset[int], int] = {}
        self.window_set = np.array([sets.setdefault(frozenset(x), len(sets)) for x in lists], dtype=np.int64)
        self.sets = [np.array(sorted(x)) for x in sets]

    @cached_property
    def bits(self) -> int:
        return max(1, len(self.number).bit_length())


class SuffixArray:
    """The suffixes of a shard that begin with a word of the items, in order of their words' numbers."""

    def __init__(self, x: np.ndarray, bits: int, depth: int) -> None:
        """x: numbers of words, 0 behind each document; depth: words that have to be told apart."""
        self.x, self.n, self.bits = x, len(x), bits
        self.packed = packed = max(1, 63 // bits)
        behind = np.append(x, np.zeros(packed, dtype=np.int64))
        key, open_ = x.copy(), x > 0
        for k in range(1, packed):
            open_ &= behind[k : k + self.n] > 0
            key = (key << bits) | np.where(open_, behind[k : k + self.n], 0)
        sa = np.flatnonzero(x)
        sa = sa[np.argsort(key[sa], kind="stable")]
        self.keys = key[sa]
        # words before the next 0
        ends = np.where(x == 0, np.arange(self.n), self.n)
        self.length = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(self.n)
        rank = np.zeros(self.n, dtype=np.int64)
        first = np.append(True, self.keys[1:] != self.keys[:-1]) if len(sa) else np.zeros(0, dtype=bool)
        group = np.maximum.accumulate(np.where(first, np.arange(len(sa)), 0)) if len(sa) else sa
        rank[sa] = group + 1
        slots, h = np.arange(len(sa)), packed
        while h < depth and len(slots):
            same = np.append(group[1:] == group[:-1], False)
            same[1:] |= same[:-1].copy()
            slots, group = slots[same], group[same]
            more = self.length[sa[slots]] >= h  # a group's members agree in that, as their words so far do
            slots, group = slots[more], group[more]
            if not len(slots):
                break
            at = sa[slots]
            key = group * (self.n + 1) + rank[at + h]
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            sa[slots] = at
            first = np.append(True, key[1:] != key[:-1])
            group = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
            rank[at] = group + 1
            h *= 2
        self.sa = sa

    def bound(self, q: np.ndarray, place: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
        """For each query q[place : place + size] the first slot whose suffix isn't below it (after: whose first words are above it)."""
        prefix = np.zeros(len(place), dtype=np.int64)
        for k in range(self.packed):
            prefix <<= self.bits
            inside = size > k
            prefix[inside] |= q[place[inside] + k]
        low = np.searchsorted(self.keys, prefix, "left")
        free = np.maximum(0, self.packed - size) * self.bits
        high = np.searchsorted(self.keys, prefix | ((np.int64(1) << free) - 1), "right")
        short = (size <= self.packed) | (low >= high)
        out = np.where(after & short, high, low)
        todo = np.flatnonzero(~short)
        low, high, place, size = low[todo], high[todo], place[todo], size[todo]
        while (going := low < high).any():
            mid = (low + high) // 2
            down = self.below(np.where(going, mid, 0), q, place, size, after) & going
            low, high = np.where(down, mid + 1, low), np.where(going & ~down, mid, high)
        out[todo] = low
        return out

    def below(self, slot: np.ndarray, q: np.ndarray, place: np.ndarray, size: np.ndarray, equal: bool) -> np.ndarray:
        """Whether the slot's suffix comes before the query (equal: or begins with it)."""
        n = self.shared(slot, q, place, size)
        full = n >= size
        return np.where(full, equal, self.x[np.minimum(self.sa[slot] + n, self.n - 1)] < q[place + np.where(full, 0, n)])

    def shared(self, slot: np.ndarray, q: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Words that the slot's suffix and the query share from their beginnings on."""
        n = np.zeros(len(slot), dtype=np.int64)
        on, at = np.arange(len(slot)), self.sa[slot]
        while len(on):
            on = on[n[on] < size[on]]
            same = self.x[np.minimum(at[on] + n[on], self.n - 1)] == q[place[on] + n[on]]
            on = on[same]
            n[on] += 1
        return n


def shards(batches: Iterator[pa.RecordBatch], limit: int, number: dict[bytes, int]) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Whole documents in numbers: slices of the batches, counts of words, words (a 0 behind each document)."""
    held: list[pa.RecordBatch] = []
    counts: list[int] = []
    parts: list[np.ndarray] = []
    total = 0

    def shard():
        return held, np.array(counts, dtype=np.int64), np.concatenate([np.zeros(0, dtype=np.int64), *parts])

    for batch in batches:
        start = 0
        for k in range(batch.num_rows):
            own = words(batch.column(1)[k].as_py())
            get = number.get
            x = np.zeros(len(own) + 1, dtype=np.int64)
            x[:-1] = [get(w, 0) for w in own]
            parts.append(x)
            counts.append(len(own))
            total += len(x)
            if total >= limit:
                held.append(batch.slice(start, k + 1 - start))
                yield shard()
                held, counts, parts, total, start = [], [], [], 0, k + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if counts:
        yield shard()


class Blocks:
    """The items in blocks of a bounded size, by a hash of the text; equal rows are one. Only one block at a time is in the driver."""

    def __init__(self, items: DataFrame, params: LeakParams) -> None:
        self.rows = items.select("item_id", text_or_empty().cast("binary").alias("text")).distinct()
        self.n = -(-(self.rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // params.block_bytes)

    def sent(self, k: int) -> Any:
        rows = self.rows.filter(F.pmod(F.xxhash64("text"), F.lit(self.n)) == k) if self.n > 1 else self.rows
        return self.rows.sparkSession.sparkContext.broadcast([(r.item_id, bytes(r.text)) for r in rows.toLocalIterator()])


def find_leaks(docs: DataFrame, items: DataFrame, params: LeakParams = LeakParams(), carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, n_words, spans (start and end of each stretch of hit words, from 0), items.

    A window is ``params.window`` consecutive words of an item; an item of fewer words is one window, one without words has
    none. A word of a document is hit if an occurrence of a window covers it. items: ids, as strings in their order, of the items
    with an occurring window; rows of one item_id are one item, those without an id one of the empty name.
    carry: columns of the documents that are handed on.

    Null texts count as empty; a null doc_id is handed on; repeated rows give repeated rows; other columns play no part.
    Without items, or without documents, nothing is hit. Texts are read whole.
    """
    out, handed = carried_leaks(docs, items, params, carry)
    return out.select("doc_id", "n_words", "spans", "items", *(F.col(x).alias(c) for x, c in handed.items()))


def carried_leaks(docs: DataFrame, items: DataFrame, params: LeakParams, carry: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``find_leaks`` with names of its own for the columns that are handed on, and what they stand for."""
    handed = {f"carried_{k}": c for k, c in enumerate(carry)}
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"), *(F.col(c).alias(x) for x, c in handed.items()))
    blocks = Blocks(items, params)
    for k in range(max(1, blocks.n)):
        out = search(out, blocks.sent(k), params, k + 1 < blocks.n)
    return out, handed


def search(docs: DataFrame, sent: Any, params: LeakParams, texts: bool) -> DataFrame:
    """One pass: spans and items of a block, united with those that docs has from earlier blocks. texts: hand texts on."""
    found = [("n_words", "bigint"), ("spans", "array<struct<start:bigint,end:bigint>>"), ("items", "array<string>")]
    again = "spans" in docs.columns
    kept = [(x.name, x.dataType.simpleString()) for x in docs.schema if x.name not in ("n_words", "spans", "items")]
    ready = docs.select(*(x for x, _ in kept), *(("spans", "items") if again else ()))
    handed = [x for x in kept if texts or x[0] != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        block = Block(sent.value, params.window)
        for held, counts, x in shards(batches, params.shard_words, block.number):
            spans, names = leaks(block, counts, x)
            at = 0
            for part in held:
                to = at + part.num_rows
                own = {"n_words": counts[at:to], "spans": [joined([], s) for s in spans[at:to]], "items": names[at:to]}
                if again:
                    own["spans"] = [joined(a, s) for a, s in zip(part.column("spans").to_pylist(), spans[at:to])]
                    own["items"] = [sorted({*a, *b}) for a, b in zip(part.column("items").to_pylist(), names[at:to])]
                yield {name: part.column(name) for name, _ in handed} | own
                at = to

    return map_batches(ready, run, ", ".join(f"{name} {kind}" for name, kind in handed + found))


def joined(a: list[dict], b: list[tuple[int, int]]) -> list[dict]:
    """The union of two lists of spans; those that touch or overlap become one."""
    out: list[dict] = []
    for start, end in sorted([(s["start"], s["end"]) for s in a] + b):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(end, out[-1]["end"])
        else:
            out.append({"start": start, "end": end})
    return out


def leaks(block: Block, counts: np.ndarray, x: np.ndarray) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """For each document of a shard its hit spans and the names of its items."""
    spans: list[list[tuple[int, int]]] = [[] for _ in counts]
    names: list[list[str]] = [[] for _ in counts]
    if not len(block.window_place) or not x.any():
        return spans, names
    array = SuffixArray(x, block.bits, int(block.window_size.max()))
    low = array.bound(block.words, block.window_place, block.window_size, False)
    high = array.bound(block.words, block.window_place, block.window_size, True)
    many = high - low
    if not many.any():
        return spans, names
    at = array.sa[np.repeat(low, many) + arrange(many)]
    which = np.repeat(np.arange(len(many)), many)
    cover = np.zeros(len(x) + 1, dtype=np.int64)
    cover += np.bincount(at, minlength=len(cover)) - np.bincount(at + block.window_size[which], minlength=len(cover))
    hit = np.cumsum(cover)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    ends = np.cumsum(counts + 1)
    for start, end, d in zip(edge[::2].tolist(), edge[1::2].tolist(), np.searchsorted(ends, edge[::2], "right").tolist()):
        base = int(ends[d] - counts[d] - 1)
        spans[d].append((start - base, end - base))
    pairs = np.unique(np.stack([np.searchsorted(ends, at, "right"), block.window_set[which]]), axis=1)
    cut = np.flatnonzero(np.append(True, pairs[0, 1:] != pairs[0, :-1]))
    known: dict[tuple[int, ...], list[str]] = {}
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), pairs.shape[1]]):
        sets = tuple(pairs[1, a:b].tolist())
        if sets not in known:
            known[sets] = block.names[np.unique(np.concatenate([block.sets[s] for s in sets]))].tolist()
        names[int(pairs[0, a])] = known[sets]
    return spans, names


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256)


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contamination(docs: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """``find_leaks`` in numbers: doc_id, n_words, n_hit, n_items, items_sha256 (of the ids joined by commas), contaminated."""
    found = find_leaks(docs, items, params)
    n_hit = hit_words(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest(F.col("items")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_leaks(docs: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """The documents, with all their columns, that hold no window of an item."""
    found, handed = carried_leaks(docs, items, params, tuple(docs.columns))
    return found.filter(F.size("spans") == 0).select(*(F.col(x).alias(c) for x, c in handed.items()))


def longest_matches(docs: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """For each item that shares a word with a document its longest verbatim match: item_id (string), n_words, item_start, doc_id, doc_start.

    Of equally long ones that of the smallest doc_id (null last), then of the smallest places. Each shard gives one row an item;
    the best of each item is found by a grouped maximum. Nulls and repeated rows as in ``find_leaks``.
    """
    schema = "item_id string, n_words long, item_start long, doc_id long, doc_start long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))

    def one_pass(sent: Any) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            block = Block(sent.value, params.window)
            for held, counts, x in shards(batches, params.shard_words, block.number):
                ids = pa.concat_arrays([part.column("doc_id") for part in held])
                ids_or_last = np.array([LAST if i is None else i for i in ids.to_pylist()], dtype=np.int64)
                by_id = np.argsort(ids_or_last, kind="stable")
                rank = np.empty_like(by_id)
                rank[by_id] = np.arange(len(by_id))
                # places by document, then by word
                n, at = longest(block, x, np.repeat(rank, counts + 1) * len(x) + arrange(counts + 1))
                if not n.any():
                    continue
                doc, start = by_id[at // len(x)], at % len(x)
                key = ids_or_last[doc]
                order = np.lexsort((start, block.offset, key, -n, block.item))
                best = order[np.append(True, np.diff(block.item[order]) != 0)]
                best = best[n[best] > 0]
                yield {"item_id": block.names[block.item[best]].tolist(), "n_words": n[best], "item_start": block.offset[best], "doc_id": ids.take(pa.array(doc[best])), "doc_start": start[best]}

        return map_batches(rows, run, schema)

    blocks = Blocks(items, params)
    passes = [one_pass(blocks.sent(k)) for k in range(max(1, blocks.n))]
    found = reduce(DataFrame.unionByName, passes)
    first = F.struct("n_words", -F.coalesce("doc_id", F.lit(LAST)), -F.col("item_start"), -F.col("doc_start"), "doc_id", "item_start", "doc_start")
    best = found.groupBy("item_id").agg(F.max_by(F.struct("n_words", "item_start", "doc_id", "doc_start"), first).alias("best"))
    return best.select("item_id", "best.*")


def longest(block: Block, x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of the items the words of its longest match in a shard, if its item has no longer one, and the least weight of its places."""
    none = np.zeros(len(block.place), dtype=np.int64)
    if not len(none) or not x.any():
        return none, none
    array = SuffixArray(x, block.bits, block.depth)
    slot = array.bound(block.words, block.place, block.left, False)
    n = none
    for near in (slot - 1, slot):
        inside = np.flatnonzero((near >= 0) & (near < len(array.sa)))
        own = none.copy()
        own[inside] = array.shared(near[inside], block.words, block.place[inside], block.left[inside])
        n = np.maximum(n, own)
    most = np.zeros(len(block.names), dtype=np.int64)
    np.maximum.at(most, block.item, n)
    n = np.where(n == most[block.item], n, 0)
    # suffixes with the same match share the work
    at, some = none.copy(), np.flatnonzero(n)
    if len(some):
        low = array.bound(block.words, block.place[some], n[some], False)
        high = array.bound(block.words, block.place[some], n[some], True)
        (low, high), back = np.unique(np.stack([low, high]), axis=1, return_inverse=True)
        many = high - low
        at[some] = np.minimum.reduceat(weight[array.sa[np.repeat(low, many) + arrange(many)]], np.cumsum(many) - many)[back.ravel()]
    return n, at
