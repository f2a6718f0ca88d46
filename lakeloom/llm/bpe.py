"""BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a partition are laid out as one array of symbols. An index maps each
mergeable pair to all its positions; the active ranks are applied in ascending order, each to all its
positions at once, and every merge updates the lists of the pairs that it creates. Pre-tokens met before
come from a table of bounded size, so a frequent word is merged once per task.

The work is one narrow pass over the documents: no shuffle, and nothing is broadcast but the path of the
vocabulary file.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import WHITE, map_batches, text_or_empty

#: Bytes that a task's table of words may take, about; what an entry takes beside its strings.
TABLE_LIMIT, ENTRY = 56_000_000, 350
#: Texts of characters under this one have the same cases and letters in Python as in the library.
COMMON = "\u0250"
OTHER_SPLITS = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A byte-level BPE vocabulary with word ends, read from a ``tokenizers`` JSON file.

    It supports what such a file of kind "BPE, NFC, lower case, end_of_word_suffix" declares; another
    normalizer, split or decoder in the file raises ValueError.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path}: not a lower-case word BPE vocabulary")
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(r"\n|" + pattern.replace(r"\s", WHITE))
        self.white = regex.compile(f"[{WHITE}]+")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        library = Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": [], "end_of_word_suffix": None}, "added_tokens": []}))
        self.normal, self.split = library.normalizer, library.pre_tokenizer
        chars = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in chars], dtype=np.int32)
        #: by rank: left, right and merged id
        self.merge = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (x if isinstance(x, list) else x.split(" ") for x in model["merges"])]
        keys = np.array([a << 20 | b for a, b, _ in self.merge], dtype=np.int64)
        self.pair_ranks = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_ranks]

    def words(self, text: str) -> Iterator[list[str] | int]:
        """Runs of lower-case words between white space, and the ids of special tokens in the text."""
        for part in self.special_split.split(text) if self.special_split and "<|" in text else (text,):
            if part in self.special:
                yield self.special[part]
            elif part and (part.isascii() or max(part) < COMMON):
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part)
                part = part.lower()
                # str.split() also splits at \x1c-\x1f, which the vocabulary takes for symbols
                yield self.white.split(part) if OTHER_SPLITS.search(part) else part.split()
            elif part:  # nothing that the normalizer does reaches over white space
                yield [w.lower() if w.isascii() else self.normal.normalize_str(w) for w in self.white.split(part)]

    def pre_tokens(self, words: list[str]) -> tuple[list[bytes], list[int]]:
        """The pre-tokens of all words, one after the other, and where those of each word end."""
        out: list[bytes] = []
        ends: dict[str, tuple[int, int]] = {}
        common, rare = [w for w in words if w.isascii() or max(w) < COMMON], [w for w in words if not w.isascii() and max(w) >= COMMON]
        start, n = 0, 0
        for x in self.pieces.findall("\n".join(common) + "\n") if common else ():
            if x == "\n":
                ends[common[n]] = start, len(out)
                start, n = len(out), n + 1
            else:
                out.append(x.encode())
        for w in rare:
            out += (bytes(map(self.byte_of.__getitem__, x)) for x, _ in self.split.pre_tokenize_str(w))
            ends[w] = start, len(out)
            start = len(out)
        return out, [ends[w] for w in words]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where the vocabulary doesn't merge it."""
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def encode_words(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens in one array, and where each of them starts (and the last ends).

        All of them are merged together over one pair occurrence index.
        """
        if not data:
            return np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        size = np.array([len(x) for x in data], dtype=np.int64)
        ends = np.cumsum(size)
        raw = np.frombuffer(b"".join(data), dtype=np.uint8)
        n = len(raw)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.last[raw[ends - 1]]
        following = np.arange(1, n + 1)
        following[ends - 1] = -1
        previous = np.arange(-1, n - 1)
        previous[ends[:-1]] = -1
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(positions: np.ndarray, ranks: np.ndarray) -> None:
            """Enters positions in the lists of their pairs."""
            known = ranks >= 0
            positions, ranks = positions[known], ranks[known]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for part, r in zip(np.split(positions, cuts), ranks[np.append(0, cuts)].tolist()):
                if r in where:
                    where[r].append(part)
                else:
                    where[r] = [part]
                    heapq.heappush(active, r)

        inside = np.flatnonzero(following >= 0)
        note(inside, self.ranks(symbol[inside], symbol[inside + 1]))
        while active:
            r = heapq.heappop(active)
            left, right, whole = self.merge[r]
            lists = where.pop(r)
            p = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            q = following[p]
            live = (symbol[p] == left) & (q >= 0) & (symbol[q] == right)  # else a merge took part of the pair
            p, q = p[live], q[live]
            if left == right and len(p):
                taken, keep = -1, []  # a run of one symbol merges from its left
                for a, b in zip(p.tolist(), q.tolist()):
                    keep.append(a != taken)
                    taken = b if a != taken else -1
                p, q = p[keep], q[keep]
            if not len(p):
                continue
            after = following[q]
            symbol[p], symbol[q] = whole, -1
            following[p] = after
            inner = after >= 0
            previous[after[inner]] = p[inner]
            before = previous[p]
            outer = before >= 0
            at = np.concatenate([p[inner], before[outer]])
            if len(at):
                note(at, self.ranks(symbol[at], symbol[following[at]]))
        kept = symbol >= 0
        counts = np.concatenate([[0], np.cumsum(kept)])
        return symbol[kept].astype("<u4"), counts[np.concatenate([[0], ends])]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one space, special ones included: the vocabulary has no decoder."""
        return " ".join(self.token[i] for i in ids)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


class Encoder:
    """Encodes texts part by part, with a table of words already merged whose size is bounded."""

    def __init__(self, vocab: WordBpe, limit: int = TABLE_LIMIT):
        self.vocab, self.limit = vocab, limit
        self.forget()

    def forget(self) -> None:
        #: word -> its ids as little-endian unsigned 32-bit integers; word -> its decoded tokens
        self.ids: dict[str, bytes] = {"": b""}
        self.tokens: dict[str, str] = {"": ""}
        self.held = 0

    def learn(self, words: set[str]) -> None:
        if self.held > self.limit:  # what one part of a batch brings may pass the limit until the next one
            self.forget()
        new = list(words - self.ids.keys())
        if not new:
            return
        pieces, ends = self.vocab.pre_tokens(new)
        ids, at = self.vocab.encode_words(pieces)
        data, tokens, at = ids.tobytes(), list(map(self.vocab.token.__getitem__, ids.tolist())), at.tolist()
        spans_ = [(at[i], at[j]) for i, j in ends]
        self.ids.update(zip(new, [data[4 * i : 4 * j] for i, j in spans_]))
        self.tokens.update(zip(new, [" ".join(tokens[i:j]) for i, j in spans_]))
        self.held += ENTRY * len(new) + 2 * len(data) + sum(map(len, new)) + sum(map(len, tokens))

    def batch(self, texts: Iterable[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as bytes and its decoded text; one index spans all their new words."""
        split = [list(self.vocab.words(t)) for t in texts]
        self.learn(set().union(*(run for runs in split for run in runs if not isinstance(run, int))))
        for runs in split:
            ids: list[bytes] = []
            tokens: list[str] = []
            for run in runs:
                if isinstance(run, int):
                    ids.append(np.array([run], dtype="<u4").tobytes())
                    tokens.append(self.vocab.token[run])
                else:
                    ids.append(b"".join(map(self.ids.__getitem__, run)))
                    tokens += filter(None, map(self.tokens.__getitem__, run))
            yield b"".join(ids), " ".join(tokens)


def spans(sizes: list[int], limit: int = 3_000_000) -> Iterator[tuple[int, int]]:
    """Cuts a batch where its texts pass so many bytes: one index spans what is new in each part."""
    start = size = 0
    for n, own in enumerate(sizes):
        size += own
        if size >= limit:
            yield start, n + 1
            start, size = n + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode_documents(docs: DataFrame, vocab_path: str, *, ids: bool = True, decoded: bool = False, digests: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, n_tokens and, as asked for, ids, decoded and their digests.

    A null or empty text has no tokens; repeated rows give repeated rows; other columns play no part.
    ids: array of ids. digests: ids_sha256 and decoded_sha256 (of the ids as little-endian unsigned
    32-bit integers and of the decoded text in UTF-8). carry: long columns that are handed on.
    """
    schema = "doc_id long, n_tokens long" + ", ids array<int>" * ids + ", decoded string" * decoded + ", ids_sha256 string, decoded_sha256 string" * digests
    schema += "".join(f", {c} long" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = Encoder(vocabulary(vocab_path))
        for batch in batches:
            for at, to in spans(pc.binary_length(batch.column(1)).to_pylist()):
                rows = list(encoder.batch(batch.column(1).slice(at, to - at).to_pylist()))
                yield {
                    "doc_id": batch.column(0).slice(at, to - at),
                    "n_tokens": [len(x) // 4 for x, _ in rows],
                    "ids": [np.frombuffer(x, dtype="<u4") for x, _ in rows] if ids else None,
                    "decoded": [x for _, x in rows] if decoded else None,
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x, _ in rows] if digests else None,
                    "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for _, x in rows] if digests else None,
                } | {c: batch.column(2 + k).slice(at, to - at) for k, c in enumerate(carry)}

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), *(F.col(c).cast("long") for c in carry)), run, schema)


def decode_documents(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            yield {"doc_id": batch.column(0), "text": [vocab.decode(x or ()) for x in batch.column(1).to_pylist()]}

    return map_batches(encoded.select(F.col("doc_id").cast("long"), F.col("ids")), run, "doc_id long, text string")
