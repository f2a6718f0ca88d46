"""Token counts by section, attributed through offsets.

Each whole document is encoded once. The bytes of its tokens give every token's span; the spans are joined
to the intervals of the document's sections, and a token that crosses a boundary goes to one section by an
explicit rule. Encoding sections one by one would give other tokens at their edges.

One narrow pass: no shuffle, nothing broadcast but the path of the vocabulary file. Documents are encoded one
by one; very long runs of white space, on which the encoder's pattern would run out of stack, are cut off
where the pattern cuts as well.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, map_batches, text_or_empty

#: Who gets a token that crosses a boundary: the section of its first byte, of its last byte, or the one
#: that holds most of its bytes (of equal ones the first).
RULES = ("first", "last", "majority")


#: Runs of white space that are encoded apart, and the end of patterns under which that is right: such a run
#: is one part up to its last character, which goes with what follows, or up to its end at the end of a text.
LONG_WHITE = re.compile(f"[{WHITE}]{{100,}}")
CUTS_WHITE = r"|\s+(?!\S)|\s+"


class Encoder:
    """The vocabulary of a rank file, and the bytes of each id."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, n in ranks.items():
            self.size[n] = len(token)
        self.parts = tiktoken.Encoding("parts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}) if pattern.endswith(CUTS_WHITE) else None

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in LONG_WHITE.finditer(text) if self.whole else ():
            end = m.end() - (m.end() < len(text))
            out += self.parts.encode_ordinary(text[at : m.start()]) + self.whole.encode_ordinary(text[m.start() : end])
            at = end
        return out + self.parts.encode_ordinary(text[at:])


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def line_ends(data: bytes) -> np.ndarray:
    """Ends of a text's lines in bytes; a line owns the line feed that ends it."""
    at = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
    return at if len(at) and at[-1] == len(data) else np.append(at, len(data))


def attribute(sizes: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token. sizes: bytes of the tokens; ends: ascending ends of the sections."""
    to = np.cumsum(sizes)
    at = to - sizes
    first = np.searchsorted(ends, at, side="right")
    last = np.searchsorted(ends, to - 1, side="right")
    if rule == "first":
        return first
    if rule == "last":
        return last
    out = first.copy()
    for k in np.flatnonzero(last > first).tolist():  # few tokens cross a boundary
        cuts = np.clip(ends[first[k] : last[k] + 1], at[k], to[k])
        out[k] = first[k] + int(np.argmax(np.diff(np.append(at[k], cuts))))
    return out


def section_tokens(docs: DataFrame, vocab_path: str, pattern: str, rule: str = "majority", fields: tuple[str, ...] = ("text",), separator: str = "\n") -> DataFrame:
    """One row for each section of each document: its field, number, span and tokens.

    A document is its fields in order, joined by the separator, encoded as one text; each line of a field
    is a section, and the separator belongs to the section before it. Columns: doc_id, field (number from
    0), section (number in the document, from 0), char_start, char_end (in the joined text), n_tokens,
    n_crossing (tokens it was given that it holds in part only) and doc_tokens (of the whole document).
    Null fields count as empty. An empty document has one section without tokens. Repeated rows give
    repeated rows; other columns play no part.
    """
    if rule not in RULES:
        raise ValueError(f"rule has to be one of {RULES}")
    names = ["doc_id", "field", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"]
    schema = "doc_id long, field int, section int, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"
    glue = separator.encode()

    def one(parts: list[str]) -> list[np.ndarray]:
        encoder = encoding(vocab_path, pattern)
        data = [p.encode() + (glue if k + 1 < len(parts) else b"") for k, p in enumerate(parts)]
        whole = b"".join(data)
        ids = np.array(encoder.encode(whole.decode()), dtype=np.int64)
        ends, field, base = [], [], 0
        for k, x in enumerate(data):
            own = line_ends(x) + base
            ends.append(own)
            field.append(np.full(len(own), k))
            base += len(x)
        end = np.concatenate(ends)
        sizes = encoder.size[ids]
        owner = attribute(sizes, end, rule) if len(ids) else ids
        tokens = np.bincount(owner, minlength=len(end))
        to = np.cumsum(sizes)
        start = np.append(0, end[:-1])
        crossing = np.bincount(owner[(to > end[owner]) | (to - sizes < start[owner])], minlength=len(end)) if len(ids) else tokens
        chars = np.append(0, np.cumsum((np.frombuffer(whole, dtype=np.uint8) & 0xC0) != 0x80))
        n = len(end)
        return [np.concatenate(field), np.arange(n), chars[start], chars[end], tokens, crossing, np.full(n, len(ids))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, out, rows = batch.column(0).to_pylist(), [], 0  # texts are taken one by one
            found: list[int | None] = []
            for n, doc_id in enumerate(ids):
                own = one([batch.column(1 + k)[n].as_py() for k in range(len(fields))])
                out.append(own)
                found += [doc_id] * len(own[0])
                rows += len(own[0])
                if rows >= 50_000 or n + 1 == len(ids):
                    yield {"doc_id": found} | {k: np.concatenate(x) for k, x in zip(names[1:], zip(*out))}
                    out, found, rows = [], [], 0

    return map_batches(docs.select(F.col("doc_id").cast("long"), *(text_or_empty(x).alias(f"f{k}") for k, x in enumerate(fields))), run, schema)
