"""Conversation repair, decontamination and periodic runs against brute force, with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import conversations, decontaminate, queries, runs
from lakeloom.llm.decontaminate import Block, LeakParams, SuffixArray

SPACE = " \t\n\x0b\x0c\r"


# conversations


def by_hand(rows: list[tuple]) -> tuple:
    """The contract of a conversation's rows (turn, role, text), by trying all edits."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        words = text.strip(SPACE)
        faults.append("b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(k: int, state: str):
        """Cheapest (cost, letters, turns) from row k on, after the state; turns as (role, text)."""
        out = [(0, "", ())] if k == len(rows) and state in ("", "a") else []
        if k < len(rows):
            _, role, text = rows[k]
            cost, letters, turns = best(k + 1, state)
            out.append((cost + 4, "D" + letters, turns))
            if faults[k] not in ("b", "d"):
                worse = 3 * (faults[k] == "t")
                if (state, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    cost, letters, turns = best(k + 1, role[0])
                    out.append((cost + worse, "K" + letters, ((role, text), *turns)))
                to = "assistant" if state == "u" else "user"
                cost, letters, turns = best(k + 1, to[0])
                out.append((cost + worse + 3, "R" + letters, ((to, text), *turns)))
        return min(out + puts(k, state, 2))

    def puts(k: int, state: str, left: int):
        if not left:
            return []
        to = "assistant" if state == "u" else "user"
        deeper = puts(k, to[0], left - 1) + [x for x in [plain(k, to[0])] if x]
        return [(c + 3, "I" + a, ((to, ""), *t)) for c, a, t in deeper]

    @lru_cache(None)
    def plain(k: int, state: str):
        """As best, but with no turn put in first."""
        out = [(0, "", ())] if k == len(rows) and state in ("", "a") else []
        if k < len(rows):
            _, role, text = rows[k]
            cost, letters, turns = best(k + 1, state)
            out.append((cost + 4, "D" + letters, turns))
            if faults[k] not in ("b", "d"):
                worse = 3 * (faults[k] == "t")
                if (state, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    cost, letters, turns = best(k + 1, role[0])
                    out.append((cost + worse, "K" + letters, ((role, text), *turns)))
                to = "assistant" if state == "u" else "user"
                cost, letters, turns = best(k + 1, to[0])
                out.append((cost + worse + 3, "R" + letters, ((to, text), *turns)))
        return min(out, default=None)

    cost, audit, turns = best(0, "")
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    n = Counter(faults)
    return gaps, n["b"], n["d"], n["t"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(), turns


def damaged(rows: list[tuple]) -> dict:
    out: dict = defaultdict(list)
    for conv, turn, role, text in rows:
        filled = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{filled(conv)}:{filled(turn)}".encode()) % 20
        role, text = filled(role), filled(text)
        out[conv]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def talk(seed: int, n: int) -> list[tuple]:
    r = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "usher"]
    texts = ["Yes.", "No!", "and then", " ", "", None, "Why?\n", "Well…", "x. ", "Yes. "]
    return [(None if r.random() < 0.05 else int(r.integers(0, n + 2)), roles[int(r.choice(7, p=[0.4, 0.35, 0.1, 0.05, 0.03, 0.02, 0.05]))], texts[int(r.integers(0, 10))]) for _ in range(n)]


CONV = "conv_id long, turn long, role string, text string, copy string, here string, audit string"


@pytest.fixture(scope="module")
def talks(spark):
    rows = [(c, *t, "x", "y", "z") for c in range(150) for t in talk(c, c % 9 + 1)]
    rows += [(None, *t, None, None, None) for t in talk(999, 6)] + rows[:7]
    return rows, spark.createDataFrame(rows, CONV).repartition(3)


def test_repair_is_the_cheapest(talks):
    rows, df = talks
    want: dict = defaultdict(list)
    for r in rows:
        want[r[0]].append(r[1:4])
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(df).collect()}
    assert got == {c: by_hand(t)[:8] for c, t in want.items()}
    turns: dict = defaultdict(list)
    for r in sorted(conversations.repaired_turns(df).collect(), key=lambda r: r.position):
        turns[r.conv_id].append((r.role, r.text))
    assert {c: tuple(t) for c, t in turns.items()} == {c: by_hand(t)[8] for c, t in want.items() if by_hand(t)[8]}


def test_damage_is_the_contract(talks, spark, sf):
    rows, df = talks
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    for own, frame in (([r[:4] for r in rows], df), ([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()], given)):
        got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(conversations.damage(frame), present="present").collect()}
        assert got == {c: by_hand(t)[:8] for c, t in damaged(own).items()}


def test_giant_conversations_spill(spark, monkeypatch):
    """Backpointers in blocks of 7 rows give the edits that one block gives; rows arrive in batches of 10."""
    rows = [t for k in range(60) for t in [(k * 3 + i, *x[1:]) for i, x in enumerate(talk(k, 3))]]
    want = by_hand(rows)[:8]
    monkeypatch.setattr(conversations, "SPILL_ROWS", 7)
    a = conversations.Automaton()
    stream, seen = conversations.Stream(a, 1), set()
    ordered = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0], r[1], r[2]))
    for turn, role, text in ordered:
        stream.row(turn, role.encode(), text.encode(), (role, text) in seen)
        seen.add((role, text))
    assert stream.blocks > 20 and stream.result()[1:] == want
    monkeypatch.undo()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df = spark.createDataFrame([(1, *r) for r in rows], "conv_id long, turn long, role string, text string")
        assert [tuple(r)[1:] for r in conversations.repair(df).collect()] == [want]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_automaton_is_small():
    a = conversations.Automaton()
    todo, seen = [conversations.BEGIN], set()
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += [a.steps[a.step(v, k)][0] for k in a.edits]
    assert len(a.steps) < 20_000


def test_no_rows_and_dropped_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.repair(spark.createDataFrame([], schema)).count() == 0
    assert conversations.repair(conversations.damage(spark.createDataFrame([], schema)), present="present").count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = conversations.damage(spark.createDataFrame([(gone, 0, "user", "Hello.")], schema))
    assert [tuple(r) for r in conversations.repair(df, present="present").collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# decontamination


def text_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leak_rows():
    r = np.random.default_rng(5)
    vocab = [f"w{k}" for k in range(40)] + ["é", "Σ", "漢字"]
    prose = lambda n: " ".join(vocab[k] for k in r.integers(0, len(vocab), n))
    items = [(k, prose(int(r.integers(0, 35)))) for k in range(25)]
    items += [(100, "w1 w2"), (101, "w3"), (102, items[3][1]), (3, items[4][1]), (None, prose(12)), (103, None), (104, ",;"), items[5], (105, "w7 " * 30)]
    docs = [(k, prose(int(r.integers(0, 60)))) for k in range(60)]
    docs += [(60 + k, prose(9) + "\n" + (items[k % 30][1] or "").upper().replace(" ", "--") + " " + prose(7)) for k in range(60)]
    docs += [(200, None), (None, items[6][1]), (201, "W7! " * 50), docs[70], docs[70], (202, prose(20_000)), (203, ""), (204, "WW1 w")]
    return docs, items


def leaks_by_hand(docs, items, window=10):
    own: dict = defaultdict(set)
    for i, t in items:
        w = text_words(t)
        for k in range(max(1, len(w) - window + 1)):
            if w:
                own["" if i is None else str(i)].add(tuple(w[k : k + window]))
    windows: dict = defaultdict(set)
    for i, ws in own.items():
        for w in ws:
            windows[w].add(i)
    sizes = {len(w) for w in windows}
    out = Counter()
    for d, t in docs:
        w, hit, names = text_words(t), set(), set()
        for k in range(len(w)):
            for n in sizes:
                if k + n <= len(w) and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        out[d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("params", [LeakParams(), LeakParams(shard_words=100, block_bytes=500), LeakParams(window=3)])
def test_contamination(spark, params):
    docs, items = leak_rows()
    d = spark.createDataFrame([(*x, "a", 1) for x in docs], "doc_id long, text string, spans string, n_words int").repartition(3)
    i = spark.createDataFrame([(*x, "b") for x in items], "item_id long, text string, doc_id string")
    got = Counter(tuple(r) for r in decontaminate.contamination(d, i, params).collect())
    want = leaks_by_hand(docs, items, params.window)
    assert got == want
    kept = decontaminate.remove_leaks(d, i, params)
    assert kept.columns == d.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({k[0]: n for k, n in want.items() if not k[-1]})


@pytest.mark.parametrize("shard", [1_000_000, 300])
def test_longest_matches(spark, shard):
    docs, items = leak_rows()
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    split = [(k if k is not None else decontaminate.LAST, text_words(t)) for k, t in docs]
    places: dict = defaultdict(list)
    for doc, w in split:
        for k, x in enumerate(w):
            places[x].append((doc, w, k))
    for item, t in items:
        w = text_words(t)
        for k in range(len(w)):
            for doc, dw, at in places[w[k]]:
                n = 1
                while k + n < len(w) and at + n < len(dw) and w[k + n] == dw[at + n]:
                    n += 1
                name = "" if item is None else str(item)
                want[name] = max(want.get(name, (0,)), (n, -doc, -k, -at))
    got = {r.item_id: (r.n_words, -(decontaminate.LAST if r.doc_id is None else r.doc_id), -r.item_start, -r.doc_start) for r in decontaminate.longest_matches(d, i, LeakParams(shard_words=shard)).collect()}
    assert got == want


def test_suffixes_are_sorted():
    r = np.random.default_rng(3)
    for letters in (1, 2, 5):
        x = np.append(r.integers(0, letters + 1, 400), 0)
        array = SuffixArray(x, int(letters).bit_length() + 20, 400)
        suffixes = ["".join(map(chr, x[k : k + list(x[k:]).index(0)])) for k in array.sa]
        assert sorted(array.sa.tolist()) == np.flatnonzero(x).tolist() and suffixes == sorted(suffixes)


def test_no_items_and_no_documents(spark):
    docs, items = leak_rows()
    d, i = spark.createDataFrame(docs[:9], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert [tuple(r)[2:] for r in decontaminate.contamination(d, i.limit(0)).collect()] == [(0, 0, hashlib.sha256(b"").hexdigest(), False)] * 9
    assert decontaminate.contamination(d.limit(0), i).count() == decontaminate.longest_matches(d.limit(0), i).count() == decontaminate.longest_matches(d, i.limit(0)).count() == 0
    assert Block([], 10).depth == 0


# periodic runs


def runs_by_hand(w: list, shortest: int = 12) -> list[tuple[int, int, int]]:
    """All runs by trying every period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        start = None
        for i in range(len(w) - q + 1):
            if i < len(w) - q and w[i] == w[i + q]:
                start = i if start is None else start
            elif start is not None:
                if i - start + q >= max(shortest, 2 * q):
                    found.setdefault((start, i + q), q)
                start = None
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic_texts() -> list[str | None]:
    r = np.random.default_rng(11)
    few = lambda n, k: [f"a{x}" for x in r.integers(0, k, n)]
    fib = ["b", "a"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    out = [few(int(n), k) for n in r.integers(0, 120, 40) for k in (1, 2, 3, 8)]
    out += [few(9, 90) + few(int(p), 90) * int(t) + few(4, 3) for p, t in zip(r.integers(1, 60, 30), r.integers(2, 6, 30))]
    block = few(7, 50) * 3 + ["x"]
    out += [list(fib[-1]), block * 4 + ["y"] + block * 5, ["z"] * 13, ["z"] * 12, ["z"] * 11, few(300, 2), few(700, 40) * 2 + few(5, 3)]
    return [" ".join(x) for x in out] + [None, "", " \t", "é\x0bé\x0cé é é é é é é\né é é é"]


def test_transform_is_exact():
    r = np.random.default_rng(2)
    for size in (1, 2, 8, 64):
        a, b = (r.integers(0, runs.PRIME, (3, size)).astype(np.uint64) for _ in "ab")
        assert (runs.transform(runs.transform(a), inverse=True) == a).all()
        product = runs.transform(runs.transform(a) * runs.transform(b) % np.uint64(runs.PRIME), inverse=True)
        for row in range(3):
            for k in range(size):
                assert int(product[row, k]) == sum(int(a[row, j]) * int(b[row, (k - j) % size]) for j in range(size)) % runs.PRIME


@pytest.mark.parametrize("chunk", [500_000, 200])
def test_runs(spark, chunk):
    texts = periodic_texts()
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, texts[3], "y", 2), (5, texts[5], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, period int").repartition(2)
    got = Counter()
    for r in runs.find_runs(df, runs.RunParams(chunk_words=chunk), text=True, digests=True).collect():
        got[r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed_text, r.runs_sha256, r.collapsed_sha256] += 1
    want = Counter()
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        own = runs_by_hand(w)
        gone = {i for s, n, q in own for i in range(s + q, s + n)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[d, len(w), tuple(own), kept.decode(), hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest(), hashlib.sha256(kept).hexdigest()] += 1
    assert got == want
    assert runs.find_runs(df.limit(0)).count() == 0


@pytest.mark.parametrize("shortest", [1, 2, 5, 30])
def test_runs_of_other_lengths(shortest):
    r = np.random.default_rng(shortest)
    for letters in (1, 2, 4):
        for n in (1, 2, 7, 50, 180):
            x = r.integers(0, letters, n)
            s, e, q = runs.find(x, n, shortest)
            assert sorted(zip(s.tolist(), (e - s).tolist(), q.tolist())) == runs_by_hand(x.tolist(), shortest)


def test_long_runs_take_little_time():
    import time

    for x in (np.zeros(300_000, dtype=np.int64), np.tile(np.arange(777), 300), np.random.default_rng(1).integers(0, 3, 200_000)):
        start = time.perf_counter()
        runs.find(x, len(x), 12)
        assert time.perf_counter() - start < 60


def test_run_query_is_the_contract(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter(F.length("text") < 12_000).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    some = 0
    for d in docs:
        w = (d.text or "").encode().split()
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        own = runs_by_hand(w)
        some += bool(own)
        best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        gone = {i for s, m, q in own for i in range(s + q, s + m)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.n_words) == (len(own), *best, n)
        assert r.exponent_milli == (1000 * best[1] // best[2] if own else None)
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in own).encode()).hexdigest()
    assert some > 5
