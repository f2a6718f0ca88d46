"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeloom.llm import bpe, mixing, quality, sharding, simhash, substrings, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, size long, h long, chunk string, fp string"
WORDS = "the of and to in is that for was on are with as by at be this from or an it not but".split()


def passage(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(f"{WORDS[a]}{b}" if b % 3 else WORDS[a] for a, b in zip(r.integers(0, len(WORDS), n), r.integers(0, 50, n)))


def rows() -> list[tuple]:
    shared = passage(1, 60)
    texts = [
        None, "", "   \n\t ", "one", "one two", shared, shared, passage(2, 30) + " " + shared + "\n" + passage(3, 25), passage(4, 15) + "\r\n" + shared, "Σίσυφος É\x1cx <|endoftext|> it's 12",
        ("again and again " * 200).strip(), passage(5, 9000), "a\x0bb\x0cc\x85d\xa0e", passage(6, 19), passage(7, 20), "#*$ %&|\n<> #*$\n#*$ %&|", "漢字 かな 👍🏽 é", *(passage(8 + k, 120) for k in range(30)),
    ]
    out = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "é"][i % 4], 0, 7, 7, "x", "y") for i, t in enumerate(texts)]
    return out + [out[5], out[7], (None, shared, "en", "a", 0, 7, 7, "x", "y"), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_bpe_is_the_library(docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True, decoded=True, digests=True).collect()
    want = Counter()
    for d in rows():
        ids = t.encode(d[1] or "", add_special_tokens=False).ids
        want[d[0], tuple(ids), t.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_bpe_decodes_what_it_encoded(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.encode_documents(docs, path, decoded=True)
    assert Counter(map(tuple, bpe.decode_documents(encoded, path).collect())) == Counter((r.doc_id, r.decoded) for r in encoded.collect())


def test_bpe_table_stays_bounded():
    vocab = bpe.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    small, large = bpe.Encoder(vocab, limit=4000), bpe.Encoder(vocab)
    texts = [passage(k, 40) for k in range(20)] + ["aaaaaaa", "abababab"]
    assert [x for t in texts for x in small.batch([t])] == list(large.batch(texts))
    assert len(small.ids) < len(large.ids) / 3


def test_bpe_of_every_code_point():
    """Ids of each code point alone, between letters and after marks are the library's, and those of mixed rare ones."""
    path = public_tokenizers.path("word_bpe_49k.json")
    t, encoder = Tokenizer.from_file(path), bpe.Encoder(bpe.vocabulary(path))
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"{x} A{x}b {x}\u0301{x}" for x in points[k : k + 64]) for k in range(0, len(points), 64)]
    r = np.random.default_rng(6)
    texts += ["".join(points[k] for k in r.integers(0, len(points), 30)) for _ in range(1500)] + ["".join(points[k] + " "[: int(k) % 3 == 0] for k in r.integers(0, 0x3000, 40)) for _ in range(1500)]
    for text, (ids, decoded) in zip(texts, encoder.batch(texts)):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want
        assert decoded == t.decode(want, skip_special_tokens=False)


def test_no_merge_makes_an_earlier_rank():
    """Ascending ranks over many words agree with word by word only then."""
    merges = bpe.vocabulary(public_tokenizers.path("word_bpe_49k.json")).merge
    first_use: dict[int, int] = {}
    for r, (a, b, _) in enumerate(merges):
        first_use.setdefault(a, r), first_use.setdefault(b, r)
    assert all(first_use.get(c, r + 1) > r for r, (_, _, c) in enumerate(merges))


@pytest.mark.parametrize("params", [{}, {"rows_per_range": 3, "per_part": 2}, {"max_ranges": 1}])
def test_sharding(docs, params):
    got = sharding.assign_shards(docs, **params).collect()
    data = [((d[1] or ""), d[0]) for d in rows()]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for t, i in data)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in {r.shard for r in got}:
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 40) <= largest
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and all(0 <= r.shard < 40 for r in got)
    key = lambda t, i: (int(hashlib.md5(t.encode()).hexdigest()[:15], 16), -(2**63) if i is None else i)
    before, want = 0, Counter()
    for t, i in sorted(data, key=lambda x: key(*x)):
        size = len(t.encode()) + 16
        want[i, size, min(39, (2 * before + size) * 40 // (2 * total))] += 1
        before += size
    assert Counter((r.doc_id, r["size"], r.shard) for r in got) == want


def test_sharding_hot_text(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    per = sharding.assign_shards(hot, rows_per_range=50, per_part=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(per) == 40 and max(r.b for r in per) - min(r.b for r in per) <= 2 * 29


def test_ranges_beside_a_giant_and_a_hot_key(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("key"), "id", (F.col("id") % 997 + 16).alias("size"), F.lit(1).alias("n"))
    giant = keys.withColumn("size", F.when(F.col("id") == 7, F.lit(10**12)).otherwise(F.col("size")))
    hot = keys.withColumn("key", F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("key")).cast("long"))
    for table in (keys, giant, hot):
        total = table.agg(F.sum("size")).first()[0]
        ranged, bases = sharding.cut_ranges(table, 20_000, total, min_ranges=40, rows_per_range=2_000_000, max_ranges=8192, per_part=64)
        sizes = ranged.groupBy("r").agg(F.count("*").alias("keys"), F.sum("size").alias("bytes")).collect()
        assert all(x["keys"] == 1 or x["keys"] <= 2 * 500 and x["bytes"] <= 2 * total / 40 for x in sizes)
        assert bases.count() == len(sizes) <= 200


def test_sharding_of_equal_rows_and_long_texts(spark):
    """A third of all rows are one row; some texts hold most bytes: shards stay near equal and slots gapless."""
    rows = [(7, "the same row")] * 4000 + [(k, f"t{k}") for k in range(6000)] + [(10_000 + k, "long " * 2000) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for params in ({}, {"rows_per_range": 50, "per_part": 4}):
        got = sharding.assign_shards(docs, **params).collect()
        assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(t) + 16) for i, t in rows)
        size, slots = Counter(), {}
        for r in got:
            size[r.shard] += r["size"]
            slots.setdefault(r.shard, []).append(r.slot)
        assert len(size) == 40 and max(size.values()) - min(size.values()) <= 2 * 10_016
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_write_shards(spark, tmp_path):
    """Null and repeated ids, equal rows and columns of clashing names are all written, in slot order."""
    rows = [(None, "a", 1, 5), (None, "b", 2, 5), (3, "c", 3, 5), (3, "c", 3, 5), (3, "d", 4, None)] + [(k, f"t{k}", k, k) for k in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot int")
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert Counter((r.doc_id, r.text, r.shard_, r.slot_) for r in got) == Counter(rows)
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_mix_of_repeats_and_clashing_names(spark):
    rows = [(1, "a b", "x", 9.0), (1, "a b", "x", 9.0), (1, "a b", "x", 8.0), (None, "c d", "x", 7.0), (None, "e f", None, 7.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, position double")
    out = mixing.mix(docs)
    got = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    taken = mixing.plan_mix(docs).agg(F.sum("copies")).first()[0]
    assert out.columns == ["doc_id", "text", "source", "position"] and sum(got.values()) == taken
    assert got[1, "a b", "x"] % 3 == 0 or got[1, "a b", "x"] <= 9


def brute_repeats(data: list[tuple], window: int) -> Counter:
    seen, out = set(), Counter()
    for doc_id, text in sorted(data, key=lambda d: (d[0] is None, d[0] or 0, d[1] or "")):
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        out[doc_id, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("params", [{}, {"chunk_bytes": 500, "group_suffixes": 50, "buckets": 8}, {"window": 3, "chunk_bytes": 2000}, {"window": 1}])
def test_substrings(docs, params):
    p = substrings.RepeatParams(**params)
    got = substrings.remove_repeats(docs, p, spans=True, texts=True, carry=("lang", "chunk")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats([d[:2] for d in rows()], p.window)
    for r in got:
        assert sum(s.end - s.start for s in r.removed_spans) == r.n_removed
        assert len(words(r.kept_text)) == r.n_words - r.n_removed and r.chunk in ("x", None)


@pytest.mark.parametrize("params", [{"window": 3}, {"window": 20, "group_suffixes": 2000}])
def test_substrings_of_equal_prints(docs, params):
    """With a hash of one byte very many windows look alike: what is removed is still exact."""
    p = substrings.RepeatParams(chunk_bytes=500, print_bytes=1, **params)
    got = substrings.remove_repeats(docs, p).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats([d[:2] for d in rows()], p.window)


@pytest.mark.parametrize("limit", [50, 400, 100_000])
def test_substring_groups_fit(limit):
    """However skewed the prefixes, no group holds more leaves than it may, but for windows that are equal."""
    r = np.random.default_rng(9)
    text = b" ".join(b"the" if x < 3 else b"w%d" % x for x in r.zipf(1.3, 20_000).clip(max=10**6).tolist())
    hot = b"one long sentence that starts every second text of this corpus and so has very many suffixes under one prefix and goes on "
    texts = [text] + [hot + b"%d " % k + b" ".join(b"x%d" % x for x in r.integers(0, 10**9, 30)) for k in range(300)]
    params = substrings.RepeatParams(group_suffixes=limit, buckets=512)
    words = substrings.Words(pa.array([t.decode() for t in texts]))
    starts, levels = words.starts(20), list(words.prefixes(20))
    counts = {n: np.bincount((h[starts] % np.uint64(512)).astype(np.int64), minlength=512) for n, h in levels if n < 20}
    prefixes = substrings.Prefixes.of(counts, len(starts), params)
    first, _, _ = substrings.first_and_later(levels[-1][1][starts], starts)
    group = prefixes.groups_of(levels, first, 20)
    assert group.min() >= 0 and group.max() < prefixes.groups
    assert np.bincount(group).max() <= limit


def test_substring_order_of_null_and_largest_id(spark):
    """A null id comes after the largest id there is, wherever the two lie."""
    docs = spark.createDataFrame([(None, passage(3, 40)), (2**63 - 1, passage(3, 40)), (5, passage(4, 400))], "doc_id long, text string")
    for chunk in (10, 10**6):
        got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs, substrings.RepeatParams(chunk_bytes=chunk)).collect()}
        assert got == {None: 40, 2**63 - 1: 0, 5: 0}


def test_quality_base(docs):
    got = quality.quality_rules(docs)
    want = Counter()
    for d in rows():
        text, w = d[1] or "", words(d[1])
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        tri = Counter(zip(w, w[1:], w[2:]))
        inside = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for j in range(3)}
        want[d[0], len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)] += 1
    assert Counter(tuple(r) for r in got.drop("kept", "class_distance", "word_distance", "marks_distance").collect()) == want
    assert got.filter("base_failed AND kept").count() == 0
    assert quality.keep_good(docs).count() == got.filter("kept").count() > 0


def test_quality_distance():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.5, 0.5])
    assert quality.js_distance(p, p) == 0 and quality.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1
    assert abs(quality.js_distance(p, q) ** 2 - 0.5) < 1e-12


def test_quality_on_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    both = quality.quality_rules(docs).filter("NOT base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good, bad = both.filter("quality = 1"), both.filter("quality = 0")
    assert good.filter("kept").count() >= 0.99 * good.count()
    assert bad.filter("NOT kept").count() >= 0.8 * bad.count()


def brute_components(prints: list[tuple], radius: int) -> dict:
    ids = [2**63 - 1 if i is None else i for i, _ in prints]
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least: dict[int, int] = {}
    for k in range(len(prints)):
        least[find(k)] = min(least.get(find(k), 2**63), ids[k])
    return Counter((prints[k][0], f"{prints[k][1]:016x}", None if least[find(k)] == 2**63 - 1 else least[find(k)]) for k in range(len(prints)))


def test_simhash_fingerprint():
    assert simhash.fingerprint("", 3) == 0
    for text in ("One TWO", "a b c d É", "x " * 40):
        w = text.encode().lower().split() if text.isascii() else "a b c d É".encode().translate(simhash.ASCII_LOWER).split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert simhash.fingerprint(text, 3) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("cap", [256, 1])
def test_simhash(docs, cap):
    got = simhash.near_duplicates(docs, list_cap=cap)
    prints = [(d[0], simhash.fingerprint(d[1] or "", 3)) for d in rows()]
    assert Counter(map(tuple, got.collect())) == brute_components(prints, 2)


@pytest.mark.parametrize(("radius", "cap"), [(2, 256), (2, 2), (4, 256), (4, 3), (0, 2)])
def test_simhash_links_of_a_ball(spark, radius, cap):
    """Fingerprints around a few centres: chains and long lists."""
    r = np.random.default_rng(3)
    centres = [int(x) for x in r.integers(0, 2**63, 4)]
    prints = list({c ^ sum(1 << int(b) for b in r.choice(64, int(n), replace=False)) for c in centres for n in r.integers(0, 6, 60)})
    data = [(k, p - 2**64 if p >= 2**63 else p) for k, p in enumerate(prints)]
    nodes = spark.createDataFrame(data, "node long, fp long")
    roots = dict(map(tuple, simhash.connected_components(simhash.fingerprint_links(nodes, radius, cap)).collect()))
    got = Counter((k, f"{p:016x}", roots.get(k, k)) for k, p in enumerate(prints))
    assert got == brute_components(list(enumerate(prints)), radius)


def test_postings_and_midpoints_are_not_broadcast(spark, tmp_path):
    """Files of a few fingerprints look small to Spark, what is exploded from them isn't."""
    r = np.random.default_rng(4)
    centre = int(r.integers(0, 2**62))
    prints = {int(x) for x in r.integers(0, 2**62, 1000)} | {centre ^ sum(1 << int(b) for b in r.choice(62, 3, replace=False)) for _ in range(60)}
    spark.createDataFrame(list(enumerate(prints)), "node long, fp long").write.parquet(f"{tmp_path}/nodes")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "512k")
    try:
        links = simhash.fingerprint_links(spark.read.parquet(f"{tmp_path}/nodes"), 4, 5).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    roots = dict(map(tuple, simhash.connected_components(spark.createDataFrame(links)).collect()))
    got = Counter((k, f"{p:016x}", roots.get(k, k)) for k, p in enumerate(prints))
    assert got == brute_components(list(enumerate(prints)), 4)


def test_rows_of_fingerprints_are_not_broadcast(spark):
    docs = spark.createDataFrame([(k, f"a b c {k % 7}", k) for k in range(50)], "doc_id long, text string, row_key long")
    for out in (simhash.near_duplicates(docs), simhash.surplus(docs, "row_key")):
        assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 0


def test_mix_does_not_broadcast_its_plan(spark):
    docs = spark.createDataFrame([(k, "a b c", "x") for k in range(50)], "doc_id long, text string, source string")
    assert "BroadcastExchange" not in mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()


def test_simhash_of_the_largest_id(spark):
    """The largest id isn't taken for a null one."""
    docs = spark.createDataFrame([(2**63 - 1, "a b c d e"), (None, "a b c d e"), (2**63 - 1, "x y z"), (None, "other words here")], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == {(2**63 - 1, 2**63 - 1): 2, (None, 2**63 - 1): 1, (None, None): 1}


def test_components_of_a_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = simhash.connected_components(chain.unionByName(spark.createDataFrame([(900, 901), (901, 901)], "a long, b long"))).collect()
    assert {(r.node, r.root) for r in got} == {(k, 0) for k in range(1, 201)} | {(901, 900)}


def brute_targets(sizes: dict, weights=(5, 2, 1)) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= set(over)
    return target


def test_mixing(docs):
    plan = mixing.plan_mix(docs).join(docs.select("doc_id").distinct(), "doc_id", "left").collect()
    sizes, largest = Counter(), Counter()
    for d in rows():
        sizes[d[3]] += len(words(d[1]))
        largest[d[3]] = max(largest[d[3]], len(words(d[1])))
    want = brute_targets(dict(sizes))
    assert len(plan) == len(rows())
    by_target = {round(t, 6): s for s, t in want.items()}
    taken = Counter()
    for r in plan:
        s = by_target[round(r.target, 6)]
        assert r.source_size == sizes[s] and r.taken == r.copies * r["size"] <= 3 * r["size"] and len(r.positions) == r.copies
        assert list(r.positions) == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    assert Counter(map(str, plan)) == Counter(map(str, mixing.plan_mix(docs.repartition(3)).collect()))


def test_mixing_follows_the_schedule(spark):
    """Of a source whose weight falls, the first half of training gets more than the second, as the integral says."""
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("source"))
    early = mixing.mix(docs).groupBy("source").agg(F.avg((F.col("position") < 0.5).cast("int")).alias("e")).collect()
    got = {r.source: r.e for r in early}
    assert abs(got["a"] - 0.625) < 0.02 and abs(got["b"] - 0.5) < 0.02 and abs(got["c"] - 0.375) < 0.02


def test_token_sections(docs):
    import tiktoken  # noqa: F401

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoder, size = token_counts.encoding(path, pattern).parts, token_counts.encoding(path, pattern).size
    for rule in token_counts.RULES:
        got = token_counts.section_tokens(docs, path, pattern, rule).collect()
        per: dict = {}
        for r in got:
            per.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        assert sum(r.n_tokens for r in got) == sum(len(encoder.encode_ordinary(d[1] or "")) for d in rows())
        for d in rows():
            text = d[1] or ""
            ids = encoder.encode_ordinary(text)
            lines = text.split("\n")
            lines = [x + "\n" for x in lines[:-1]] + lines[-1:] * (lines[-1] != "" or len(lines) == 1)
            want, ends = [0] * len(lines), np.cumsum([len(x.encode()) for x in lines])
            at = 0
            for i in ids:
                inside = [max(0, min(at + size[i], e) - max(at, s)) for s, e in zip([0, *ends[:-1]], ends)]
                k = {"first": min(n for n, x in enumerate(inside) if x), "last": max(n for n, x in enumerate(inside) if x), "majority": int(np.argmax(inside))}[rule]
                want[k] += 1
                at += size[i]
            mine = sorted((r.section, r.n_tokens, r.char_end - r.char_start) for r in per[d[0], len(ids)])
            once = [(k, n, len(x)) for k, (n, x) in enumerate(zip(want, lines))]
            assert set(mine) >= set(once)


def test_token_counts_of_long_white_space(spark):
    """Five million spaces, line feeds or letters don't stop the encoder, and shorter runs are cut as the pattern cuts them."""
    e = token_counts.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for run in (" " * 20_000, "\n" * 20_000, " \t" * 10_000 + "\n", "\u3000" * 12_000):
        for text in (run, "a" + run, run + "b", "a b" + run + "c" + run + "'s", run + "\n x" + run + "  "):
            assert e.encode(text) == e.parts.encode_ordinary(text)
    n = 5_000_000
    rows = [(1, "a" + " " * n + "b"), (2, "a" * n)]
    got = token_counts.section_tokens(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id, r.char_end) for r in got) == [(1, n + 2), (2, n)] and all(r.n_tokens == r.doc_tokens > 0 for r in got)
    assert sum(x for x in e.size[e.encode("\n" * n)]) == n


def test_token_fields(spark):
    docs = spark.createDataFrame([(1, "title", "body\nmore"), (2, None, "x"), (3, None, None)], "doc_id long, title string, body string")
    got = token_counts.section_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, fields=("title", "body")).collect()
    assert sorted((r.doc_id, r.field, r.section, r.char_start, r.char_end) for r in got) == [(1, 0, 0, 0, 6), (1, 1, 1, 6, 11), (1, 1, 2, 11, 15), (2, 0, 0, 0, 1), (2, 1, 1, 1, 2), (3, 0, 0, 0, 1), (3, 1, 1, 1, 1)]


def test_empty_tables(empty):
    vocab = public_tokenizers.path("word_bpe_49k.json")
    assert bpe.encode_documents(empty, vocab).count() == 0
    assert sharding.assign_shards(empty).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
    assert quality.quality_rules(empty).count() == 0 and quality.keep_good(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert token_counts.section_tokens(empty, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def foreign_rows() -> list[tuple]:
    """200 English documents, 30 clean ones in each of four other scripts, and one of marks in a rare language."""
    letters = {"ru": "абвгдежзиклмнопрстуя", "el": "αβγδεζηθικλμνοπρστυω", "vi": "aăâeêioôơuưyđbcghệồợ", "zh": "的一是不了人我在有他这为之大来以个中上们"}
    out = [("en", passage(1000 + k, 150)) for k in range(200)]
    for lang, own in letters.items():
        for k in range(30):
            r = np.random.default_rng(k)
            out.append((lang, " ".join("".join(own[c] for c in r.integers(0, 20, 6)) for _ in range(120))))
    out.append(("xx", " ".join(f"{w}$$$" for w in passage(77, 150).split())))
    return [(k, text, lang) for k, (lang, text) in enumerate(out)]


def test_quality_keeps_other_scripts(spark):
    """Clean documents of languages with few documents stay, whatever their script; marks don't."""
    docs = spark.createDataFrame(foreign_rows(), "doc_id long, text string, lang string")
    kept = Counter(r.lang for r in quality.keep_good(docs).collect())
    assert [kept[x] for x in ("en", "ru", "el", "vi", "zh", "xx")] == [200, 30, 30, 30, 30, 0]
    assert quality.quality_rules(docs).filter("kept").count() == sum(kept.values())


def test_quality_references_beyond_those_held(spark):
    """Every language has its reference, held by the tasks or joined."""
    docs = spark.createDataFrame(foreign_rows(), "doc_id long, text string, lang string")
    whole, few = quality.fit_references(docs), quality.fit_references(docs, max_langs=2)
    assert len(whole.own) == 5 and whole.more is None and len(few.own) == 2 and few.more.count() == 3
    verdicts = [Counter(map(str, quality.judge(docs, x).collect())) for x in (whole, few)]
    assert verdicts[0] == verdicts[1] and sum(verdicts[0].values()) == docs.count()


def plain_class(x: str) -> str:
    import unicodedata

    c = ord(x)
    if x in ".,;:?!'\"()-‘’“”–—…«»、。，．：；！？「」،؛؟।":
        return "sentence mark"
    if c < 0x250 and (x.isspace() or x.isalpha()):
        return "space" if x.isspace() else "upper" if x.isupper() else "lower"
    kind = unicodedata.category(x)[0]
    if kind in "LM":
        return next((s for s, ranges in quality.SCRIPTS.items() for a, b in ranges if a <= c <= b), "other script")
    return "other mark" if x in "$+<=>^`|~" else {"P": "other mark", "S": "symbol", "C": "control", "Z": "space", "N": "digit"}[kind]


def plain_words(text: str) -> list[str]:
    if 2 * sum(plain_class(x) in ("han", "kana", "thai", "khmer") for x in text) > len(text):
        return [x for x in text if plain_class(x) not in quality.COMMON]
    low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text)
    return "".join(x if "a" <= x <= "z" or ord(x) >= 128 else " " for x in low).replace("\x85", "\x85").split(" ")


def plain_js(p: dict, q: dict) -> float:
    total = 0.0
    for k in set(p) | set(q):
        a, b = p.get(k, 0.0), q.get(k, 0.0)
        total += sum(x * np.log2(2 * x / (a + b)) / 2 for x in (a, b) if x)
    return max(0.0, total) ** 0.5


def test_quality_verdicts_are_those_of_the_definition(spark):
    """kept and all distances against a computation with plain dictionaries."""
    r = np.random.default_rng(12)
    data = [(i, t, lang) for i, t, lang in foreign_rows() if i % 2 or i > 300]
    data += [(1000 + k, passage(2000 + k, 120) + ["", " %^&* ~~~ " * 20, " ÀÉ “quoted” — text… 🎉🎉", " SHOUTING" * 30][k % 4] + chr(0x4E00 + k), ["en", "fr", None][k % 3]) for k in range(40)]
    data += [(2000 + k, "".join(chr(0x4E00 + int(x)) for x in r.integers(0, 60, 150)) + "。", "zh") for k in range(12)]
    got = {x.doc_id: x for x in quality.quality_rules(spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4)).collect()}
    unit, marks = quality.SCALE, ("other mark", "symbol", "control")
    classes, words, n_docs = {}, {}, Counter()
    for _, text, lang in data:
        c = Counter(map(plain_class, text))
        if sum(c[x] for x in marks) > 0.05 * len(text) or c["upper"] > 0.15 * len(text):
            continue
        n_docs[lang] += 1
        w = [x for x in plain_words(text) if x]
        for k, x in c.items():
            classes.setdefault(lang, Counter())[k] += (x * unit + len(text) // 2) // len(text)
        for k, x in Counter(w).items():
            words.setdefault(lang, Counter())[k] += (x * unit + len(w) // 2) // len(w)
    all_ = sum(classes.values(), Counter())
    mean = sum(all_[x] for x in marks) / sum(all_.values())
    verdicts = Counter()
    for doc_id, text, lang in data:
        c, w, n = Counter(map(plain_class, text)), [x for x in plain_words(text) if x], n_docs[lang]
        own = {k: x / sum(classes[lang].values()) for k, x in classes[lang].items()} if n else None
        mine = max(mean, sum(c[x] for x in marks) / len(text))
        by_marks = plain_js({0: mine, 1: 1 - mine}, {0: mean, 1: 1 - mean}) if len(text) >= 200 else None
        by_class = plain_js({k: x / len(text) for k, x in c.items()}, own) if n and len(text) >= 200 else None
        by_word = None
        if n and len(w) >= 80:
            top = dict(sorted(words[lang].items(), key=lambda x: (-x[1], x[0].encode()))[:64])
            ref = {k: x / (n * unit) for k, x in top.items()}
            ref[None] = max(0.0, 1 - sum(ref.values()))
            ref = {k: x / sum(ref.values()) for k, x in ref.items()}
            have = Counter(x if x in top else None for x in w)
            by_word = plain_js({k: x / len(w) for k, x in have.items()}, ref)
        x = got[doc_id]
        for mine_, theirs in ((by_class, x.class_distance), (by_word, x.word_distance), (by_marks, x.marks_distance)):
            assert (mine_ is None) == (theirs is None) and (mine_ is None or abs(mine_ - theirs) < 1e-6)
        wide = n**-0.5 if n else 0
        limit = 0.16 + 1.3 / len(text) ** 0.5
        far = (by_class or 0) > limit + wide or (by_word or 0) > 0.15 + 4 / len(w) ** 0.5 + wide or (by_marks or 0) > limit
        assert x.kept == (not x.base_failed and not far)
        verdicts[x.kept] += 1
    assert verdicts[True] > 50 and verdicts[False] > 5


def test_token_counts_of_many_runs_of_white_space():
    """Runs below, at and above the length from which they are encoded apart; many long ones take time in proportion."""
    import time

    encoder = token_counts.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for n in (1, 2, 98, 99, 100, 101, 102, 250):
        for run in (" " * n, "\n" * n, " \n\t" * n, "\u3000" * n):
            for text in (run, "a" + run, run + "b", f"a{run}b {run}\n'll{run}", f"1{run}é{run}."):
                assert encoder.encode(text) == encoder.parts.encode_ordinary(text)
    start = time.perf_counter()
    assert len(encoder.encode(("x" + " " * 9_999) * 100)) > 100
    assert time.perf_counter() - start < 5
