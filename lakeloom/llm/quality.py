"""Quality rules: divergence of a document's histograms from its language's reference.

A first pass over all documents gathers, for each language, the mean character-class histogram (letters by
script, cases, digits, white space, sentence marks, other marks, symbols, controls) and the mean histogram of its
most common words; every document weighs the same, however long it is, but those whose marks or capitals pass a
plain bound give nothing, so that junk doesn't shape the reference. A second pass compares each document with the
reference of its language by Jensen-Shannon distance and applies plain base rules. Documents under a minimum length
are not judged by a histogram. In scripts that don't part words, each letter is a word.

The fewer documents a language has, the less its reference says: the distance allowed widens with one over the
root of their number, so nothing changes at a number of documents. Whatever its language, a document is also held
against the share of marks, symbols and controls of all documents, from above, as that is the same in every script.

Sums are of integers (millionths of a document), so they don't depend on the order of rows.

Each pass is narrow. Between them only sums by (language, key) are shuffled, combined on the map side;
the references have a fixed number of entries a language. Those of the ``MAX_LANGS`` commonest languages reach
every task; those of further ones, each with a small part of the documents, stay a table that is joined to
their documents.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, map_batches, materialize, release, text_or_empty

SYMBOLS = "#*$%&|<>"
#: Character classes of the histogram, in order: those of all scripts, then letters by script.
COMMON = ("lower", "upper", "digit", "space", "sentence mark", "other mark", "symbol", "control")
#: Fixed values of Unicode: the scripts told apart, with the code points where their letters begin and end.
SCRIPTS = {
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F)], "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "indic": [(0x900, 0xDFF)], "thai": [(0xE00, 0xEFF)], "georgian": [(0x10A0, 0x10FF)], "ethiopic": [(0x1200, 0x139F)], "khmer": [(0x1000, 0x109F), (0x1780, 0x17FF)], "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)], "han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
CLASSES = (*COMMON, *SCRIPTS, "other script")
MARKS = tuple(CLASSES.index(x) for x in ("other mark", "symbol", "control"))  # no script has much of these
UNPARTED = tuple(CLASSES.index(x) for x in ("han", "kana", "thai", "khmer"))  # scripts that don't part words
#: Languages whose references every task holds.
MAX_LANGS = 200
#: What a document weighs in sums.
SCALE = 1 << 20


@dataclass(frozen=True)
class QualityParams:
    top_words: int = 64
    #: A document gives to the reference up to these shares of other marks and of capitals.
    max_reference_marks: float = 0.05
    max_reference_capitals: float = 0.15
    #: Shorter documents are not judged by the character histogram, or by the word histogram.
    min_chars: int = 200
    min_words: int = 80
    #: Largest Jensen-Shannon distances (base 2, 0 to 1). They widen by ``slack / sqrt(n)`` for n characters
    #: or words, as short texts scatter more, and by ``reference_slack / sqrt(n)`` for n documents of the language.
    max_class_distance: float = 0.16
    class_slack: float = 1.3
    max_word_distance: float = 0.15
    word_slack: float = 4.0
    reference_slack: float = 1.0


def class_table(end: int = 0x30000) -> np.ndarray:
    """The class of each code point under end; the last entry stands for all above, which are Han."""
    at = {x: k for k, x in enumerate(CLASSES)}
    by_category = {"P": "other mark", "S": "symbol", "C": "control", "Z": "space", "N": "digit", "L": "other script", "M": "other script"}
    out = np.array([at[by_category[unicodedata.category(chr(c))[0]]] for c in range(end)], dtype=np.int64)
    for c in range(0x250):
        x = chr(c)
        if x.isspace() or x.isupper() or x.isalpha():
            out[c] = at["space" if x.isspace() else "upper" if x.isupper() else "lower"]
    letters = out == at["other script"]
    for script, ranges in SCRIPTS.items():
        for a, b in ranges:
            out[a : b + 1][letters[a : b + 1]] = at[script]
    for x in "$+<=>^`|~":
        out[ord(x)] = at["other mark"]
    for x in ".,;:?!'\"()-\u2018\u2019\u201c\u201d\u2013\u2014\u2026\u00ab\u00bb\u3001\u3002\uff0c\uff0e\uff1a\uff1b\uff01\uff1f\u300c\u300d\u060c\u061b\u061f\u0964":
        out[ord(x)] = at["sentence mark"]
    return out


CLASS_OF = class_table()
#: For the word histogram: A-Z to lower case, ASCII marks and digits to spaces.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def class_histogram(text: str, raw: bytes) -> np.ndarray:
    """raw: the text in UTF-8."""
    points = np.frombuffer(raw, dtype=np.uint8) if len(raw) == len(text) else np.minimum(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), len(CLASS_OF) - 1)
    return np.bincount(CLASS_OF[points], minlength=len(CLASSES))


def histogram_words(text: str, raw: bytes, classes: np.ndarray) -> list[bytes]:
    """The words of the word histogram; in a text that is mostly of scripts that don't part words, its letters."""
    if 2 * sum(classes[k] for k in UNPARTED) > len(text):
        return [x.encode() for x in text if CLASS_OF[min(ord(x), len(CLASS_OF) - 1)] >= len(COMMON)]
    return raw.translate(WORD_BYTES).split()


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance in base 2 of two histograms that each sum to 1."""
    m = (p + q) / 2

    def kl(x: np.ndarray) -> float:
        some = x > 0
        return float((x[some] * np.log2(x[some] / m[some])).sum())

    return float(np.sqrt(max(0.0, (kl(p) + kl(q)) / 2)))


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more in the text, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    many = np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= many
    return int(covered.sum())


def base_stats(text: str, raw: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = raw.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeats = repeat_words(words)
    return (
        n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats,
        n < 50 or 100 * repeats > 50 * n,
    )


def histogram_sums(docs: DataFrame, params: QualityParams) -> DataFrame:
    """lang, kind ("docs", "class" or "word"), key, weight: sums over documents of their own shares, in millionths.

    Rows come in partial sums; whoever reads them adds them up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        docs_of: Counter[str] = Counter()
        classes: dict[str, np.ndarray] = {}
        words_of: dict[str, dict[bytes, int]] = {}

        def rows() -> Iterator[dict]:
            for lang, own in words_of.items():
                yield {"lang": [lang] * len(own), "kind": ["word"] * len(own), "key": list(own), "weight": list(own.values())}
            out = [(lang, "docs", b"", n) for lang, n in docs_of.items()]
            out += [(lang, "class", str(k).encode(), x) for lang, shares in classes.items() for k, x in enumerate(shares.tolist()) if x]
            yield dict(zip(("lang", "kind", "key", "weight"), zip(*out) if out else ((),) * 4))
            for x in (words_of, docs_of, classes):
                x.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text.as_py()
                raw = text.encode()
                counts = class_histogram(text, raw)
                n = max(1, len(text))
                if not text or sum(counts[k] for k in MARKS) > params.max_reference_marks * n or counts[1] > params.max_reference_capitals * n:
                    continue
                docs_of[lang] += 1
                classes[lang] = classes.get(lang, 0) + (counts * SCALE + n // 2) // n
                words = histogram_words(text, raw, counts)
                n = len(words) or 1
                own = words_of.setdefault(lang, {})
                for w, k in Counter(words).items():
                    own[w] = own.get(w, 0) + (k * SCALE + n // 2) // n
            if sum(map(len, words_of.values())) > 200_000:
                yield from rows()
        yield from rows()

    return map_batches(docs.select(text_or_empty().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("?")).alias("lang")), run, "lang string, kind string, key binary, weight long")


@dataclass(frozen=True)
class Reference:
    classes: np.ndarray
    words: dict[bytes, int]
    #: Shares of those words, in order, and at the end of all others.
    shares: np.ndarray
    docs: int


@dataclass(frozen=True)
class References:
    #: By language, of the commonest ones.
    own: dict[str, Reference]
    #: lang and entries of the other languages, if there are any.
    more: DataFrame | None
    #: Share of marks and controls in all documents; None without documents.
    marks: float | None


def reference(entries: list) -> Reference:
    """The reference of a language, from its (kind, at, key, weight) in order."""
    n = sum(e["weight"] for e in entries if e["kind"] == "docs")
    classes = np.zeros(len(CLASSES))
    for e in entries:
        if e["kind"] == "class":
            classes[int(e["key"])] = e["weight"]
    words = [e for e in entries if e["kind"] == "word"]
    shares = np.array([e["weight"] for e in words] + [0.0]) / max(n * SCALE, 1)
    shares[-1] = max(0.0, 1 - shares.sum())
    return Reference(classes / (classes.sum() or 1), {bytes(e["key"]): k for k, e in enumerate(words)}, shares / (shares.sum() or 1), n)


def best_entries(sums: DataFrame, params: QualityParams) -> DataFrame:
    """lang and entries, the (kind, at, key, weight) of its reference in order: one row for each language in sums."""
    # two steps: many tasks each keep their best words, then one task a language ranks those few
    first = Window.partitionBy("lang", "kind", "salt").orderBy(F.desc("weight"), "key")
    top = Window.partitionBy("lang", "kind").orderBy(F.desc("weight"), "key")
    rows = sums.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(64)))
    rows = rows.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= params.top_words)
    rows = rows.withColumn("at", F.row_number().over(top)).filter(F.col("at") <= params.top_words)
    return rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("kind", "at", "key", "weight"))).alias("entries"))


def fit_references(docs: DataFrame, params: QualityParams = QualityParams(), max_langs: int = MAX_LANGS) -> References:
    """The references by language, from all documents. An empty table gives none."""
    sums = materialize(histogram_sums(docs, params).groupBy("lang", "kind", "key").agg(F.sum("weight").alias("weight")), "sums")
    langs = sums.filter("kind = 'docs'").select("lang", F.col("weight").alias("n"))
    common = [r.lang for r in langs.orderBy(F.desc("n"), "lang").limit(max_langs + 1).collect()]
    held = F.col("lang").isin(common[:max_langs])
    own = {r.lang: reference(r.entries) for r in best_entries(sums.filter(held), params).collect()}
    more = None
    if len(common) > max_langs:
        more = materialize(best_entries(sums.filter(~held).join(langs.select("lang"), "lang"), params), "references")
    classes = {int(r.key): r.weight for r in sums.filter("kind = 'class'").groupBy("key").agg(F.sum("weight").alias("weight")).collect()}
    marks = sum(classes.get(k, 0) for k in MARKS) / (sum(classes.values()) or 1) if classes else None
    return References(own, more, marks)


def with_entries(docs: DataFrame, references: References) -> DataFrame:
    """docs and, if not all references are held by every task, a last column with the entries of the others."""
    if references.more is None:
        return docs
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("?"))
    held = lang.isin(list(references.own))
    more = references.more.withColumnRenamed("lang", "_lang")
    rest = docs.filter(~held).join(more, lang == F.col("_lang"), "left").drop("_lang")
    return docs.filter(held).withColumn("entries", F.lit(None).cast(more.schema["entries"].dataType)).union(rest)


def references_of(own: dict[str, Reference], langs: list[str], entries: pa.Array | None, cache: dict[str, Reference | None]) -> Iterator[Reference | None]:
    """The reference of each row of a batch."""
    for k, lang in enumerate(langs):
        if lang in own or entries is None:
            yield own.get(lang)
            continue
        if lang not in cache:
            if len(cache) > 1000:
                cache.clear()
            found = entries[k].as_py()
            cache[lang] = reference(found) if found else None
        yield cache[lang]


def distances(text: str, raw: bytes, own: Reference | None, marks: float | None, params: QualityParams) -> tuple[float | None, float | None, float | None, int]:
    """Distances of the character classes, of the common words and of the share of marks, None where a guard holds; words counted."""
    classes = class_histogram(text, raw)
    words = histogram_words(text, raw, classes)
    by_class = by_word = by_marks = None
    if len(text) >= params.min_chars:
        shares = classes / len(text)
        if marks is not None:
            mine = max(marks, float(sum(shares[k] for k in MARKS)))
            by_marks = js_distance(np.array([mine, 1 - mine]), np.array([marks, 1 - marks]))
        if own:
            by_class = js_distance(shares, own.classes)
    if own and len(words) >= params.min_words:
        counts = Counter(words)
        common = np.array([counts.get(w, 0) for w in own.words] + [0.0])
        common[-1] = len(words) - common.sum()
        by_word = js_distance(common / len(words), own.shares)
    return by_class, by_word, by_marks, len(words)


def verdict(text: str, own: Reference | None, marks: float | None, params: QualityParams) -> tuple:
    """Base statistics, base_failed, kept and the distances (classes, words, marks) of one document."""
    raw = text.encode()
    stats = base_stats(text, raw)
    by_class, by_word, by_marks, n = distances(text, raw, own, marks, params)
    wide = params.reference_slack / own.docs**0.5 if own else 0.0
    of_class = params.max_class_distance + params.class_slack / max(len(text), 1) ** 0.5
    of_word = params.max_word_distance + params.word_slack / max(n, 1) ** 0.5
    far = (by_class or 0) > of_class + wide or (by_word or 0) > of_word + wide or (by_marks or 0) > of_class
    return *stats, not stats[-1] and not far, by_class, by_word, by_marks


def judge(docs: DataFrame, references: References, params: QualityParams = QualityParams()) -> DataFrame:
    """One row for each document: base statistics, distances (null where a guard holds), base_failed, kept.

    A null text counts as empty: no words, so base_failed. A null language is one of its own. Repeated rows are
    judged alike, other columns play no part. Texts are taken one by one, so a long one costs its own length.
    """
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double, marks_distance double"
    names = [x.split()[0] for x in schema.split(", ")]

    own, marks = references.own, references.marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        cache: dict[str, Reference | None] = {}
        for batch in batches:
            ids, langs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            found = references_of(own, langs, batch.column(3) if batch.num_columns > 3 else None, cache)
            rows = [(doc_id, *verdict(text.as_py(), ref, marks, params)) for doc_id, text, ref in zip(ids, batch.column(1), found)]
            yield dict(zip(names, zip(*rows) if rows else ((),) * len(names)))

    picked = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("?")).alias("lang"))
    return map_batches(with_entries(picked, references), run, schema)


def quality_rules(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Fits the references on docs and judges docs by them."""
    return judge(docs, fit_references(docs, params), params)


def keep_good(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns: as judged by ``quality_rules``, in place."""
    references = fit_references(docs, params)
    own, marks = references.own, references.marks
    text, lang, width = docs.columns.index("text"), docs.columns.index("lang"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, Reference | None] = {}
        for batch in batches:
            langs = ["?" if x is None else str(x) for x in batch.column(lang).to_pylist()]
            found = references_of(own, langs, batch.column(width) if batch.num_columns > width else None, cache)
            keep = pa.array([verdict(t.as_py() or "", ref, marks, params)[6] for t, ref in zip(batch.column(text), found)], pa.bool_())
            yield batch.select(range(width)).filter(keep)
        release()

    return with_entries(docs, references).mapInArrow(run, docs.schema)
