"""HTML extraction, revisits and nearest neighbours, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import ann, html_text, warc

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header class="top"><h1>Site name</h1></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div id="sidebar"><p>Some sidebar words that nobody wants to read in here.</p></div><!-- <p>not this</p> -->
<article><header><h1>Title &amp; more</h1></header><p>First   para&shy; with\n<a href=x>a link</a> inside and enough of text to count.<p>Second <b>para<br>goes on</b> &lt;here&gt;.
<div class="ad">Buy this now</div><ul><li>Item one<li>Item two</ul><aside>Aside</aside><div class="comments"><p>First! I am a reader.</p></div></article>
<form><p>Sign up here</p></form><footer>Copyright</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE).split("\n") == ["Title & more", "First para\xad with a link inside and enough of text to count.", "Second para goes on <here>.", "Item one", "Item two"]
    assert html_text.main_text("") == "" and html_text.main_text("<div class=ad>x</div>") == ""
    assert html_text.main_text("plain  text") == "plain text" and html_text.main_text("<p>a<p>b") == "a\nb"
    assert html_text.main_text("<body><p>one<script>if (a<b) '</p>'") == "one"


def test_density_finds_the_text_without_names():
    links = "".join(f"<li><a href=/{k}>some link text {k}</a></li>" for k in range(30))
    text = "".join(f"<p>Sentence number {k} of the story, which is long enough to be text.</p>" for k in range(8))
    page = f"<body><div><ul>{links}</ul></div><div><div>{text}</div></div><div><a href=q>next</a> <a href=p>last</a></div></body>"
    assert html_text.main_text(page) == "\n".join(f"Sentence number {k} of the story, which is long enough to be text." for k in range(8))


STORY = "\n".join(f"Sentence number {k} of the story, which is long enough to be text." for k in range(8))


@pytest.mark.parametrize("wrap", ["<div class='content has-sidebar'>{}</div>", "<div class=no-sidebar>{}</div>", "<div class='with-comments'>{}</div>", "<div id='page-widget'>{}</div>", "<form action=x.aspx>{}</form>"])
def test_wrappers_keep_the_text(wrap):
    """A word of the class of what holds the whole text, or a form around it, leaves nothing out but parts inside."""
    story = "".join(f"<p>{x}</p>" for x in STORY.split("\n"))
    page = "<body><nav><a href=x>y</a></nav>" + wrap.format(f"<article>{story}<div class=ad>Buy</div></article><div class=comments><p>First!</p></div>") + "</body>"
    assert html_text.main_text(page) == STORY


def test_parts_of_an_article_stay():
    a, b, c = (f"<p>{x}</p>" for x in STORY.split("\n")[:3])
    page = f"<body><article>{a}<h2 id='related-work'>Related work</h2>{b}<p class='notice'>Mind the gap between these two.</p><section id='social-history'>{c}</section><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds for all of them.</p></article></body>"
    got = html_text.main_text(page)
    for x in (*STORY.split("\n")[:3], "Related work", "Mind the gap between these two.", "So x=2 holds for all of them."):
        assert x in got.split("\n")


def page_of(story: str) -> str:
    return "<body><nav><ul>" + "<li><a href=/x>menu words</a></li>" * 6 + "</ul></nav>" + story + "<footer>&copy; us</footer></body>"


@pytest.mark.parametrize("name", ["content-with-sidebar", "has-sidebar", "social-science", "main no-ads", "related-work", "post signup-free", "masthead-story"])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_names_are_weak_evidence(name, tag):
    story = "".join(f"<p>{x}</p>" for x in STORY.split("\n"))
    assert html_text.main_text(page_of(f"<{tag} class='{name}'>{story}</{tag}>")) == STORY
    part = f"<section class='{name}'>{story}</section>"
    assert html_text.main_text(page_of(f"<article><p>{'Before it. ' * 20}</p>{part}<p>{'After it. ' * 20}</p></article>")).count("Sentence number") == 8


@pytest.mark.parametrize("name", ["feedback-thread", "zq9", "comments", "note-x"])
@pytest.mark.parametrize("box", ["<p>First! I am a reader.</p><p>Me too, nice post.</p>", "Please mind that we moved."])
def test_comments_and_notices_go_whatever_their_name(name, box):
    story = "".join(f"<p>{x}</p>" for x in STORY.split("\n"))
    for page in (f"<article>{story}<div class='{name}'>{box}</div></article>", f"<div class=post>{story}</div><div class='{name}'>{box}</div>"):
        assert html_text.main_text(page_of(page)) == STORY


def test_sections_of_one_article_stay_together():
    a, b = STORY.split("\n")[:5], STORY.split("\n")[5:]
    two = "".join("<div class=part>" + "".join(f"<p>{x}</p>" for x in part) + "</div>" for part in (a, b))
    assert html_text.main_text(page_of(f"<div id=all><h1>The title</h1>{two}</div>")) == "The title\n" + STORY


def test_density_decides(spark, sf, monkeypatch):
    """On the given pages with their telling tags and names taken away, density finds the text; one density for all doesn't."""
    pages = [r.html for r in spark.read.parquet(f"{sf}/../sf0.01/pages.parquet").collect()]
    right = [html_text.main_text(x) for x in pages]
    neutral = [re.sub(r"<(/?)(?:nav|article|footer)>", r"<\1div>", x).replace('class="ad"', 'class="q7"') for x in pages]
    found = sum(html_text.main_text(x) == y for x, y in zip(neutral, right))
    monkeypatch.setattr(html_text, "densities", lambda chars, *rest: [float(c > 0) for c in chars])
    flat = sum(html_text.main_text(x) == y for x, y in zip(neutral, right))
    assert found >= 0.8 * len(pages) and flat < found


def test_densities_are_those_of_the_definition():
    """Density and sums of random trees, computed from the tree by the formula."""
    r = np.random.default_rng(4)

    def make(depth):
        tag = ["div", "section", "a", "b", "article"][r.integers(0, 5)] if depth else "body"
        below = [make(depth + 1) for _ in range(int(r.integers(0, 4)) if depth < 4 else 0)]
        return tag, "x" * int(r.integers(0, 30)), below

    def render(node):
        return f"<{node[0]}>{node[1]}{''.join(map(render, node[2]))}</{node[0]}>"

    def count(node, linked=False):
        linked = linked or node[0] == "a"
        rows = [count(x, linked) for x in node[2]]
        own = [len(node[1]), len(node[1]) * linked, 1, int(node[0] == "a")]
        return [sum(x) for x in zip(own, *rows)] if rows else own

    for _ in range(40):
        tree = make(0)
        page = html_text.Page(render(tree))
        page.measure()
        _, body_chars, body_links = 0, *count(tree)[:2]
        want, sums = [], []

        def walk(node, linked=False):
            c, lc, t, lt = count(node, linked)
            d = 0.0
            if c:
                base = np.log(np.log(c / max(1, c - lc) * lc + body_links / max(1, body_chars) * c + np.e)) + 1
                d = c / t * np.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / base
            at = len(want)
            want.append(d), sums.append(0.0)
            for x in node[2]:
                sums[at] += walk(x, linked or node[0] == "a")
            return d

        walk(tree)
        assert np.allclose(page.density[1:], want) and np.allclose(page.sums[1:], sums)


@pytest.mark.parametrize(
    "page",
    ["<b>" * 20000 + "</i>" * 20000, "<i><div>" + "<b>" * 20000 + "</i>" * 20000, "<a " * 20000, "<div>" + "<b>" * 20000 + "<p><h1>" * 10000, "<div>x" * 20000, '<b ">"' * 20000, "<div " + "a" * 200000 + ">x",
     "<div class=comments>x" * 20000, "<ul><b>" + "<li>x<b>" * 20000, "<div class=a>x</div>" * 20000],
)
def test_hostile_pages_take_linear_time(page):
    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 3


def test_extract_rows(spark, sf):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", PAGE, "x", 1), (1, "u", PAGE, "x", 1), (2, None, None, None, None), (None, "v", "<p>" + "long text " * 200_000, "", 0)]
    got = html_text.extract_text(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and sum(r.text == "" for r in got) == 1
    assert html_text.extract_text(spark.createDataFrame([], schema)).count() == 0
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert html_text.extract_text(pages).filter("n_chars > 0").count() == pages.count()


def test_canonical_url(spark):
    cases = {
        "HTTP://User@WWW.Example.com:80/a/b/?utm_source=x&b=2&a=1#top": "example.com/a/b?a=1&b=2", "https://example.com/": "example.com", "example.com/x?ref=1": "example.com/x",
        "https://example.com:8080/x": "example.com:8080/x", None: None, "": "",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string").select("url", warc.canonical_url(F.col("url")).alias("c"))
    assert dict(map(tuple, df.collect())) == cases


def test_revisits(spark):
    h = lambda **kw: [(k, v) for k, v in kw.items()]
    day = warc.DAY
    rows = [
        (1, "http://a.com/x", 10, 200, '"e1"', "m1", "d1", 5, h(ETag='"e1"', Server="s", Vary="a")), (2, "https://www.a.com/x/", 3 * day, 200, '"e2"', None, "d2", 6, h(ETag='"e2"')),
        (3, "a.com/x", 20, 304, 'W/"e1"', None, None, None, h(etag='W/"e1"', Server="other", Vary="b", Content_Length="0")), (4, "http://a.com/x", 2 * day, 304, None, "m1", None, None, None),
        (5, "http://a.com/x", 3 * day, 304, '"e1"', None, None, None, h()), (6, "http://a.com/x", 3 * day + 1, 304, '"e1"', "m1", None, None, h()), (7, "http://a.com/x", 10, 304, None, None, None, None, h()),
        (8, None, 99, 304, None, None, None, None, None), (9, "http://b.com", 5, 304, None, None, None, None, None), (10, "http://a.com/x", 50 * day, 304, None, None, None, None, h()),
        (10, "http://a.com/x", 50 * day, 304, None, None, None, None, h()), (11, "http://a.com/x", None, 304, None, None, None, None, h()), (12, "http://a.com/x", 9, 404, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, warc.RECORD).withColumn("day", F.lit("clash")).withColumn("canonical_url", F.lit("clash"))
    got = warc.resolve_revisits(df).collect()
    outcome = {r.record_id: (r.outcome, r.response_id, r.digest) for r in got}
    assert outcome == {
        3: ("resolved", 1, "d1"), 4: ("resolved", 1, "d1"), 5: ("resolved", 1, "d1"), 6: ("mismatch", None, None), 7: ("orphan", None, None), 8: ("orphan", None, None), 9: ("orphan", None, None),
        10: ("resolved", 2, "d2"), 11: ("orphan", None, None),
    }
    assert len(got) == 10
    headers = {(x.name, x.value) for x in next(r for r in got if r.record_id == 3).headers}
    assert headers == {("etag", 'W/"e1"'), ("server", "s"), ("vary", "b")}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [1, 3_600, 10**9])
def test_revisits_find_the_latest_response(spark, bucket):
    """Whatever a window spans, a revisit finds what a plain scan of its URL's responses finds; without a URL nothing."""
    r = np.random.default_rng(9)
    rows = [(k, [None, "a.com", "b.com/y"][r.integers(3)], None if r.random() < 0.1 else int(r.integers(0, 20_000)), 200 if r.random() < 0.5 else 304, None, None, f"d{k}", 1, []) for k in range(300)]
    got = warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORD), bucket).collect()
    assert len(got) == sum(x[3] == 304 for x in rows)
    for x in got:
        _, url, ts, *_ = rows[x.record_id]
        before = [(y[2], y[0]) for y in rows if y[3] == 200 and None not in (url, ts, y[1], y[2]) and y[1] == url and y[2] < ts]
        assert x.response_id == (max(before)[1] if before else None) and x.outcome == ("resolved" if before else "orphan")


def vectors(n: int, d: int = 16) -> list[tuple]:
    r = np.random.default_rng(5)
    x = r.normal(size=(n, d)).astype(np.float32)
    x[3 : n // 3] = x[2]  # a hot vector: its copies tie
    rows = [(k, [float(v) for v in x[k]], "l", 0.5, 1) for k in range(n)]
    bad = [None, [0.0] * d, [None, *[1.0] * (d - 1)], [float("nan"), *[1.0] * (d - 1)], [float("inf"), *[1.0] * (d - 1)], [1.0, 2.0], []]
    return rows + [(20 * (n + k), v, "l", 0.5, 1) for k, v in enumerate(bad)] + [(None, [1.0] * d, "l", 0.5, 1)]


SCHEMA = "vec_id long, embedding array<float>, label string, score double, rank int"


@pytest.mark.parametrize(("n", "block", "asked"), [(500, 8192, 32768), (500, 64, 32768), (9, 4, 32768), (500, 64, 3)])
def test_nearest(spark, n, block, asked):
    data = vectors(n)
    df = spark.createDataFrame(data, SCHEMA)
    got = ann.nearest(df, df.filter("vec_id % 20 = 0"), ann.AnnParams(block_rows=block, block_queries=asked)).collect()
    good = [(k, np.array(v, dtype=np.float64)) for k, v, *_ in data[:n]]
    hits = total = 0
    for q, x in good[::20]:
        exact = sorted(((-float((v * x).sum()), k) for k, v in good if k != q))[:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(exact) + 1))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        by_id = dict(good)
        assert all(abs(r.score - float((by_id[r.vec_id] * x).sum())) < 1e-9 for r in mine)
        hits += len({k for _, k in exact} & {r.vec_id for r in mine})
        total += len(exact)
    assert hits >= 0.9 * total and {r.query_id for r in got} == {k for k, _ in good[::20]}


def test_recall_on_given_vectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = ann.nearest(df, df.filter("vec_id % 20 = 0")).collect()
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows], dtype=np.float64), np.array([r.vec_id for r in rows])
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        hits += len({int(k) for k in ids[np.lexsort((ids, -s))[:20]]} & {r.vec_id for r in got if r.query_id == ids[q]})
    n = int((ids % 20 == 0).sum())
    assert hits >= 0.9 * 20 * n
    assert sum(r.n_reranked for r in got if r.rank == 1) < 0.7 * n * len(ids)


def test_pigeonhole_misses_no_code():
    r = np.random.default_rng(1)
    for substrings in (1, 4):
        codes = r.integers(0, 1 << 16, size=(2000, substrings)).astype(np.uint16)
        codes[1000:1500] = codes[0] ^ np.packbits(r.random((500, 16 * substrings)) < 0.1, axis=1).view(">u2").astype(np.uint16)
        index = ann.MultiIndex(codes)
        for radius in (0, 1, 2, 3, 9, 16, 20, 27):
            bounds = ann.substring_bounds(radius, substrings)
            assert sum(b + 1 for b in bounds) == min(radius + 1, 17 * substrings) or max(bounds) == 16
            for q in (0, 7, 1200):
                found, probed = index.within(codes[q], radius)
                assert found.tolist() == np.flatnonzero(ann.hamming(codes, codes[q]) <= radius).tolist() and len(found) <= probed <= 2000


def test_lists_prune():
    """Codes near few others: next to nothing is probed, and what is probed is what the lists hold."""
    r = np.random.default_rng(2)
    index = ann.MultiIndex(r.integers(0, 1 << 16, size=(50_000, 4)).astype(np.uint16))
    for s in range(4):
        for bound in (0, 2, 5):
            value = int(index.codes[17, s])
            assert sorted(index.probe(s, value, bound)) == np.flatnonzero(np.bitwise_count(index.codes[:, s] ^ np.uint16(value)) <= bound).tolist()
    assert index.within(index.codes[5], 3)[1] < 50 and index.within(index.codes[5], 11)[1] < 5000


def test_repeated_and_clashing_queries(spark):
    """A query that comes twice is one; two vectors of one id are two queries, each with whole ranks."""
    r = np.random.default_rng(8)
    x = [[float(v) for v in r.normal(size=16)] for _ in range(100)]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(20, x[20]), (20, x[20]), (40, x[40]), (40, x[41])], "vec_id long, embedding array<float>")
    got = ann.nearest(rows, asked).collect()
    assert sorted(q.rank for q in got if q.query_id == 20) == list(range(1, 21)) and len({q.vec_id for q in got if q.query_id == 20}) == 20
    assert sorted(q.rank for q in got if q.query_id == 40) == sorted(2 * list(range(1, 21)))


def test_no_vectors(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(df, df).count() == 0
    zero = spark.createDataFrame([(0, [0.0, 0.0], "l", 0.0, 1)], SCHEMA)
    assert ann.nearest(zero, zero).count() == 0


def article(*parts: str) -> str:
    return f"<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>About</a></li></ul></nav><article><h1>The title</h1>{''.join(parts)}</article><footer>Contact</footer></body></html>"


PARAGRAPHS = [f"<p>Paragraph {k} of the article holds a sentence or two of plain text, long enough to count as such.</p>" for k in range(5)]


@pytest.mark.parametrize("linked", range(8))
def test_link_rich_articles_stay(linked):
    words = [[f"<a href='/w{k}'>word{k}</a>" if k % 7 < linked else f"plain{k}" for k in range(i, i + 42)] for i in range(0, 336, 42)]
    text = html_text.main_text(article(*(f"<p>{' '.join(w)}.</p>" for w in words)))
    assert text.count("\n") == 8 and all(f"{kind}{k}" in text for k in range(336) for kind in [("word" if k % 7 < linked else "plain")])
    assert "Home" not in text and "Contact" not in text


@pytest.mark.parametrize("before", ["<svg class='icon'/>", "<svg><path d='x'/></svg>", "<iframe src='x'>", "<iframe src='x'/>", "<noscript/>", "<noscript>Enable scripts</noscript>"])
def test_elements_that_nothing_ends(before):
    assert html_text.main_text(before + article(*PARAGRAPHS)) == html_text.main_text(article(*PARAGRAPHS)) != ""
    assert html_text.main_text(article(before, *PARAGRAPHS)) == html_text.main_text(article(*PARAGRAPHS))


@pytest.mark.parametrize("name", ["discussion", "feedback", "responses", "disclaimer", "alert"])
def test_sections_with_doubtful_names(name):
    """Paragraphs of text stay; boxes of comments under the same name go, as do comments by name."""
    own = f"<section class='{name}'><h2>More of it</h2>{''.join(PARAGRAPHS).replace('Paragraph', 'Passage')}</section>"
    assert html_text.main_text(article(*PARAGRAPHS, own)).count("Passage") == 5
    boxes = "".join(f"<div class='c'><b>User {k}</b><p>I think that this is a good text, thank you.</p></div>" for k in range(3))
    assert "thank you" not in html_text.main_text(article(*PARAGRAPHS, f"<section class='{name}'>{boxes}</section>"))
    assert "thank you" not in html_text.main_text(article(*PARAGRAPHS, f"<section class='comments'>{boxes}</section>"))


@pytest.mark.parametrize("one", ["<ul><li>", "<table><tr><td>", "<div>", "<svg>", "<iframe>", "<p>", "<dl><dt>", "<section class='discussion'>"])
def test_nested_elements_take_linear_time(one):
    import time

    start = time.perf_counter()
    html_text.main_text("<body>" + one * 20_000 + "some text, a sentence of words.")
    assert time.perf_counter() - start < 4
