"""Main text of HTML pages by composite text density.

For every element: characters per tag, adjusted by the share of its characters and tags that are links
(composite text density), and the sum of its children's densities. The element of the greatest sum holds the
main text; the least density on its path to the body is the threshold. Beside that element, going up, parts
of its kind that reach the threshold and text that stands next to it belong to it as well. Inside it, boxes under
the threshold, or half the density of the whole (comments, notices, share bars), and lists of links are left out
again, the latter unless they hold most of its text; how linked a list has to be grows with the links of the text around it.

Tags and roles that can't be an article's text (menus, page headers and footers, form controls, hidden
parts) are left out; density is computed before that. Words of class or id are weak evidence: a box named
wholly by such words goes unless it wraps the page's text, one named so in part only if it is short or full
of links.

One narrow pass over the pages. A page is handled in one scan of its tags, and in time linear in its length
however its tags are nested: open elements are looked up by name, and no tag is scanned twice. A page is
held by one task as a whole; pages are taken one by one, whatever the batch.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Fixed values of HTML: elements without content, elements whose content isn't markup, inline elements,
#: and the open elements that a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr rt rp "
    "math semantics mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace mpadded mphantom mtable mtr mtd mfenced menclose mmultiscripts".split()
)
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th", "thead", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"},
}
HOLDERS = frozenset("ul ol dl table div section article main body td th blockquote".split())
REGIONS = ("article", "main", "body")
#: Elements and roles that aren't an article's text.
DROPPED = frozenset("head nav footer aside button select menu dialog object canvas audio video map annotation annotation-xml".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
#: Words of class or id that tell of something else, and words that say nothing beside them.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "commentlist respond reply replies responses feedback thread disqus discussion widget widgets toolbar pagination pager copyright disclaimer skip hidden banner".split()
)
#: Those of them that an article's own section may bear.
AMBIGUOUS = frozenset("alert disclaimer discussion feedback notice related respond response responses reply replies social thread".split())
FILLERS = frozenset("area bar block box buttons card container content entry form group header holder icons inner item items left line links list message outer panel posts right row section text title top unit wrap wrapper zone".split())
#: Those of them that count for a paragraph or heading, which else belongs to the text around it.
TEXT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted cookie cookies consent gdpr newsletter share copyright skip hidden".split())
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: What stands in the run of an article's text, beside its other boxes.
BLOCKS = TEXTS | frozenset("ul ol dl table figure".split())
RICH = frozenset("ul ol dl table pre figure section article blockquote".split())
ANCHORS = TEXTS | {"section"}  # their ids are made of titles
MODIFIERS = frozenset("has no not with without".split())  # a class that starts so tells of the page, not of the part
#: A part with fewer characters than these is short.
SHORT = 200
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)", re.S | re.I)
#: Elements whose content isn't text. Without an end the first hold the rest of the page, the others nothing.
SWALLOWING = frozenset("script style template textarea title".split())
RAW = {name: re.compile(rf"</{name}\s*+>", re.I) for name in (*SWALLOWING, *"noscript iframe svg xmp noembed noframes".split())}
OPEN = re.compile(r"<[a-zA-Z/!?]")
ATTRIBUTE = re.compile(r"""(?<![a-z-])([a-z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$)")
VALUE = re.compile(r"=\s*+(?:\"[^\"]*+\"|'[^']*+')")
WORD = re.compile(r"[A-Z]?[a-z]++|[A-Z]++(?![a-z])")


def told(value: str, tag: str) -> int:
    """How far a class or id says that the element isn't the article's text: 2 by a whole name, 1 by a part of one."""
    among, most = (TEXT_WORDS if tag in TEXTS else WORDS), 0
    for name in value.split():
        words = [w.lower() for w in WORD.findall(name)]
        if not words or words[0] in MODIFIERS or among.isdisjoint(words):
            continue
        most = max(most, 2 if all(w in WORDS or w in FILLERS for w in words) else 1)
    return most


class Page:
    """The elements of a page in document order, and its blocks of text with the element of each."""

    def __init__(self, source: str):
        self.tag, self.parent, self.kind = ["#"], [-1], [""]
        self.chars, self.link_chars = [0], [0]  # own ones, white space apart
        self.dropped: set[int] = set()  # roots of what is never text
        self.hint: dict[int, int] = {}
        self.floor = 0.0
        self.pieces: list[tuple[int, list[tuple[int, str]]]] = []  # by block: its element, and (element, text)
        self.read(source)

    def attributes(self, node: int, tag: str, source: str, in_article: bool) -> bool:
        """Notes the names of an element; whether it is dropped for sure."""
        hint = 1 if tag == "form" else 0
        found = ATTRIBUTE.findall(source) if "=" in source else ()
        for name, *values in found:
            name, value = name.lower(), "".join(values)
            if name == "class":
                self.kind[node] = value
            if name in ("class", "id") and tag not in ("body", "html", "article", "main") and (name == "class" or tag not in ANCHORS):
                hint = max(hint, told(value, tag))
            elif name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
                return True
            elif name == "style" and "display:none" in value.replace(" ", "").lower():
                return True
        if tag == "form":
            hint = 2
        if hint:
            self.hint[node] = hint
        return "hidden" in source and HIDDEN.search(VALUE.sub("=", source)) is not None

    def read(self, source: str) -> None:
        stack, at_of = [0], defaultdict(list)  # open elements, and by name where in the stack they are
        block_at: list[int] = []  # of those that aren't inline
        pieces: list[tuple[int, str]] = []
        owner = hidden = 0  # hidden: depth from which elements are hidden
        end, limit = 0, source.rfind(">") + 1

        def flush() -> None:
            if pieces:
                self.pieces.append((owner, pieces[:]))
                pieces.clear()

        def close(depth: int) -> None:
            """Closes the open elements from a depth on."""
            nonlocal hidden
            while len(stack) > depth:
                name = self.tag[stack.pop()]
                at_of[name].pop()
                if name not in INLINE:
                    block_at.pop()
            if hidden > depth:
                hidden = 0

        def highest(names: frozenset | set | tuple) -> int:
            return max((at_of[x][-1] for x in names if at_of[x]), default=0)

        endless: set[str] = set()  # names of raw elements that nothing ends any more
        while m := TOKEN.search(source, end, limit):
            if m.start() > end and not hidden:
                self.text(source[end : m.start()], stack[-1], bool(at_of["a"]), pieces)
            end = m.end()
            name = m[2]
            if not name:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    end = len(source)  # a comment that nothing ends
                continue
            name = name.lower()
            if name in RAW and not m[1]:
                if name in SWALLOWING or not m[0].endswith("/>"):
                    close_tag = None if name in endless else RAW[name].search(source, end)
                    if close_tag:
                        end = close_tag.end()
                    else:
                        endless.add(name)
                        end = len(source) if name in SWALLOWING else end
                continue
            inline = name in INLINE
            if not inline:
                flush()
            if m[1]:
                at = at_of[name][-1] if at_of[name] else 0
                bar = (block_at[-1] if block_at else 0) if inline else 0 if name in ("html", *REGIONS) else highest(REGIONS)
                if at > bar:
                    close(at)
                if not inline:
                    owner = stack[-1]
                continue
            if name in VOID:
                if name == "br" and not hidden:
                    pieces.append((stack[-1], " "))
                continue
            if not inline:
                ends = ENDS.get(name)
                holder = highest(HOLDERS - ends if ends else HOLDERS)
                if not ends:
                    if at_of["p"] and at_of["p"][-1] > holder:
                        close(at_of["p"][-1])
                else:
                    over = [at_of[e][n] for e in (*ends, "p") if (n := bisect_right(at_of[e], holder)) < len(at_of[e])]
                    if over:
                        close(min(over))
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.kind.append("")
            self.chars.append(0)
            self.link_chars.append(0)
            at_of[name].append(len(stack))
            if not inline:
                block_at.append(len(stack))
            stack.append(node)
            rest = m[3][:-1]
            in_article = bool(at_of["article"] or at_of["main"])
            if name in DROPPED or name == "header" and not in_article:
                self.dropped.add(node)
            elif (rest or name == "form") and self.attributes(node, name, rest, in_article):
                hidden = hidden or len(stack)
                self.dropped.add(node)
            if not inline:
                owner = node
        if end < len(source) and not hidden:
            rest = OPEN.split(source[end:], maxsplit=1)[0]  # a tag that nothing ends isn't text
            self.text(rest, stack[-1], bool(at_of["a"]), pieces)
        flush()

    def text(self, raw: str, node: int, link: bool, pieces: list[tuple[int, str]]) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append((node, text))
        n = len(text) - text.count(" ")
        self.chars[node] += n
        if link:
            self.link_chars[node] += n

    def measure(self) -> None:
        """Sums over subtrees, densities and their sums."""
        n = len(self.tag)
        self.tags, self.link_tags, self.last = [1] * n, [int(t == "a") for t in self.tag], list(range(n))
        self.children: list[list[int]] = [[] for _ in range(n)]
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            for x in (self.chars, self.link_chars, self.tags, self.link_tags):
                x[up] += x[k]
            self.last[up] = max(self.last[up], self.last[k])
        for k in range(1, n):
            self.children[self.parent[k]].append(k)
        body = next((k for k, t in enumerate(self.tag) if t == "body"), 0)
        self.body = body if self.chars[body] else 0
        self.density = densities(self.chars, self.link_chars, self.tags, self.link_tags, self.body)
        self.sums = [0.0] * n
        for k in range(1, n):
            self.sums[self.parent[k]] += self.density[k]

    def leave_out(self) -> list[bool]:
        """Which nodes are in parts left out by tag, role or name, whatever their density.

        A box that is named wholly by telling words stays if it holds four times the text that stands outside of
        all such boxes, links apart, or more than that and also a main, a first heading or a single article:
        it wraps the page's text. One named so in part goes only if it is short or a third of it are links.
        """
        n, last = len(self.tag), self.last
        gone = [False] * n
        end = 0
        for k in range(n):
            if k < end:
                gone[k] = True
            elif k in self.dropped:
                gone[k], end = True, last[k] + 1
        own = [0] * n  # characters outside of links, left out ones apart
        links = [0] * n
        marks = {t: [0] * (n + 1) for t in ("main", "h1", "article")}
        for k in range(n):
            for t, x in marks.items():
                x[k + 1] = x[k] + (self.tag[k] == t)
        for k in range(n - 1, -1, -1):
            if not gone[k]:
                below = [c for c in self.children[k] if not gone[c]]
                all_ = self.chars[k] - sum(self.chars[c] for c in self.children[k])
                link = self.link_chars[k] - sum(self.link_chars[c] for c in self.children[k])
                own[k] = all_ - link + sum(own[c] for c in below)
                links[k] = link + sum(links[c] for c in below)
        self.own, self.links = own, links
        for k, hint in self.hint.items():
            if hint == 2 and self.tag[k] in ("section", "div") and self.doubtful(k):
                self.hint[k] = 1
        told_of = [k for k in sorted(self.hint) if not gone[k] and (self.hint[k] == 2 or own[k] < SHORT or 2 * links[k] > own[k])]
        outside, end = own[0], 0
        for k in told_of:
            if k >= end:
                outside, end = outside - own[k], last[k] + 1
        end = 0
        clean = dict.fromkeys(told_of, 0)  # text in them, boxes inside apart
        inside: list[int] = []
        for k in told_of:
            while inside and last[inside[-1]] < k:
                inside.pop()
            clean[k] += own[k]
            if inside:
                clean[inside[-1]] -= own[k]
            inside.append(k)
        for k in told_of:
            if k < end:
                continue
            count = {t: x[last[k] + 1] - x[k] for t, x in marks.items()}
            holds = count["main"] or count["h1"] or count["article"] == 1
            wraps = own[k] > 4 * outside or holds and own[k] > outside
            if wraps and (self.tag[k] == "form" or own[k] >= SHORT):
                outside += clean[k]
                continue
            end = last[k] + 1
            for x in range(k, end):
                gone[x] = True
        return gone

    def doubtful(self, k: int) -> bool:
        """Whether a box's telling words are of a kind that sections bear too, and it holds paragraphs of text as these do, not boxes."""
        words = {w.lower() for w in WORD.findall(self.kind[k])}
        return not words & (WORDS - AMBIGUOUS) and 2 * sum(self.chars[c] for c in self.children[k] if self.tag[c] in BLOCKS) > self.chars[k]

    def linked(self, k: int, whole: int) -> bool:
        """Whether a part is links in the main, for a text that has itself so many of them."""
        return 2 * self.link_chars[k] * self.chars[whole] > self.chars[k] * (self.chars[whole] + self.link_chars[whole])

    def alike(self, k: int, best: int) -> bool:
        """Whether a part beside the best one is of the article as well: of its kind, or text in its run."""
        if self.tag[k] in BLOCKS:
            return not self.linked(k, best)
        if self.tag[k] != self.tag[best] or self.kind[k] != self.kind[best] or self.linked(k, best):
            return False
        return self.tag[k] == "section" or self.density[k] >= max(self.floor, self.density[best] / 2) and 8 * self.own[k] >= self.own[best]

    def parts(self, gone: list[bool]) -> list[int]:
        """The roots of the main text: the element of the greatest sum and what belongs to it beside."""
        inside = [k for k in range(self.body, self.last[self.body] + 1) if not gone[k] and self.own[k] and self.tag[k] not in INLINE]
        if not inside:
            return [self.body] if not gone[self.body] else []
        best = max(inside, key=lambda k: self.sums[k] or self.density[k])
        self.floor, at = self.density[best], best
        while at > self.body:
            at = self.parent[at]
            self.floor = min(self.floor, self.density[at])
        out = [best]
        while best != self.body and self.tag[best] not in REGIONS:
            up = self.parent[best]
            beside = [k for k in self.children[up] if k != best and not gone[k] and self.chars[k] and self.alike(k, best)]
            loose = self.chars[up] > sum(self.chars[k] for k in self.children[up])  # text of its own
            if beside and self.tag[best] in BLOCKS or loose and self.tag[up] not in ("body", "#"):
                out = [up]
            else:
                out += beside
            best = up
        return out

    def boxes(self, part: int, gone: list[bool]) -> None:
        """Leaves out boxes under the threshold and lists of links inside a part."""
        k, end = part + 1, self.last[part]
        floor = max(self.floor, self.density[part] / 2)
        links: list[int] = []
        while k <= end:
            if gone[k] or not self.chars[k]:
                k = self.last[k] + 1 if gone[k] else k + 1
                continue
            tag = self.tag[k]
            if self.link_tags[k] > 2 and tag in ("ul", "ol", "div", "p", "table", "section") and self.linked(k, part):
                links.append(k)
                k = self.last[k] + 1
                continue
            out = False
            if tag == "div" and self.density[k] < floor and 4 * self.own[k] < self.own[part]:
                kin = any(self.tag[x] == "div" and self.kind[x] == self.kind[k] and self.density[x] >= floor for x in self.siblings(k))
                out = not kin and self.rich[self.last[k] + 1] == self.rich[k + 1]
            if out:
                gone[k : self.last[k] + 1] = [True] * (self.last[k] + 1 - k)
                k = self.last[k] + 1
            else:
                k += 1
        if 2 * sum(self.chars[x] for x in links) <= self.chars[part]:  # else the links are the text
            for x in links:
                gone[x : self.last[x] + 1] = [True] * (self.last[x] + 1 - x)

    def siblings(self, k: int) -> list[int]:
        """The two nearest elements before and after, so that the work stays linear."""
        own = self.children[self.parent[k]]
        at = self.place[k]
        return [x for x in own[max(0, at - 2) : at + 3] if x != k]

    def main(self) -> list[str]:
        """The blocks of the main text."""
        self.measure()
        gone = self.leave_out()
        self.place = {k: n for c in self.children for n, k in enumerate(c)}
        #: How many elements before each one hold text in boxes of their own.
        self.rich = [0, *accumulate(t in RICH for t in self.tag)]
        chosen = [False] * len(self.tag)
        for part in self.parts(gone):
            self.boxes(part, gone)
            for k in range(part, self.last[part] + 1):
                chosen[k] = not gone[k]
        texts = (" ".join("".join(x for at, x in pieces if chosen[at]).split()) for _, pieces in self.pieces)
        return [text for text in texts if text]


def densities(chars: list[int], link_chars: list[int], tags: list[int], link_tags: list[int], body: int) -> list[float]:
    """Composite text density of every element from the sums over its subtree."""
    share = link_chars[body] / max(1, chars[body])
    out = [0.0] * len(chars)
    for k, c in enumerate(chars):
        if c:
            lc = link_chars[k]
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            inside = c / max(1, lc) * tags[k] / max(1, link_tags[k])
            out[k] = c / tags[k] * math.log(max(1.0, inside)) / (1.0 + math.log(base))  # 1: without links the base would be 1
    return out


def main_text(source: str) -> str:
    return "\n".join(Page(source).main())


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    text: the blocks of the main text, each with its white space folded, joined by one line feed. A null or
    empty page, or one without text, has an empty text. Repeated rows give repeated rows; other columns
    play no part. A long page takes time and memory in proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(x) for x in texts]}

    columns = (F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return map_batches(pages.select(*columns), run, "page_id long, url string, text string, n_chars long")
