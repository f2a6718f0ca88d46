"""What a statement reads and writes, folded from its tokens in Spark expressions: one pass, no parser and no Python.

Comments and strings are taken out, names (quoted or not, with or without their database) and marks become tokens, and an
aggregate over them keeps the open brackets: which of them hold a query, which have come to its FROM, and the names that a
WITH has given. A name behind FROM, JOIN or a comma between them is a source unless a WITH in reach gave it or a bracket
follows it (a function). ``extract(day FROM t)`` and ``IS DISTINCT FROM x`` read no table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings, comments to the end of a line, comments in marks; quoted names stay.
HIDDEN = r"""(?s)'(?:[^'\\]|\\.|'')*'|--[^\n]*|/\*.*?\*/|("[^"]*"|`[^`]*`)"""
PART = r"""(?:[A-Za-z_]\w*|"[^"]+"|`[^`]+`)"""
TOKEN = rf"({PART}(?:\s*\.\s*{PART})*|[(),])"
#: Words that stand where a name would, and aren't one.
NO_NAMES = "select with lateral unnest values only table if not exists or replace recursive materialized temporary temp".split()
NAMES = "array<string>"
STATE = f"struct<want:string,before:string,last:string,queries:array<boolean>,froms:array<boolean>,given:array<struct<name:string,depth:int>>,sources:{NAMES},filled:string,made:string,view:string,written:string,stored:boolean,merge:boolean>"


def visible(text: Column) -> Column:
    """A text without its comments and strings."""
    return F.regexp_replace(text, HIDDEN, " $1 ")


#: Words with a meaning of their own, which a quoted name hasn't.
WORDS = sorted({*NO_NAMES, *"from join to into insert overwrite create view merge distinct where group having order limit union intersect except window qualify".split()})


def tokens(statement: Column) -> Column:
    """Words and names in lower case, quotes and the space around dots taken off, and marks; a quoted word of ``WORDS`` keeps a quote before it."""

    def plain(t: Column) -> Column:
        name = F.lower(F.translate(F.regexp_replace(t, r"\s*\.\s*", "."), '"`', ""))
        return F.when(t.rlike("^[\"`]") & name.isin(WORDS), F.concat(F.lit('"'), name)).otherwise(name)

    return F.transform(F.regexp_extract_all(statement, F.lit(TOKEN), F.lit(1)), plain)


def effects(statement: Column) -> Column:
    """A struct of a statement's sources and of what it fills (INSERT, MERGE), makes (TABLE), views, and writes a view to (TO)."""
    empty = F.array().cast(NAMES)
    begin = F.struct(
        F.lit("").alias("want"), F.lit("").alias("before"), F.lit("").alias("last"), F.array(F.lit(False)).alias("queries"), F.array(F.lit(False)).alias("froms"),
        F.array().cast("array<struct<name:string,depth:int>>").alias("given"), empty.alias("sources"), *(F.lit(None).cast("string").alias(c) for c in ("filled", "made", "view", "written")), F.lit(False).alias("stored"), F.lit(False).alias("merge"),
    )
    return F.aggregate(tokens(statement), begin.cast(STATE), lambda s, t: step(s, t).cast(STATE))


def step(s: Column, t: Column) -> Column:
    depth = F.size(s["queries"])
    top = lambda c: F.element_at(s[c], -1)
    put = lambda c, v: F.concat(F.slice(s[c], 1, depth - 1), F.array(v))
    opens, closes, comma = t == "(", t == ")", t == ","
    mark = opens | closes | comma
    query = top("queries")
    listing = query & top("froms")

    # a bracket takes the source before it back: it was a function
    named = s["want"].isin("source")
    known = F.exists(s["given"], lambda g: g["name"] == t)
    takes = named & ~mark & ~t.isin(NO_NAMES)
    sources = F.when(takes & ~known, F.concat(s["sources"], F.array(t))).when(opens & (s["before"] == "source"), F.slice(s["sources"], 1, F.size(s["sources"]) - 1)).otherwise(s["sources"])

    reads = (t == "from") & query & (s["last"] != "distinct")
    joins = (t == "join") & listing
    merges = (t == "using") & s["merge"]
    again = comma & listing
    gives = (t == "with") | (comma & (s["before"] == "given"))
    fills = (t == "into") & s["last"].isin("insert", "merge") | (t == "overwrite") & (s["last"] == "insert")
    creates = ~mark & s["want"].isin("create")
    want = (
        F.when(reads | joins | merges | again, "source").when(gives, "given").when(fills, "filled").when(t == "create", "create").when(creates & (t == "table"), "made").when(creates & (t == "view"), "view")
        .when((t == "to") & s["stored"] & s["written"].isNull(), "written").when(creates, "create").when(s["want"].isin("filled", "made", "view", "written", "given") & t.isin(NO_NAMES), s["want"])
        .when(named & ((t == "lateral") | (t == "only")), "source").otherwise("")
    )
    name = ~mark & ~t.isin(NO_NAMES)
    keep = lambda c: F.coalesce(s[c], F.when((s["want"] == c) & name, t))
    # behind a closed bracket of a WITH a comma gives the next name
    before = F.when(takes & ~known, "source").when(closes & F.exists(s["given"], lambda g: g["depth"] == depth - 1) & ~F.element_at(F.concat(F.array(F.lit(False)), F.slice(s["queries"], 1, depth - 1)), -1), "given").otherwise("")
    given = F.when((s["want"] == "given") & name, F.concat(s["given"], F.array(F.struct(t.alias("name"), depth.alias("depth")))))
    given = given.when(closes, F.filter(s["given"], lambda g: g["depth"] < depth)).otherwise(s["given"])
    shorter = lambda c: F.when(depth > 1, F.slice(s[c], 1, depth - 1)).otherwise(s[c])
    queries = F.when(opens, F.concat(s["queries"], F.array(F.lit(False)))).when(closes, shorter("queries")).when(t == "select", put("queries", F.lit(True))).otherwise(s["queries"])
    froms = F.when(opens, F.concat(s["froms"], F.array(F.lit(False)))).when(closes, shorter("froms")).when(reads, put("froms", F.lit(True)))
    froms = froms.when(query & (t.isin("where", "group", "having", "order", "limit", "union", "intersect", "except", "window", "qualify") | (t == "select")), put("froms", F.lit(False))).otherwise(s["froms"])
    return F.struct(
        want.alias("want"), before.alias("before"), t.alias("last"), queries.alias("queries"), froms.alias("froms"), given.alias("given"), sources.alias("sources"), *(keep(c).alias(c) for c in ("filled", "made", "view", "written")),
        (s["stored"] | (t == "materialized")).alias("stored"), (s["merge"] | (t == "merge")).alias("merge"),
    )
