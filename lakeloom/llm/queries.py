"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, conversations, decontaminate, html_text, mixing, quality, runs, sharding, simhash, substrings, token_counts, warc
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False, digests=True)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter("vec_id % 20 = 0"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of a capture history that Spark derives from the pages, headers as lines of text."""
    out = warc.resolve_revisits(warc.page_records(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform("headers", lambda x: F.concat(x["name"], F.lit(": "), x["value"])), "\n")
    return out.withColumn("headers", lines)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the mix, range-sorted by the position of each document's first copy."""
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    first = F.try_element_at("positions", F.lit(1))
    out = plan.withColumn("first_position_ppm", F.floor(first * 1e6).cast("long")).orderBy(first, "doc_id")
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "first_position_ppm")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")), present="present")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.greatest_run(runs.find_runs(runs.damage(table(spark, sf_dir, "documents")), digests=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_sharding": op2_sharding,
    "op3_substrings": op3_substrings,
    "op4_quality": op4_quality,
    "op5_ann": op5_ann,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_html": op8_html,
    "op9_simhash": op9_simhash,
    "op10_token_counts": op10_token_counts,
    "op11_conversations": op11_conversations,
    "op12_decontamination": op12_decontamination,
    "op13_periodic_runs": op13_periodic_runs,
}

OP7_SQL = r"""
WITH sized AS (
    SELECT row_number() OVER () AS nr, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
    FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sized GROUP BY source),
weighed AS (
    SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][rank % 3 + 1] AS weight, [-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE][rank % 3 + 1] AS slope, 3.0::DOUBLE * source_size AS cap FROM sources),
levels AS (
    SELECT *, row_number() OVER fill AS nr,
        (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
    FROM weighed WINDOW fill AS (ORDER BY cap / weight, rank)),
targets AS (
    SELECT *, least(cap, weight * (SELECT level FROM levels WHERE cap >= level * weight ORDER BY nr LIMIT 1)) AS target FROM levels),
placed AS (
    SELECT doc_id, size, source_size, target, slope, rank, coalesce(least(3, floor(target / nullif(source_size, 0))), 0)::INT AS epochs,
        sum(size) OVER (PARTITION BY rank ORDER BY h, doc_id, size, s.nr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fin
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
parts AS (SELECT *, target - epochs * source_size AS part FROM placed),
reach AS (SELECT *, coalesce(max(CASE WHEN fin <= part THEN fin END) OVER (PARTITION BY rank), 0) AS reached FROM parts),
fill AS (
    SELECT rank, min_by(fin, (abs(size - (part - reached)), fin)) AS filler FROM reach
    WHERE fin > part AND size > 0 AND abs(size - (part - reached)) < part - reached GROUP BY rank),
counted AS (
    SELECT r.*, CASE WHEN size > 0 THEN epochs + (fin <= part)::INT + (coalesce(fin = filler, false))::INT ELSE 0 END AS copies,
        least(1.0::DOUBLE, (CASE WHEN epochs > 0 OR fin <= part THEN fin - size / 2.0::DOUBLE ELSE reached + size / 2.0::DOUBLE + epochs * source_size END) / target) AS share
    FROM reach r LEFT JOIN fill f ON r.rank = f.rank)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies,
    CASE WHEN copies > 0 THEN floor(2.0 * share / ((1.0 - slope) + sqrt((1.0 - slope) * (1.0 - slope) + 4.0 * slope * share)) * 1e6)::BIGINT END AS first_position_ppm
FROM counted
"""

OP6_SQL = r"""
WITH base AS (
    SELECT page_id, url, md5(coalesce(html, '')) AS md5, sha1(coalesce(html, '')) AS sha1, strlen(coalesce(html, '')) AS length, 1704067200 + page_id * 60 AS start FROM pages),
kinds AS (SELECT *, unnest(CASE WHEN page_id % 3 = 0 THEN [0, 1, 2] ELSE [0, 2] END) AS kind FROM base),
tagged AS (
    SELECT *, page_id * 3 + kind AS record_id, start + CASE kind WHEN 1 THEN 2 * 86400 WHEN 2 THEN (1 + page_id * 7 % 5) * 86400 ELSE 0 END AS ts,
        CASE kind WHEN 1 THEN '"v2-' || substr(md5, 1, 12) || '"' ELSE '"' || substr(md5, 1, 16) || '"' END AS tag,
        regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
    FROM kinds),
parts AS (
    SELECT *, regexp_extract(rest, '^([^?]*)', 1) AS address,
        list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid|phpsessid)(=|$)'))) AS kept
    FROM tagged),
records AS (
    SELECT *, CASE WHEN kind = 1 THEN sha1(sha1 || '-2') ELSE sha1 END AS digest,
        regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(address, '^([^/]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www\.', '')
        || regexp_replace(regexp_extract(address, '^[^/]*(.*)$', 1), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url
    FROM parts),
responses AS (
    SELECT * FROM records WHERE kind < 2 QUALIFY row_number() OVER (PARTITION BY canonical_url, ts ORDER BY record_id DESC) = 1),
found AS (
    SELECT v.*, r.record_id AS rid, r.tag AS rtag, r.digest AS rdigest, r.length AS rlength
    FROM (SELECT * FROM records WHERE kind = 2) v ASOF LEFT JOIN responses r ON v.canonical_url = r.canonical_url AND v.ts > r.ts),
judged AS (SELECT *, CASE WHEN rid IS NULL THEN 'orphan' WHEN tag = rtag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM found)
SELECT record_id, url, canonical_url, outcome,
    CASE WHEN outcome = 'resolved' THEN rid END AS response_id, CASE WHEN outcome = 'resolved' THEN rdigest END AS digest, CASE WHEN outcome = 'resolved' THEN rlength END AS length,
    CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || rlength || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10)
        || 'etag: ' || CASE WHEN page_id % 4 = 0 THEN 'W/' ELSE '' END || tag END AS headers
FROM judged
"""

OP12_SQL = r"""
WITH lowered AS (SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + 9], ' ') AS words FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
starts AS (SELECT nr, size, i, array_to_string(w[i : i + size - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM lowered, sizes WHERE len(w) >= size)),
found AS (SELECT nr, i, s.size, item_id FROM starts s JOIN windows USING (size, words)),
hits AS (SELECT nr, count(DISTINCT word) AS n_hit FROM (SELECT nr, unnest(range(i, i + size)) AS word FROM (SELECT DISTINCT nr, i, size FROM found)) GROUP BY nr),
named AS (SELECT nr, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT nr, item_id FROM found) GROUP BY nr)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hits USING (nr) LEFT JOIN named USING (nr)
"""

ORACLE: dict[str, str] = {"op6_warc": OP6_SQL, "op7_mixing": OP7_SQL, "op12_decontamination": OP12_SQL}
