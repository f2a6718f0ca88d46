"""Resolution of not-modified revisits in web archives.

A revisit record says that a page had not changed (status 304). It is joined as-of, by canonical URL, to
the latest earlier full response; its validators have to agree with that response, whose headers then take
over what a 304 may update.

The as-of join has two levels. Inside a (URL, hour) a window finds the latest earlier response; for each
(URL, hour) the latest one is aggregated, combined on the map side, and carried over the hours of the URL. A URL
with very many captures is so spread over its hours, and records without URL or time, which find nothing, are
spread by their id. Payloads don't move: records carry digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The headers of a 304 that update the stored response (HTTP semantics, 304 Not Modified).
UPDATED_HEADERS = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't select content.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid|phpsessid)(=|$)"
DAY = 86_400

RECORD = "record_id long, url string, ts long, status int, etag string, last_modified string, digest string, length long, headers array<struct<name: string, value: string>>"


def canonical_url(url: Column) -> Column:
    """A URL without what doesn't select content.

    Scheme, user, default port, a leading www., the fragment, tracking parameters and slashes at the end of
    the path go; the host is in lower case; parameters are sorted. Null stays null.
    """
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    address = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(address, r"^([^/]*)", 1)), r"^[^@]*@", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(address, r"^[^/]*(.*)$", 1), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(F.regexp_replace(host, r"^www\.", ""), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def plain_tag(etag: Column) -> Column:
    """For the weak comparison of entity tags."""
    return F.regexp_replace(F.trim(etag), r"^W/", "")


def merged(stored: Column, update: Column) -> Column:
    """The stored headers, with the permitted ones of the update in place of their own, by name.

    Names compare in lower case; a name that comes twice keeps each of its values.
    """
    empty = F.array().cast("array<struct<name:string,value:string>>")
    low = lambda h: F.transform(F.coalesce(h, empty), lambda x: F.struct(F.lower(x["name"]).alias("name"), x["value"].alias("value")))
    new = F.filter(low(update), lambda x: x["name"].isin(*UPDATED_HEADERS))
    names = F.transform(new, lambda x: x["name"])
    return F.array_sort(F.concat(F.filter(low(stored), lambda x: ~F.array_contains(names, x["name"])), new))


def resolve_revisits(records: DataFrame, bucket_seconds: int = 3_600) -> DataFrame:
    """One row for each revisit (status 304): its response, outcome, payload digest and merged headers.

    records: columns of ``RECORD``. outcome: "resolved", "mismatch" (the latest earlier response has
    other validators) or "orphan" (no earlier response). An entity tag decides; where either side has
    none, the time of last modification does; a revisit without validators agrees with anything. Of
    responses of one time the one of the largest record_id counts; one of the revisit's own time isn't
    earlier. Records without URL or time are orphans. Repeated revisits give repeated rows; other columns
    play no part. An empty table gives no rows. bucket_seconds: the span that one window covers of a URL; it
    changes how even the work is, not the result.
    """
    rows = records.select("record_id", "url", "ts", "status", "etag", "last_modified", "digest", "length", "headers").filter("status in (200, 304)")
    rows = rows.withColumn("canonical_url", canonical_url(F.col("url")))
    known = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    apart = F.lit(-(2**60)) - F.pmod(F.xxhash64("record_id"), F.lit(4096))  # no bucket of a time
    rows = rows.withColumn("bucket", F.when(known, F.floor(F.col("ts") / bucket_seconds)).otherwise(apart))
    full = F.when((F.col("status") == 200) & known, F.struct("ts", "record_id", "etag", "last_modified", "digest", "length", "headers"))
    inside = Window.partitionBy("canonical_url", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max(full).over(inside)).filter("status = 304")
    buckets = rows.filter(known).groupBy("canonical_url", "bucket").agg(F.max(full).alias("latest"))
    before = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("canonical_url", "bucket", F.max("latest").over(before).alias("carried"))
    found = near.join(carried, ["canonical_url", "bucket"], "left").withColumn("response", F.coalesce("near", "carried"))
    r = F.col("response")
    by_tag = plain_tag(F.col("etag")) == plain_tag(r["etag"])
    by_time = F.col("last_modified") == r["last_modified"]
    agrees = F.coalesce(by_tag, by_time, F.lit(True))
    outcome = F.when(r.isNull(), "orphan").when(agrees, "resolved").otherwise("mismatch")
    good = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id", "url", "canonical_url", "outcome",
        F.when(good, r["record_id"]).alias("response_id"),
        F.when(good, r["digest"]).alias("digest"),
        F.when(good, r["length"]).alias("length"),
        F.when(good, merged(r["headers"], F.col("headers"))).alias("headers"),
    )


def headers(**values: Column) -> Column:
    """Headers of a record from named columns, underscores for hyphens."""
    return F.array(*(F.struct(F.lit(k.replace("_", "-")).alias("name"), v.cast("string").alias("value")) for k, v in values.items()))


def page_records(pages: DataFrame) -> DataFrame:
    """A capture history for the rows of ``pages``: the records of a crawl that came by several times.

    Each page has a full response, every third page a second one two days later with changed content, and
    each page a revisit one to five days after the first, which holds the first response's validators.
    """
    page = F.col("page_id").cast("long")
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(page.alias("page_id"), F.col("url").cast("string").alias("url"), F.md5(body).alias("md5"), F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("length"))
    start = F.lit(1_704_067_200) + F.coalesce("page_id", F.lit(0)) * 60
    tag = F.concat(F.lit('"'), F.substring("md5", 1, 16), F.lit('"'))
    kinds = F.explode(F.when(F.col("page_id") % 3 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(2)))).alias("kind")
    rows = base.select("*", kinds)
    changed = F.col("kind") == 1
    ts = start + F.when(changed, 2 * DAY).when(F.col("kind") == 2, (1 + F.col("page_id") * 7 % 5) * DAY).otherwise(0)
    etag = F.when(changed, F.concat(F.lit('"v2-'), F.substring("md5", 1, 12), F.lit('"'))).when((F.col("kind") == 2) & (F.col("page_id") % 4 == 0), F.concat(F.lit("W/"), tag)).otherwise(tag)
    revisit = F.col("kind") == 2
    return rows.select(
        (F.col("page_id") * 3 + F.col("kind")).alias("record_id"),
        "url",
        ts.alias("ts"),
        F.when(revisit, 304).otherwise(200).alias("status"),
        etag.alias("etag"),
        F.when(changed, start + 2 * DAY).otherwise(start).cast("string").alias("last_modified"),
        F.when(~revisit, F.when(changed, F.sha1(F.concat("sha1", F.lit("-2")))).otherwise(F.col("sha1"))).alias("digest"),
        F.when(~revisit, F.col("length")).alias("length"),
        F.when(revisit, headers(Date=ts, ETag=etag, Cache_Control=F.lit("max-age=60"), Content_Length=F.lit(0)))
        .otherwise(headers(Date=ts, ETag=etag, Content_Type=F.lit("text/html"), Content_Length=F.col("length"), Cache_Control=F.lit("no-cache"))).alias("headers"),
    )
