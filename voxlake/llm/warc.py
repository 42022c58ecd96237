"""WARC not-modified revisits: as-of join by canonical URL to the latest earlier full response.

A revisit (status 304) resolves to the latest full response (status 200 with a payload digest) of the same canonical
URL that comes before it by (fetch_time, record_id); a full response of the same instant counts as earlier. Validators are then checked:
entity tags by weak comparison if both sides have one, else last-modified, else the payload digest that the revisit record names. Header fields of
the 304 overlay the stored ones, except those that describe the stored payload (NOT_MERGED).

The join is a two-level running "last value": inside (URL, time slice), then over one carried row for each URL and slice;
with about sqrt(N) slices, a URL that holds a third of all records is spread over as many tasks.

Defined results: a null URL or time gives status ``missing``; revisits without an earlier response ``missing``; without any common validator
``unvalidated``; with different ones ``mismatch``; only ``resolved`` rows carry a payload and merged headers. Repeated records
resolve each on its own. An empty table gives no rows. Payloads never travel: only digests and ids do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxlake.session import stash, table

#: Fields of a 304 that must not replace the stored ones, as they describe a body that was not sent.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "set-cookie", "transfer-encoding", "upgrade")
#: Query parameters that do not select content.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Scheme, fragment, www., default ports, tracking parameters and trailing slashes go; the host is lower-cased,
    parameters are sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www[0-9]*[.]|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Arrays of (name, value), names in lower case: fresh wins where it may."""
    may = F.filter(fresh, lambda h: ~h["name"].isin(*NOT_MERGED))
    names = F.transform(may, lambda h: h["name"])
    return F.concat(F.filter(stored, lambda h: ~F.array_contains(names, h["name"])), may)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records: record_id, url, fetch_time (long), status, etag, last_modified, digest, headers (HEADERS). One row per
    revisit: record_id, canonical_url, verdict, source_id, source_digest, headers."""
    lower = F.transform(F.coalesce("headers", F.array().cast(HEADERS)), lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "fetch_time", "status", "etag", "last_modified", "digest", lower.alias("headers"))
    rows = stash(rows, "warc")
    seen = rows.agg(F.count("*").alias("n"), F.min("fetch_time").alias("lo"), F.max("fetch_time").alias("hi")).first()
    slices = max(1, math.ceil(math.sqrt(seen["n"])))
    width = max(1, -(-((seen["hi"] or 0) - (seen["lo"] or 0) + 1) // slices))
    fit = F.col("canonical_url").isNotNull() & F.col("fetch_time").isNotNull()
    is_full = (F.col("status") == 200) & F.col("digest").isNotNull()
    kept = F.struct("fetch_time", "record_id", "etag", "last_modified", "digest", "headers")
    known = rows.filter(fit).withColumns({
        "slice": F.floor((F.col("fetch_time") - F.lit(seen["lo"] or 0)) / F.lit(width)),
        "full": F.when(is_full, kept), "late": F.when(is_full, F.lit(0)).otherwise(F.lit(1)),
    })
    key = ["canonical_url", "slice"]
    before = Window.partitionBy(*key).orderBy("fetch_time", "late", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    local = known.withColumn("found", F.last("full", ignorenulls=True).over(before)).filter(F.col("status") == 304)
    ends = known.filter(F.col("full").isNotNull()).groupBy(*key).agg(F.max_by("full", F.struct("fetch_time", "record_id")).alias("full"))
    marks = known.filter(F.col("status") == 304).select(*key).distinct()
    carried = marks.join(ends, key, "full_outer")
    earlier = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumn("carried", F.last("full", ignorenulls=True).over(earlier)).filter(F.col("carried").isNotNull()).select(*key, "carried")
    out = local.join(carried, key, "left").withColumn("found", F.coalesce("found", "carried"))
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    f = F.col("found")
    same = F.coalesce(tag(F.col("etag")) == tag(f["etag"]), F.col("last_modified") == f["last_modified"], F.col("digest") == f["digest"])
    verdict = F.when(f.isNull(), "missing").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")
    ok = F.col("verdict") == "resolved"
    out = out.withColumn("verdict", verdict).select(
        "record_id", "canonical_url", "verdict", F.when(ok, f["record_id"]).alias("source_id"), F.when(ok, f["digest"]).alias("source_digest"),
        F.when(ok, merge_headers(f["headers"], F.col("headers"))).alias("headers"),
    )
    lost = rows.filter(~fit & (F.col("status") == 304)).select(
        "record_id", "canonical_url", F.lit("missing").alias("verdict"), F.lit(None).cast(rows.schema["record_id"].dataType).alias("source_id"), F.lit(None).cast("string").alias("source_digest"), F.lit(None).cast(HEADERS).alias("headers")
    )
    return out.unionByName(lost)


#: Captures between a page's first fetch and its conditional re-fetch in crawl_records.
LAG = 5000


def crawl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl that the pages table stands for: page p is fetched in full at tick p, and asked for again at tick
    p + LAG under the entity tag of that fetch, which the server answers with 304."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("length"))
    both = F.explode(F.array(F.lit(200), F.lit(304)))
    rows = pages.select("*", both.alias("status")).withColumn("tick", F.when(F.col("status") == 200, F.col("page_id")).otherwise(F.col("page_id") + LAG))
    h = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    etag = F.concat(F.lit('"'), F.col("digest"), F.lit('"'))
    first = F.array(h("Content-Type", F.lit("text/html")), h("Content-Length", F.col("length")), h("Date", F.col("tick")), h("ETag", etag))
    again = F.array(h("Date", F.col("tick")), h("Content-Length", F.lit(0)), h("Cache-Control", F.lit("max-age=60")), h("ETag", etag))
    return rows.select(
        F.col("page_id").alias("record_id"), "url", F.col("tick").alias("fetch_time"), "status", etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        "digest", F.when(F.col("status") == 200, first).otherwise(again).alias("headers"),
    )
