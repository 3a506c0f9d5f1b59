"""Resolving not-modified revisit records against the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

#: Headers a 304 may update; all others come from the stored response.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Records of one slice of time, about, and the fewest slices.
SLICE_ROWS, SLICES = 500_000, 256


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, default port or trailing slash, query parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1))
    place = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)
    # A name and password before the host keep their case.
    head = F.concat(scheme, F.regexp_extract(place, r"^(.*@)", 1), F.lower(F.regexp_replace(place, r"^.*@", "")))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://[^/]*):80$", "$1"), r"^(https://[^/]*):443$", "$1")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    return F.concat(head, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))))


def _lower_names(headers: Column) -> Column:
    """``headers`` with names in lower case; of names that differ in case alone the last one counts. Null is empty."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    low = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(low, lambda e, i: ~F.exists(F.slice(low, i + 2, F.size(low)), lambda f: f["key"] == e["key"]))
    return F.map_from_entries(last)


def resolve_revisits(records: DataFrame, slices: int | None = None) -> DataFrame:
    """One row per revisit of ``records`` (record_id, kind, url, at, etag, last_modified, headers map).

    Returns record_id, url_key, resolved_id, status, headers. The as-of join takes the latest response strictly earlier
    in (at, record_id) with the same canonical URL. status: "resolved"; "mismatch" where a validator both sides carry
    differs; "unchecked" where they share none; "missing" without an earlier response (also for a null URL or time).
    Headers are the response's, overlaid with the permitted ones of the revisit when resolved; names compare in any case and come out in
    lower case. Null headers are none; an empty table gives an empty result; other columns are ignored. Records of one time come in the order of their id.

    A URL may hold most rows: records are cut into ``slices`` by ranges of (at, record_id), as many as their number asks for, also where most are of one time; ``at`` is of any
    type that has an order. The latest response of each (URL, slice) is found with a map-side combine and carried forward over at most ``slices`` rows per URL, so the row-wise
    window runs per (URL, slice). Repeated rows each get a result; payloads are not moved.
    """
    r = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url_key"), "at", "etag", "last_modified", "headers")
    live = r.where("url_key is not null and at is not null")
    slices = slices or max(SLICES, -(-live.count() // SLICE_ROWS))
    live = stage(live.repartitionByRange(slices, "at", "record_id").withColumn("slice", F.spark_partition_id()), "records")
    order = F.struct("at", "record_id")
    full = F.struct("record_id", "etag", "last_modified", "headers")
    lasts = live.where("kind = 'response'").groupBy("url_key", "slice").agg(F.max_by(full, order).alias("here"))
    marks = lasts.unionByName(live.select("url_key", "slice").distinct().withColumn("here", F.lit(None).cast(lasts.schema["here"].dataType)))
    marks = marks.groupBy("url_key", "slice").agg(F.first("here", ignorenulls=True).alias("here"))
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("url_key", "slice", F.last("here", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("url_key", "slice").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = live.withColumn("near", F.last(F.when(F.col("kind") == "response", full), ignorenulls=True).over(inside)).where("kind = 'revisit'")
    joined = seen.join(carried, ["url_key", "slice"], "left").withColumn("base", F.coalesce("near", "carried")).drop("near", "carried", "slice")
    lost = r.where("kind = 'revisit' and (url_key is null or at is null)").withColumn("base", F.lit(None).cast(lasts.schema["here"].dataType))
    both = joined.unionByName(lost)
    same = [F.col(v) == F.col(f"base.{v}") for v in ("etag", "last_modified")]
    status = (
        F.when(F.col("base").isNull(), "missing").when(~F.coalesce(same[0], F.lit(True)) | ~F.coalesce(same[1], F.lit(True)), "mismatch")
        .when(same[0].isNull() & same[1].isNull(), "unchecked").otherwise("resolved")
    )
    allowed = F.map_filter(_lower_names(F.col("headers")), lambda k, v: k.isin(PERMITTED))
    old = _lower_names(F.col("base.headers"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    return both.withColumn("status", status).select(
        "record_id", "url_key", F.col("base.record_id").alias("resolved_id"), "status",
        F.when(F.col("status") == "resolved", merged).otherwise(old).alias("headers"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """Crawl records of ``pages``: each page answered in full at 2 * page_id and asked again up to 2000 steps later.

    The address is the page's folder, so between the two other pages of it may be answered. Pages with page_id divisible by 5 report another
    validator when asked again, those by 7 are only asked again.
    """
    etag = F.md5(F.coalesce("html", F.lit("")))
    pages = pages.withColumn("url", F.regexp_replace("url", "[^/]*$", ""))
    first = pages.where("page_id % 7 <> 0 or page_id is null").select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", (F.col("page_id") * 2).alias("at"), etag.alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), F.create_map(F.lit("etag"), etag, F.lit("server"), F.lit("a")).alias("headers"))
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", (F.col("page_id") * 2 + 1 + F.col("page_id") * 7919 % 1000 * 2).alias("at"),
        F.when(F.col("page_id") % 5 == 0, F.lit("other")).otherwise(etag).alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("expires"), F.lit("0"), F.lit("server"), F.lit("b")).alias("headers"))
    return first.unionByName(again)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return out.withColumn("headers", F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"))


SQL = """
WITH p AS (SELECT page_id, md5(coalesce(html, '')) AS etag, regexp_replace(trim(regexp_replace(url, '[^/]*$', '')), '#.*$', '') AS bare FROM pages),
q AS (SELECT *, regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*://)', 1) AS scheme, regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1) AS place,
 regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS rest FROM p),
k AS (SELECT page_id, etag, regexp_replace(regexp_replace(lower(scheme) || regexp_extract(place, '^(.*@)', 1) || lower(regexp_replace(place, '^.*@', '')),
 '^(http://[^/]*):80$', '\\1'), '^(https://[^/]*):443$', '\\1') || regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') ||
 CASE WHEN regexp_extract(rest, '\\?(.*)$', 1) = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&')), '&') END AS url_key FROM q),
v AS (SELECT page_id * 2 + 1 AS record_id, url_key, page_id * 2 + 1 + page_id * 7919 % 1000 * 2 AS at, CASE WHEN page_id % 5 = 0 THEN 'other' ELSE etag END AS etag FROM k),
r AS (SELECT page_id * 2 AS resolved_id, url_key, page_id * 2 AS at, etag FROM k WHERE page_id % 7 <> 0)
SELECT v.record_id, v.url_key, r.resolved_id, CASE WHEN r.resolved_id IS NULL THEN 'missing' WHEN v.etag <> r.etag THEN 'mismatch' ELSE 'resolved' END AS status,
 CASE WHEN r.resolved_id IS NULL THEN '' WHEN v.etag <> r.etag THEN 'etag=' || r.etag || ';server=a' ELSE 'etag=' || r.etag || ';expires=0;server=a' END AS headers
FROM v ASOF LEFT JOIN r ON v.url_key = r.url_key AND v.at > r.at
"""
