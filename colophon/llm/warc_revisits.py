"""WARC: not-modified revisit resolution.

A revisit (status 304) is joined as of its time to the latest earlier full response (status 200) of the
same canonical URL; its validators are checked against that response (strong or weak ETag first, then
Last-Modified), and the headers that a 304 may update are merged over the stored ones (RFC 9110 15.4.5,
RFC 9111 3.2).

The as-of join is a window, but not one of a whole URL: captures are dealt by ranges of URL and time, the last
response of a URL in each range is a small table, a window over that gives what a range starts with, and a window
inside the range does the rest. Ranges follow the captures, not the clock: a URL with a third of all captures is dealt over
a third of the ranges, however its times lie.

Defined results: a null url has no canonical form and is resolved to nothing ('no_response'); equal
times order by record_id, and a response counts as earlier only if its (ts, record_id) is smaller; null times and
ids come first; null headers are empty; repeated records are resolved each, and of responses with one time and id the one
whose headers sort last counts; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.common import written

#: Header fields of a 304 that never replace stored ones: fixed values from RFC 9111 3.2 and RFC 9110 7.6.1.
KEPT_FIELDS = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer",
    "transfer-encoding", "upgrade", "content-encoding", "content-length", "content-range", "content-type",
)


def canonical_url(url: Column) -> Column:
    """Host without www. or m. in lower case, path without index or last slash, and the query less tracking, sorted; no scheme or fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^(www|m)\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/index\.html?$", "/"), "/+$", "")
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.sort_array(F.filter(query, lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid|sessionid)=")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _lower_keys(headers: Column) -> Column:
    """Field names in lower case; of fields that then have one name, the one that sorts last."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda o: o["key"] == e["key"])))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored fields, updated by those that a 304 may update."""
    fields = F.lit(list(KEPT_FIELDS)).cast("array<string>")
    allowed = F.map_filter(fresh, lambda k, v: ~F.array_contains(fields, k))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """revisit_id, canonical_url, response_id, outcome and headers (merged; null unless resolved) of every revisit.

    records: record_id long, url, ts long, status int, headers map<string,string>.
    outcome: resolved, no_response or validator_mismatch.
    """
    rows = records.filter("status IN (200, 304)").select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "status", _lower_keys(F.col("headers")).alias("fields")
    )
    response = F.when((F.col("status") == 200) & F.col("canonical").isNotNull(), F.struct("record_id", "fields"))
    # rows without a URL have no earlier response; their record_id keeps them out of one large group
    key = F.coalesce("canonical", F.concat(F.lit("\x00"), F.col("record_id").cast("string")))
    dealt = rows.withColumns({"response": response, "key": key}).repartitionByRange("key", "ts", "record_id", F.desc("status"))
    spans = written(dealt.withColumn("span", F.spark_partition_id()), "revisit-spans")
    order = F.struct("ts", "record_id", F.array_sort(F.map_entries("fields")).alias("entries"))
    last = spans.groupBy("key", "span").agg(F.max_by("response", F.when(F.col("response").isNotNull(), order)).alias("last"))
    before = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = last.select(F.col("key").alias("k"), F.col("span").alias("s"), F.last("last", ignorenulls=True).over(before).alias("carried"))
    # revisits come before responses of their own time and id, which are not earlier
    inside = Window.partitionBy("key", "span").orderBy("ts", "record_id", F.desc("status"), F.array_sort(F.map_entries("fields"))).rowsBetween(Window.unboundedPreceding, -1)
    found = (
        spans.withColumn("inner", F.last("response", ignorenulls=True).over(inside))
        .filter("status = 304")
        .join(starts, (F.col("key") == F.col("k")) & (F.col("span") == F.col("s")), "left")
        .withColumn("full", F.coalesce("inner", "carried"))
    )
    strong = lambda x: F.regexp_replace(F.get(F.array(x), F.lit(0)), "^W/", "")
    mine, its = F.col("fields"), F.col("full.fields")
    by_tag = strong(mine["etag"]) == strong(its["etag"])
    by_date = mine["last-modified"] == its["last-modified"]
    valid = F.coalesce(F.when(mine["etag"].isNotNull() & its["etag"].isNotNull(), by_tag).otherwise(by_date), F.lit(False))
    outcome = F.when(F.col("full").isNull(), "no_response").when(valid, "resolved").otherwise("validator_mismatch")
    return found.select(
        F.col("record_id").alias("revisit_id"),
        F.col("canonical").alias("canonical_url"),
        F.col("full.record_id").alias("response_id"),
        outcome.alias("outcome"),
        F.when(valid, merged_headers(its, mine)).alias("headers"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A capture history of the pages: each is fetched at time page_id and revisited at another.

    The response's ETag is the digest of the html. The revisit at page_id + 100 carries the same tag, or a
    weak form of it, or none but a date, or a tag of another version, by page_id mod 4. Where 7 divides page_id the revisit
    is at page_id - 1, before the page's own response: its response is that of an earlier page, or there is none.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    date = F.concat(F.lit("day "), F.floor(F.col("page_id") / 10).cast("string"))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"),
        "url",
        F.col("page_id").alias("ts"),
        F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), date, F.lit("Content-Length"), size, F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
    )
    kind = F.pmod("page_id", F.lit(4))
    sent = F.when(kind == 0, tag).when(kind == 1, F.concat(F.lit("W/"), tag)).when(kind == 3, F.lit('"other"'))
    common = [F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.concat(F.lit("max-age="), F.col("page_id").cast("string"))]
    back = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        "url",
        (F.col("page_id") + F.when(F.col("page_id") % 7 == 0, -1).otherwise(100)).alias("ts"),
        F.lit(304).alias("status"),
        F.when(kind == 2, F.create_map(F.lit("last-modified"), date, *common)).otherwise(F.create_map(F.lit("etag"), sent, *common)).alias("headers"),
    )
    return full.unionByName(back)


def revisit_report(pages: DataFrame) -> DataFrame:
    """revisit_id, canonical_url, response_id (-1: none), outcome and merged (headers as name=value lines, sorted) of every revisit."""
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return resolve_revisits(records_of_pages(pages)).select(
        "revisit_id", "canonical_url", F.coalesce("response_id", F.lit(-1)).alias("response_id"), "outcome", F.array_join(lines, "\n").alias("merged")
    )


ORACLE = r"""
WITH b AS (
  SELECT page_id, md5(coalesce(html, '')) AS tag, strlen(coalesce(html, '')) AS size, floor(page_id / 10)::BIGINT AS day,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
), u AS (
  SELECT *, regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^(www|m)\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/index\.html?$', '/'), '/+$', '') AS place,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)='))) AS query FROM b
), c AS (SELECT *, place || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS canonical FROM u),
v AS (SELECT *, row_number() OVER () AS row, CASE WHEN page_id % 7 = 0 THEN page_id - 1 ELSE page_id + 100 END AS back FROM c),
j AS (
  SELECT r.page_id * 2 + 1 AS revisit_id, r.canonical, f.row AS f_row, f.page_id AS f_id, f.tag AS f_tag, r.tag AS r_tag, f.day AS f_day, r.day AS r_day, f.size, r.page_id,
         row_number() OVER (PARTITION BY r.row ORDER BY f.page_id DESC NULLS LAST, f.size::VARCHAR DESC, f.tag DESC) AS n
  FROM v r LEFT JOIN v f ON f.canonical = r.canonical AND r.page_id IS NOT NULL AND (f.page_id IS NULL OR f.page_id < r.back OR (f.page_id = r.back AND f.page_id * 2 < r.page_id * 2 + 1))
), o AS (
  SELECT *, CASE WHEN f_row IS NULL THEN 'no_response'
    WHEN page_id % 4 IN (0, 1) AND f_tag = r_tag OR page_id % 4 = 2 AND f_day = r_day THEN 'resolved' ELSE 'validator_mismatch' END AS outcome
  FROM j WHERE n = 1
)
SELECT revisit_id, canonical AS canonical_url, coalesce(f_id * 2, -1) AS response_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control=max-age=' || page_id || chr(10) || 'content-length=' || size || chr(10) || 'etag='
    || CASE WHEN page_id % 4 = 1 THEN 'W/' ELSE '' END || '"' || f_tag || '"' || coalesce(chr(10) || 'last-modified=day ' || f_day, '') END AS merged
FROM o
"""
