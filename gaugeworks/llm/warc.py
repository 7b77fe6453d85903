"""Not-modified revisits of a web archive, resolved by an as-of join.

A revisit record holds no body: the server said that nothing had changed. It takes the body of the
latest earlier full response of the same canonical URL, if their validators agree, and that
response's headers updated by its own as far as a 304 may.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import keyed_join, stored, table

#: Header fields that describe a body or one connection; a revisit's don't replace the response's.
FIXED_FIELDS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that don't change what a URL names.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid|jsessionid|phpsessid)(=|$)"
#: Records of a slice of time, about, and least and most slices, powers of two: each URL's records are cut into them, so that no URL is one task's.
SLICE_ROWS, SLICES, SLICES_MOST = 1_000_000, 256, 65_536


def canonical_url(url: Column) -> Column:
    """Without scheme, www, default port, fragment, tracking parameters and trailing slash; host in
    lower case; parameters sorted. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), r"^www[0-9]*\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's fields, replaced and joined by the revisit's but the fixed ones; names in lower case.
    Of one map's names that are then the same the last as written, in order, counts."""
    mine = F.map_filter(_lowered(revisit), lambda k, _: ~k.isin(*FIXED_FIELDS))
    return F.map_concat(F.map_filter(_lowered(response), lambda k, _: ~F.map_contains_key(mine, k)), mine)


def _lowered(headers: Column) -> Column:
    fields = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(fields, lambda e: e["key"])
    last = lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"])
    return F.map_from_entries(F.filter(fields, last))


def sliced(r: DataFrame) -> DataFrame:
    """``r`` with slice, from 0, by ts: about as many rows each, however ts are spread, in as many slices as the counted rows ask for. Null if ts is."""
    many = min(SLICES_MOST, max(SLICES, 1 << (r.count() // SLICE_ROWS).bit_length()))
    edges = r.agg(F.percentile_approx("ts", [i / many for i in range(1, many)], max(10_000, 20 * many))).first()[0] or []
    edges = F.array(*(F.lit(e).cast("long") for e in edges + [2**63 - 1] * (many - 1 - len(edges))))
    steps = F.array(*(F.lit(1 << k) for k in range(many.bit_length() - 2, -1, -1)))
    # Bisection: how many edges are at most ts.
    found = F.aggregate(steps, F.lit(0), lambda k, s: F.when(F.element_at(edges, k + s) <= F.col("ts"), k + s).otherwise(k))
    return r.withColumn("slice", F.when(F.col("ts").isNotNull(), found))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_url, ts, outcome, source_record, digest, headers.

    records: record_id, url, ts (long), kind ('response' or 'revisit'), etag, last_modified, digest,
    headers (map of strings); other columns are passed over. "Earlier" is a smaller ts; of responses
    with one ts the greatest record_id counts. outcome: 'resolved'; 'changed' if both have an
    etag and these differ (weak marks aside), or, where an etag lacks, both have last_modified and these
    differ; 'no response' if there is none earlier. Only resolved ones take digest and headers.
    Null headers are empty; a null url or ts finds no response; repeated rows are answered each. Responses of one
    URL and ts are one row before anything is sorted, and each revisit is looked up, so no URL or instant is one task's.
    """
    wanted = ("record_id", "url", "ts", "kind", "etag", "last_modified", "digest", "headers")
    r = records.select(*wanted).filter(F.col("kind").isin("response", "revisit")).withColumn("curl", canonical_url(F.col("url")))
    r = r.withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>")))
    answered = F.col("url").isNotNull() & F.col("ts").isNotNull()
    entries = F.array_sort(F.map_entries("headers")).alias("headers")
    # One row for each URL and instant: its greatest response, and whether a revisit asks there. Copies meet before they are dealt out.
    own = F.max(F.when(F.col("kind") == "response", F.struct("record_id", "ts", "etag", "last_modified", "digest", entries))).alias("own")
    points = sliced(r.filter(answered)).groupBy("curl", "slice", "ts").agg(own, F.bool_or(F.col("kind") == "revisit").alias("asked"))
    points = stored(points, "warc-points")
    # Within a slice a window; before it the last response of the URL's earlier slices, of which there are few.
    inside = Window.partitionBy("curl", "slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("curl").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = points.groupBy("curl", "slice").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("ts"))).alias("end"), F.bool_or("asked").alias("wanted"))
    carried = ends.withColumn("carry", F.last("end", True).over(earlier)).filter("wanted and carry is not null").select("curl", "slice", "carry")
    near = points.withColumn("near", F.last("own", True).over(inside)).filter("asked").select("curl", "slice", "ts", "near")
    answers = stored(near.join(carried, ["curl", "slice"], "left").select("curl", "ts", F.coalesce("near", "carry").alias("base")), "warc-answers")
    asks = stored(r.filter("kind = 'revisit'").select("record_id", "url", "curl", "ts", "etag", "last_modified", "headers"), "warc-revisits")
    met = keyed_join(asks.filter(answered), answers, ["curl", "ts"], "left", by=["record_id"]).unionByName(asks.filter(~answered), allowMissingColumns=True)
    base, strong = F.col("base"), lambda e: F.regexp_replace(e, "^W/", "")
    differ = F.when(F.col("etag").isNotNull() & base["etag"].isNotNull(), strong(F.col("etag")) != strong(base["etag"])).otherwise(F.coalesce(F.col("last_modified") != base["last_modified"], F.lit(False)))
    outcome = F.when(base.isNull(), "no response").when(differ, "changed").otherwise("resolved")
    good = F.col("outcome") == "resolved"
    return met.withColumn("outcome", outcome).select(
        "record_id", F.col("curl").alias("canonical_url"), "ts", "outcome", base["record_id"].alias("source_record"),
        F.when(good, base["digest"]).alias("digest"), F.when(good, merged_headers(F.map_from_entries(base["headers"]), F.col("headers"))).alias("headers"),
    )


#: How long after a page's capture the crawler of op5 asks for it again.
AGAIN = 2001


def page_records(pages: DataFrame) -> DataFrame:
    """Every page as a full response at 2 * page_id, and a revisit of its URL AGAIN later with its etag."""
    p = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("tag"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    ts, text = 2 * F.col("page_id"), F.lit("text/html")
    response = p.select(F.concat(F.lit("r"), "page_id").alias("record_id"), "url", ts.alias("ts"), F.lit("response").alias("kind"), F.col("tag").alias("etag"), ts.cast("string").alias("last_modified"), F.col("tag").alias("digest"),
        F.create_map(F.lit("Content-Length"), F.col("n").cast("string"), F.lit("Content-Type"), text, F.lit("Date"), ts.cast("string")).alias("headers"))
    later = ts + AGAIN
    revisit = p.select(F.concat(F.lit("v"), "page_id").alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"), F.concat(F.lit("W/"), "tag").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Date"), later.cast("string"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"))
    return response.unionByName(revisit)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(page_records(table(spark, sf_dir, "pages")))
    fields = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", "canonical_url", "ts", "outcome", "source_record", "digest", fields.alias("headers"))


OP5_SQL = rf"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS tag, strlen(coalesce(html, '')) AS n,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
), q AS (
  SELECT page_id, tag, n,
    regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www[0-9]*\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS head,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '{TRACKING}'))) AS args FROM p
), u AS (
  SELECT page_id, tag, n, head || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS curl FROM q
)
SELECT 'v' || v.page_id AS record_id, v.curl AS canonical_url, 2 * v.page_id + {AGAIN} AS ts,
  CASE WHEN r.page_id IS NULL THEN 'no response' WHEN r.tag <> v.tag THEN 'changed' ELSE 'resolved' END AS outcome,
  'r' || r.page_id AS source_record,
  CASE WHEN r.tag = v.tag THEN r.tag END AS digest,
  CASE WHEN r.tag = v.tag THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || r.n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || (2 * v.page_id + {AGAIN}) END AS headers
FROM u v ASOF LEFT JOIN (SELECT *, 2 * page_id AS ts FROM u) r ON v.curl = r.curl AND 2 * v.page_id + {AGAIN} > r.ts
"""
