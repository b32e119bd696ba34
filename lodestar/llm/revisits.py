"""Not-modified revisits of web captures resolved to the responses they stand for (operator 2).

Captures: record_id, url, ts, kind ('response' or 'revisit'), status, etag,
last_modified, headers (map), payload. Each revisit (status 304) is joined as of
its time to the latest earlier full response (status 200) of the same canonical
URL. A validator that both have must agree: the etag first (weak comparison), else
last_modified. The resolved capture has the response's payload and its headers,
updated by those headers of the revisit that a 304 may carry.

The as-of join needs no range comparison: per URL and block of time the last full
response is one row, a window over those few rows carries it into later blocks,
and a window within a block finds it for every capture. A URL that holds a third
of all rows is so dealt out over its blocks.

Nulls and edges: captures with a null url or ts are unresolved. Of captures at
one time the smaller record_id is the earlier; null record_ids come first. A
revisit without an earlier response, or whose validators differ, is kept with
``outcome`` 'no_response' or 'validator_mismatch' and a null payload; one with no
validator on either side in common is 'unvalidated', and resolved. Header names
that differ in case only are one, and the later entry counts. Captures that repeat a
(record_id, url, ts) are resolved each, to one response. Payloads are never compared or
cut, however long. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the header fields that a 304 response updates (RFC 9110, 15.4.5; RFC 9111, 3.2)
UPDATED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified", "age")


def canonical(url: Column) -> Column:
    """Lower-case host without scheme, 'www.' or 'm.', path without a final slash or '.html', no query or fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.substring_index(bare, "/", 1)), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^[^/]*", ""), r"/+$", ""), r"\.html$", "")
    return F.concat(host, path)


def strong(etag: Column) -> Column:
    """An etag for the weak comparison."""
    return F.regexp_replace(etag, "^W/", "")


def folded(headers: Column) -> Column:
    """Headers by name in lower case; of names that differ in case only the later entry counts."""
    none = F.create_map().cast("map<string,string>")
    add = lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"]))
    return F.aggregate(F.map_entries(F.coalesce(headers, none)), none, add)


def resolve_revisits(captures: DataFrame, block: int = 4096) -> DataFrame:
    """record_id, url, canonical_url, ts, refers_to, outcome, headers, payload of each revisit. ts: a long; block: its length of a time block."""
    c = captures.select("record_id", "url", canonical(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), "kind", "status", "etag", "last_modified", "headers", "payload").withColumn("part", F.floor(F.col("ts") / block))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("ts").isNotNull() & F.col("canonical_url").isNotNull()
    at = F.struct("ts", "record_id")
    last = c.where(full).groupBy("canonical_url", "part").agg(F.max(at).alias("at"))
    parts = c.where("ts is not null and canonical_url is not null").select("canonical_url", "part").distinct().join(last, ["canonical_url", "part"], "left")
    before = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("canonical_url", "part", F.last("at", ignorenulls=True).over(before).alias("carried"))
    # only the keys of captures go through the windows; payloads join at the end, once for each revisit
    keys = c.where("canonical_url is not null and ts is not null").select("record_id", "canonical_url", "ts", "part", "kind", "status")
    within = Window.partitionBy("canonical_url", "part").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    found = keys.withColumn("own", F.last(F.when(full, at), ignorenulls=True).over(within)).where((F.col("kind") == "revisit") & (F.col("status") == 304)).join(carried, ["canonical_url", "part"], "left")
    points = found.select("record_id", "canonical_url", "ts", F.coalesce("own", "carried").alias("to")).select("record_id", "canonical_url", "ts", F.col("to.record_id").alias("to_id"), F.col("to.ts").alias("to_ts"))
    revisit = c.where("kind = 'revisit' and status = 304").select("record_id", "canonical_url", "ts", "url", "etag", "last_modified", "headers")
    response = c.where(full).select(F.col("record_id").alias("to_id"), F.col("canonical_url").alias("to_url"), F.col("ts").alias("to_ts"), F.col("etag").alias("to_etag"), F.col("last_modified").alias("to_modified"), F.col("headers").alias("to_headers"), F.col("payload").alias("to_payload"))
    r, p = revisit.alias("r"), points.dropDuplicates().alias("p")
    same = F.col("r.record_id").eqNullSafe(F.col("p.record_id")) & F.col("r.canonical_url").eqNullSafe(F.col("p.canonical_url")) & F.col("r.ts").eqNullSafe(F.col("p.ts"))
    pointed = r.join(p, same, "left").select("r.*", "p.to_id", "p.to_ts")
    full_row = response.dropDuplicates(["to_id", "to_url", "to_ts"]).alias("f")
    joined = pointed.join(full_row, pointed["to_id"].eqNullSafe(F.col("f.to_id")) & (pointed["canonical_url"] == F.col("f.to_url")) & (pointed["to_ts"] == F.col("f.to_ts")), "left").select(pointed["*"], "f.to_etag", "f.to_modified", "f.to_headers", "f.to_payload")
    tagged = F.col("etag").isNotNull() & F.col("to_etag").isNotNull()
    dated = F.col("last_modified").isNotNull() & F.col("to_modified").isNotNull()
    outcome = (
        F.when(F.col("to_ts").isNull(), "no_response")
        .when(tagged, F.when(strong(F.col("etag")) == strong(F.col("to_etag")), "validated").otherwise("validator_mismatch"))
        .when(dated, F.when(F.col("last_modified") == F.col("to_modified"), "validated").otherwise("validator_mismatch"))
        .otherwise("unvalidated")
    )
    good = F.col("outcome").isin("validated", "unvalidated")
    fresh = F.map_filter(folded(F.col("headers")), lambda k, v: k.isin(*UPDATED))
    kept = F.map_filter(folded(F.col("to_headers")), lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    return joined.withColumn("outcome", outcome).select(
        "record_id", "url", "canonical_url", "ts", F.when(good, F.col("to_id")).alias("refers_to"), "outcome", F.when(good, F.map_concat(kept, fresh)).alias("headers"), F.when(good, F.col("to_payload")).alias("payload")
    )


def captures_of(pages: DataFrame, every: int = 3) -> DataFrame:
    """A crawl log from pages: each is a full response at ts = page_id, and visited again, not modified, ``every`` * 8192 ticks later.

    The etag is a digest of the page. The revisits of pages whose id leaves 1 modulo
    7 carry another page's etag, those that leave 2 carry none.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), F.col("page_id").cast("string"), F.lit("ETag"), tag).alias("headers"), F.col("html").alias("payload"),
    )
    other = F.when(F.col("page_id") % 7 == 1, F.lit('"0"')).when(F.col("page_id") % 7 != 2, F.concat(F.lit("W/"), tag))
    later = (F.col("page_id") + every * 8192).alias("ts")
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", later, F.lit("revisit").alias("kind"), F.lit(304).alias("status"), other.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("Date"), (F.col("page_id") + every * 8192).cast("string"), F.lit("Content-Type"), F.lit("ignored")).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return full.unionByName(again)


SQL = r"""
WITH p AS (SELECT page_id, url, html, '"' || substr(md5(html), 1, 16) || '"' AS tag,
  regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
q AS (SELECT *, regexp_replace(lower(split_part(bare, '/', 1)), '^(www|m)\.', '') || regexp_replace(regexp_replace(regexp_replace(bare, '^[^/]*', ''), '/+$', ''), '\.html$', '') AS canonical_url FROM p),
v AS (SELECT page_id * 2 + 1 AS record_id, url, canonical_url, page_id + 3 * 8192 AS ts, CASE WHEN page_id % 7 = 1 THEN '"0"' WHEN page_id % 7 <> 2 THEN tag END AS etag FROM q),
j AS (SELECT v.*, q.page_id AS to_page, q.tag AS to_tag, q.html FROM v ASOF LEFT JOIN q ON v.canonical_url = q.canonical_url AND v.ts > q.page_id),
o AS (SELECT *, CASE WHEN to_page IS NULL THEN 'no_response' WHEN etag IS NULL THEN 'unvalidated' WHEN etag = to_tag THEN 'validated' ELSE 'validator_mismatch' END AS outcome FROM j)
SELECT record_id, canonical_url, ts, outcome, CASE WHEN outcome IN ('validated', 'unvalidated') THEN to_page * 2 END AS refers_to,
  CASE WHEN outcome IN ('validated', 'unvalidated') THEN 'content-type=text/html;date=' || CAST(ts AS VARCHAR) || ';etag=' || to_tag END AS headers,
  CASE WHEN outcome IN ('validated', 'unvalidated') THEN md5(html) END AS payload_md5 FROM o"""
