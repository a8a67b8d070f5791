"""Not-modified revisits: each 304 record gets the latest earlier full response of its address.

The as-of look-up runs per canonical URL over record times cut into ranges: the latest response of each
range is carried to the later ranges of its address, and inside a range a running maximum finds the one
before each record.  What is carried is the whole response (number, validators, headers), so nothing is
joined by response: an address with a large share of all captures, or one response with very many
revisits, is spread over many tasks.  The found response counts only if the validators agree: equal entity
tags (weak marks aside) where the revisit has one, else equal ``last_modified``.  Headers that a
not-modified answer may renew replace those of the response.

Only DataFrame functions are used.  Defined results:

- One row per revisit row, repeated rows and ids included; full responses give none, nor do other states.
- NULL url or time, or no full response at an earlier time: ``no_origin``; no agreeing validator:
  ``mismatch``, without headers.
- Earlier means a smaller time.  Of responses with equal time the greatest record_id counts, then the
  greatest entity tag, ``last_modified`` and headers (NULL is least).
- NULL headers count as none; no rows give no rows; other columns are not read.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

#: Header fields that a 304 answer may renew.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Times of one range: 2 ** RANGE_BITS.
RANGE_BITS = 12


def canonical(url):
    """Address without scheme, fragment and closing slash, host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z]+://", ""), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    return F.regexp_replace(F.concat(host, F.substr(bare, F.length(host) + 1)), "/$", "")


def latest_before(rows, range_bits=RANGE_BITS):
    """Adds ``origin``, the latest full response of the same ``key`` before ``ts`` (both not NULL)."""
    rows = rows.withColumn("range", F.shiftright("ts", range_bits))
    response = F.when(F.col("status") == 200, F.struct(
        "ts", "record_id", "etag", "last_modified", F.array_sort(F.map_entries("headers")).alias("headers")))
    across = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("key", "range").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("key", "range").agg(F.max(response).alias("last")).select(
        "key", "range", F.last("last", ignorenulls=True).over(across).alias("carry"))
    near = rows.withColumn("near", F.max(response).over(inside)).filter("status = 304")
    return near.join(carried, ["key", "range"]).withColumn("origin", F.coalesce("near", "carry")).drop("range", "near", "carry")


def resolve_revisits(records, range_bits=RANGE_BITS):
    """``record_id, url, ts, status, etag, last_modified, headers`` to one row per revisit (status 304)."""
    none = F.create_map().cast("map<string,string>")
    rows = records.filter("status IN (200, 304)").select(
        "record_id", canonical(F.col("url")).alias("key"), F.col("ts").cast("long").alias("ts"), "status", "etag", "last_modified",
        F.coalesce("headers", none).alias("headers"))
    placed = F.col("key").isNotNull() & F.col("ts").isNotNull()
    found = latest_before(rows.filter(placed), range_bits).unionByName(
        rows.filter(~placed & (F.col("status") == 304)), allowMissingColumns=True)
    strong = lambda c: F.regexp_replace(c, "^W/", "")
    agrees = F.coalesce(F.when(F.col("etag").isNotNull(), strong(F.col("etag")) == strong(F.col("origin.etag"))).otherwise(
        F.col("last_modified") == F.col("origin.last_modified")), F.lit(False))
    may = lambda k: F.lower(k).isin(*RENEWED)
    fresh = F.map_filter("headers", lambda k, v: may(k))
    names = F.transform(F.map_keys(fresh), lambda k: F.lower(k))
    held = F.map_filter(F.map_from_entries("origin.headers"), lambda k, v: ~F.array_contains(names, F.lower(k)))
    state = F.when(F.col("origin").isNull(), "no_origin").when(agrees, "resolved").otherwise("mismatch")
    return found.select("record_id", F.col("origin.record_id").alias("origin_id"), state.alias("state"),
                        F.when(state == "resolved", F.map_concat(held, fresh)).alias("headers"))


#: Clock of the query's captures.
CLOCK, STEP, VERSION = 1_000_003, 700_001, 250_000


def records_of(pages):
    """One capture of each page, as a state of its domain's English or other address.

    A few addresses hold all captures.  Times repeat and differ from the order of the ids.  Every third
    page is a full response; an address changes its version every ``VERSION`` ticks, which stands in the
    entity tag, or for every fifth revisit in ``last_modified`` alone, which odd responses lack.
    """
    page = F.col("page_id")
    full = page % 3 == 0
    host = F.concat(F.lit("http://"), F.regexp_extract("url", r"([^./]+\.[^./:]+)(:[0-9]*)?(/|$)", 1))
    side = F.when(F.col("url").contains("/en/"), F.lit("/en")).otherwise(F.lit("/other/"))
    ts = page * STEP % CLOCK
    version = F.expr(f"page_id * {STEP} % {CLOCK} DIV {VERSION}").cast("string")
    tag = F.concat(F.lit("v"), version)
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    return pages.select(
        page.alias("record_id"), F.concat(host, side).alias("url"), ts.alias("ts"), F.when(full, 200).otherwise(304).alias("status"),
        F.when(full, tag).when(page % 5 != 0, F.concat(F.lit("W/"), tag)).alias("etag"),
        F.when(~full | (page % 2 == 0), version).alias("last_modified"),
        F.when(full, F.create_map(F.lit("Date"), ts.cast("string"), F.lit("Content-MD5"), digest)).otherwise(
            F.create_map(F.lit("date"), ts.cast("string"), F.lit("Content-Length"), F.lit("0"))).alias("headers"))


SQL = rf"""
WITH p AS (SELECT page_id AS id, page_id * {STEP} % {CLOCK} AS ts, (page_id * {STEP} % {CLOCK} // {VERSION})::VARCHAR AS ver,
    md5(coalesce(html, '')) AS digest, regexp_extract(url, '([^./]+\.[^./:]+)(:[0-9]*)?(/|$)', 1) AS host, contains(url, '/en/') AS en FROM pages),
c AS (SELECT id, ts, ver, digest, lower(host) || CASE WHEN en THEN '/en' ELSE '/other' END AS key FROM p),
f AS (SELECT key, ts, max(id) AS origin_id, arg_max(ver, id) AS o_ver, arg_max(digest, id) AS o_digest
      FROM c WHERE id % 3 = 0 AND key IS NOT NULL GROUP BY key, ts),
j AS (SELECT q.id, q.ts, q.ver, f.origin_id, f.o_digest, CASE WHEN f.origin_id IS NULL THEN 'no_origin'
        WHEN q.ver = f.o_ver AND (q.id % 5 <> 0 OR f.origin_id % 2 = 0) THEN 'resolved' ELSE 'mismatch' END AS state
      FROM (SELECT * FROM c WHERE id % 3 <> 0) q ASOF LEFT JOIN f ON q.key = f.key AND q.ts > f.ts)
SELECT id AS record_id, origin_id, state,
  CASE WHEN state = 'resolved' THEN 'Content-MD5=' || o_digest || ',date=' || ts END AS headers FROM j
"""
