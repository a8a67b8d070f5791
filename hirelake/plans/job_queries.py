"""Queries over whole jobs: normalising, matching, merging, streaming ingest, admission."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab
from ..operators import admission, merge
from ..operators import normalise as norm
from ..operators.ordering import store_order
from ..schema import POSTING_SCHEMA, conform
from ..session import cut_lineage, scratch_path
from ..sources import store
from ..streaming.ingest import ingest_stream as start_ingest
from .feed_queries import as_of
from .registry import query, spread
from .registry import table as _table
from .scalar_queries import _JT, _YEARS, _word_cases
from .views import RAW, v_post, v_raw, with_views

_c = F.col


def table(spark, sf_dir, name):
    return spread(_table(spark, sf_dir, name))


_LEVEL = (f"CASE {_word_cases(vocab.EXPERIENCE_WORDS, 't')} WHEN {_YEARS} = '' THEN 'unknown' WHEN CAST({_YEARS} AS INT) <= 1 THEN 'entry' "
          f"WHEN CAST({_YEARS} AS INT) <= 3 THEN 'junior' WHEN CAST({_YEARS} AS INT) <= 5 THEN 'mid' WHEN CAST({_YEARS} AS INT) <= 8 THEN 'senior' ELSE 'lead' END")
_PLACE = "CASE arrival % 3 WHEN 0 THEN 'Nairobi, Kenya' WHEN 1 THEN 'Plant 7, London' ELSE 'Lagos' END"


def _raw(spark, sf_dir):
    raw = v_raw(spark, sf_dir).withColumns({
        "location": F.expr(_PLACE), "salary_text": F.concat(F.lit("KES "), (_c("arrival") + 1).cast("string"), F.lit(" - 9000000 per year")),
        "posted_text": F.lit("2024-02-03")})
    return raw.withColumnRenamed("url", "job_url").drop("text", "lang")


def _norm_sql(currency, pay_interval, region="CASE WHEN arrival % 3 = 1 THEN 'Plant 7' END"):
    return with_views(f"""
SELECT arrival, title,
  CASE {_JT} ELSE 'unknown' END AS job_type, {_LEVEL} AS level,
  CASE arrival % 3 WHEN 0 THEN 'Nairobi' WHEN 1 THEN 'London' ELSE 'Lagos' END AS city, {region} AS region,
  (arrival + 1) || ' - 9000000' AS salary_text, CAST(arrival + 1 AS DOUBLE) AS salary_min, {currency} AS currency, {pay_interval} AS pay_interval,
  source AS sources, '2024-02-03 00:00:00' AS posted
FROM (SELECT *, lower(title || ' ' || description) AS t, lower(title || ' ' || substr(description, 1, 300)) AS head FROM v_raw)""")


def _shown(df):
    return df.select("arrival", "title", "job_type", _c("experience_level").alias("level"), _c("location_city").alias("city"),
                     _c("location_region").alias("region"), "salary_text", "salary_min", _c("salary_currency").alias("currency"),
                     _c("salary_interval").alias("pay_interval"), F.array_join("aggregated_sources", "|").alias("sources"),
                     F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted"))


@query("normalise", _norm_sql("'KES'", "'year'"))
def normalise(spark, sf_dir):
    return _shown(norm.normalise(_raw(spark, sf_dir), as_of()))


# A hybrid posting carries "(Hybrid)" in its stored location, which becomes part of a token.
_HYBRID = " OR ".join(f"contains(t, '{w}')" for w in vocab.WORKPLACE_WORDS[1][1])
_NOT_REMOTE = " AND ".join(f"NOT contains(t, '{w}')" for w in vocab.WORKPLACE_WORDS[0][1])
_REGION_AGAIN = (f"CASE WHEN arrival % 3 = 1 THEN 'Plant 7' WHEN ({_HYBRID}) AND {_NOT_REMOTE} THEN "
                 "CASE WHEN arrival % 3 = 0 THEN 'Kenya (Hybrid)' ELSE 'Lagos (Hybrid)' END END")
_CUR = "regexp_extract(head, '(ksh|kes|\\$|usd|eur|€|gbp|£)', 1)"


@query("renormalise", _norm_sql(
    f"CASE {_CUR} WHEN 'ksh' THEN 'KES' WHEN 'kes' THEN 'KES' WHEN '$' THEN 'USD' WHEN 'usd' THEN 'USD' WHEN '€' THEN 'EUR' WHEN 'eur' THEN 'EUR' "
    "WHEN '£' THEN 'GBP' WHEN 'gbp' THEN 'GBP' END",
    r"nullif(regexp_extract(head, '(?:^|[^\pL\pN_])(hour|day|week|month|year|annum)(?:$|[^\pL\pN_])', 1), '')", _REGION_AGAIN))
def renormalise(spark, sf_dir):
    return _shown(norm.renormalise(norm.normalise(_raw(spark, sf_dir), as_of()), as_of()))


def _postings(df):
    """Fill what a derived view leaves out."""
    moments = {n: F.coalesce(_c(n) if n in df.columns else F.lit(None).cast("timestamp"), as_of())
               for n in ("posted_at", "scraped_at", "discovered_at")}
    full = conform(df.withColumns(moments), T.StructType([*POSTING_SCHEMA.fields, df.schema["arrival"]])).withColumns({
        n: F.coalesce(n, F.lit(v)) for n, v in (
            ("job_type", "unknown"), ("experience_level", "unknown"), ("workplace_type", "unknown"), ("source_type", "scraped"),
            ("description", ""), ("description_html", ""), ("source_website", ""), ("company", ""), ("location", "Remote"))})
    full = full.withColumns({"description_sections": F.coalesce("description_sections", F.array().cast(full.schema["description_sections"].dataType)),
                             **{n: F.coalesce(n, F.array().cast("array<string>")) for n in ("skills", "tags")},
                             "aggregated_sources": F.coalesce("aggregated_sources", F.array("source"))})
    # Rows that share an id go with each of its arrivals; all others keep their own.
    shared = cut_lineage(df.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND id IS NOT NULL").select("id"))
    if shared.isEmpty():
        return full.filter(_c("id").isNotNull())
    keep = df.join(shared, "id", "left_semi").select("arrival", _c("id").alias("_id"))
    twice = full.drop("arrival").join(keep, _c("id") == _c("_id")).drop("_id")
    return full.filter(_c("id").isNotNull()).join(shared, "id", "left_anti").unionByName(twice)


def _order_postings(spark, sf_dir):
    """Each order as a repeated posting of its customer; every third order comes from one feed."""
    o = table(spark, sf_dir, "orders")
    k, cust = _c("o_orderkey"), _c("o_custkey").cast("string")
    skills = F.array(F.lower("o_orderstatus"), F.lit("sql"))
    return _postings(o.select(
        k.alias("arrival"), F.concat(F.lit("o"), k.cast("string")).alias("id"), F.when(k % 3 == 0, "remoteok").otherwise("lever").alias("source"),
        F.concat(F.lit("Role "), cust).alias("title"), F.lit("Acme").alias("company"),
        F.when(k % 4 == 0, "Kenya").otherwise("Berlin").alias("location"),
        F.when(k % 5 != 0, F.concat(F.lit("R"), (k % 7).cast("string"))).alias("location_region"),
        F.concat(F.lit("https://c.example/"), cust).alias("job_url"), F.concat(F.lit("https://c.example/"), cust).alias("canonical_url"),
        _c("o_orderdate").cast("timestamp").alias("posted_at"), skills.alias("skills"), skills.alias("tags")))


@query("match_signatures", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND s.s_suppkey IS NOT NULL THEN 's' || s.s_suppkey ELSE 'c' || c.c_custkey END AS match_id,
  CASE WHEN o_orderkey % 2 = 0 AND s.s_suppkey IS NULL THEN 1 ELSE 0 END AS prio
FROM orders LEFT JOIN supplier s ON s.s_suppkey = o_orderkey % 150 LEFT JOIN customer c ON c.c_custkey = o_custkey
WHERE c.c_custkey IS NOT NULL OR (o_orderkey % 2 = 0 AND s.s_suppkey IS NOT NULL)""")
def match_signatures(spark, sf_dir):
    text = lambda n: _c(n).cast("string")
    cust = table(spark, sf_dir, "customer").select(
        _c("c_custkey").alias("arrival"), F.concat(F.lit("c"), text("c_custkey")).alias("id"), F.lit("lever").alias("source"),
        F.lit(None).cast("string").alias("source_job_id"), F.concat(F.lit("https://c.example/"), text("c_custkey")).alias("canonical_url"))
    supp = table(spark, sf_dir, "supplier").select(
        _c("s_suppkey").alias("arrival"), F.concat(F.lit("s"), text("s_suppkey")).alias("id"), F.lit("lever").alias("source"),
        text("s_suppkey").alias("source_job_id"), F.concat(F.lit("https://s.example/"), text("s_suppkey")).alias("canonical_url"))
    orders = table(spark, sf_dir, "orders").select(
        _c("o_orderkey").alias("arrival"), F.lit("").alias("id"), F.lit("lever").alias("source"),
        F.when(_c("o_orderkey") % 2 == 0, (_c("o_orderkey") % 150).cast("string")).alias("source_job_id"),
        F.concat(F.lit("https://C.example/"), text("o_custkey"), F.lit("/?utm_source=x")).alias("canonical_url"))
    blank = {n: F.lit("") for n in ("title", "company", "location_city", "location_country", "job_type", "job_url", "apply_url")}
    hits = merge.match_signatures(cust.unionByName(supp).withColumns(blank), orders.withColumns(blank))
    return hits.select(_c("arrival").alias("o_orderkey"), "match_id", "prio")


_SHARE = "SELECT *, 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'remoteok' ELSE 'lever' END AS source FROM orders"


@query("merge_report", f"""
SELECT source, count(*) AS collected, count(*) FILTER (n = 1) AS inserted, count(*) FILTER (n > 1) AS deduplicated,
  count(*) FILTER (n > 1 AND (o_orderdate < prev OR new_skill OR new_source OR takes OR (region AND NOT had_region))) AS updated FROM (
  SELECT *, row_number() OVER w AS n, min(o_orderdate) OVER before AS prev, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1 AS new_skill,
    row_number() OVER (PARTITION BY o_custkey, source ORDER BY o_orderkey) = 1 AS new_source,
    coalesce(max(CAST(region AS INT)) OVER before, 0) = 1 AS had_region, o_orderkey % 4 <> 0 AND coalesce(max(CAST(o_orderkey % 4 <> 0 AS INT)) OVER before, 1) = 0
      AND skills_before <= 2 AS takes
  FROM (SELECT *, o_orderkey % 5 <> 0 AS region, 1 + (SELECT count(DISTINCT b.o_orderstatus) FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey < a.o_orderkey) AS skills_before FROM ({_SHARE}) a)
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey), before AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
GROUP BY source""")
def merge_report(spark, sf_dir):
    return merge.merge_postings(_order_postings(spark, sf_dir), materialise=False).report


@query("merge_canonical", f"""
SELECT 'Role ' || o_custkey AS title, arg_min(id, rank) AS id, min(o_orderkey) AS arrival, strftime(min(o_orderdate), '%Y-%m-%d') AS posted,
  arg_min('R' || o_orderkey % 7, rank) FILTER (o_orderkey % 5 <> 0) AS region, arg_min(CASE WHEN o_orderkey % 4 = 0 THEN 'Kenya' ELSE 'Berlin' END, rank) AS location,
  string_agg(DISTINCT source, '|' ORDER BY source) AS sources, 1 + count(DISTINCT o_orderstatus) AS n_skills
FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END * 1000000000 + o_orderkey AS rank FROM ({_SHARE})) GROUP BY o_custkey""")
def merge_canonical(spark, sf_dir):
    merged = merge.merge_canonical(_order_postings(spark, sf_dir))
    return merged.select("title", "id", "arrival", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"),
                         _c("location_region").alias("region"), "location",
                         F.array_join(F.array_sort("aggregated_sources"), "|").alias("sources"), F.size("skills").cast("bigint").alias("n_skills"))


_SEQUENTIAL = f"""
WITH s AS (SELECT *, 1 + (SELECT count(DISTINCT b.o_orderstatus) FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey < a.o_orderkey) AS skills_before
  FROM ({_SHARE}) a),
m AS (SELECT *, o_orderkey % 4 <> 0 AND skills_before <= 2 AND coalesce(max(CAST(o_orderkey % 4 <> 0 AS INT)) OVER (
    PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 0 AS takes FROM s)
SELECT 'Role ' || o_custkey AS title, coalesce(max(id) FILTER (takes), arg_min(id, o_orderkey)) AS id, strftime(min(o_orderdate), '%Y-%m-%d') AS posted,
  coalesce(max(CASE WHEN o_orderkey % 5 <> 0 THEN 'R' || o_orderkey % 7 END) FILTER (takes), arg_min('R' || o_orderkey % 7, o_orderkey) FILTER (o_orderkey % 5 <> 0)) AS region,
  CASE WHEN bool_or(takes) OR arg_min(o_orderkey % 4, o_orderkey) <> 0 THEN 'Berlin' ELSE 'Kenya' END AS location,
  string_agg(DISTINCT source, '|' ORDER BY source) AS sources, 1 + count(DISTINCT o_orderstatus) AS n_skills
FROM m GROUP BY o_custkey"""


def _merged(postings):
    return postings.select("title", "id", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"), _c("location_region").alias("region"),
                           "location", F.array_join(F.array_sort("aggregated_sources"), "|").alias("sources"),
                           F.size("skills").cast("bigint").alias("n_skills"))


@query("merge_sequential", _SEQUENTIAL)
def merge_sequential(spark, sf_dir):
    """The records that a merge row by row leaves."""
    return _merged(merge.merge_postings(_order_postings(spark, sf_dir), materialise=False).postings)


@query("table_increments", _SEQUENTIAL)
def table_increments(spark, sf_dir):
    """The same records, merged into a table by three batches of falling size."""
    postings, root = _order_postings(spark, sf_dir), scratch_path(spark, "table")
    top = postings.agg(F.max("arrival")).first()[0] or 0
    bounds = [0, top * 6 // 10, top * 99 // 100, top]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        store.merge_into(spark, root, str(i), postings.filter(_c("arrival").between(low + (i > 0), high)))
    return _merged(store.read_postings(spark, root))


@query("table_page", with_views("""
SELECT n, id, title, source FROM (SELECT id, title, source, row_number() OVER (
    ORDER BY posted_at DESC, quality_score DESC, scraped_at DESC, arrival) AS n FROM v_post) WHERE n BETWEEN 51 AND 150"""))
def table_page(spark, sf_dir):
    """Rows 51 to 150 of the stored order, read from the ranges that hold them."""
    root = scratch_path(spark, "table")
    store.write_postings(_postings(v_post(spark, sf_dir)), root, "0")
    return store.page_of_table(spark, root, 50, 100).select(_c("arrival").alias("n"), "id", "title", "source")


@query("merge_replay")
def merge_replay(spark, sf_dir):
    """Row-by-row merge of all document postings; order-dependent, checked against a model in tests."""
    merged = merge.merge_postings(_postings(v_post(spark, sf_dir)))
    return merged.postings.select("id", "title", "source", "canonical_url", F.array_join("aggregated_sources", "|").alias("sources"), "quality_score")


@query("ingest_stream")
def ingest_stream(spark, sf_dir):
    """Documents as a stream of raw rows merged into a new table; returns the table in stored order."""
    schema = _table(spark, sf_dir, "documents").schema
    # A pattern, as a stream takes a plain path for a folder: the table may be one file or a folder of them.
    docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    raw = spark.sql(RAW.replace("FROM documents", "FROM {src}"), src=docs).withColumnRenamed("url", "job_url").drop("text", "lang")
    root = scratch_path(spark, "table")
    run = start_ingest(raw.withColumn("posted_text", F.lit("2024-02-03")), root, scratch_path(spark, "progress"), as_of())
    run.awaitTermination()
    return store_order(store.read_postings(spark, root)).select("id", "title", "source", "quality_score")


_HOURS = 3600 * 6


def _walk(limit, window_us, cooldown_us):
    kept = f"list_filter(r.log, lambda t: e.us - t <= {window_us})"
    full = f"len({kept}) >= {limit}" if limit else "false"
    cool = f"(r.done IS NOT NULL AND e.us - r.done < {cooldown_us})" if cooldown_us else "false"
    return f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT event_id, user_id, n, [us] AS log, us AS done, 'admitted' AS decision FROM e WHERE n = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.n, CASE WHEN {full} THEN {kept} ELSE list_append({kept}, e.us) END,
    CASE WHEN {full} OR {cool} THEN r.done ELSE e.us END,
    CASE WHEN {full} THEN 'rate' WHEN {cool} THEN 'cooldown' ELSE 'admitted' END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, user_id, decision FROM r"""


@query("rate_admission", _walk(3, _HOURS * 1_000_000, None))
def rate_admission(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", _c("ts").cast("timestamp"))
    return admission.admit_by_rate(events, "user_id", "ts", "event_id", 3, _HOURS).select("event_id", "user_id", "decision")


@query("cooldown_admission", _walk(3, _HOURS * 4_000_000, 3600 * 3_000_000))
def cooldown_admission(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", _c("ts").cast("timestamp"))
    return admission.admit_by_cooldown(events, "user_id", "ts", "event_id", 3600 * 3, 3, _HOURS * 4).select(
        "event_id", "user_id", "decision")
