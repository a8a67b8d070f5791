"""Queries over feeds and pages.  Payloads are built from the given tables row by row."""

from pyspark.sql import functions as F

from .. import vocab
from ..operators import crawl
from ..sources import boards, dom, feeds, jsonld, registry
from .registry import query, spread
from .registry import table as _table
from .views import with_views

_c = F.col


def table(spark, sf_dir, name):
    return spread(_table(spark, sf_dir, name))


AS_OF = "2024-07-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return o.join(c, _c("o_custkey") == _c("c_custkey")).withColumns({
        "seq": _c("o_orderkey"), "o_orderdate": _c("o_orderdate").cast("timestamp")})


def _landed(rows, body, origin, *more):
    return rows.select("seq", origin.alias("origin"), body.alias("body"), *more)


_J = "orders JOIN customer ON o_custkey = c_custkey"


@query("adapt_json_flat", f"""
SELECT CAST(o_orderkey AS STRING) AS job, 'Role ' || o_orderpriority AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Unknown company' ELSE c_name END AS company,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Remote' ELSE c_mktsegment END AS location,
  CASE WHEN o_orderkey % 2 = 0 THEN 'https://remoteok.com/' ELSE 'https://r.example/' || o_orderkey END AS apply_url,
  'sql|' || lower(o_orderstatus) AS tags,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 < 3 THEN 'USD ' || (o_orderkey % 90 + 1)
    ELSE 'EUR ' || (o_orderkey % 90 + 1) || ' - ' || (o_orderkey % 90 + 9) END AS salary_text,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) END AS posted FROM {_J}""")
def adapt_json_flat(spark, sf_dir):
    k = _c("o_orderkey")
    low = F.when(k % 5 == 0, 0).otherwise(k % 90 + 1)
    entry = F.to_json(F.struct(
        k.alias("id"), F.concat(F.lit("Role "), "o_orderpriority").alias("position"),
        F.when(k % 3 != 0, _c("c_name")).alias("company"), F.when(k % 4 != 0, _c("c_mktsegment")).alias("location"),
        F.when(k % 2 != 0, F.concat(F.lit("https://r.example/"), k.cast("string"))).alias("url"),
        F.array(F.lit("sql"), F.lower("o_orderstatus")).alias("tags"), low.alias("salary_min"),
        F.when(k % 5 >= 3, k % 90 + 9).alias("salary_max"), F.when(k % 5 >= 3, F.lit("EUR")).alias("salary_currency"),
        F.when(k % 7 != 0, F.unix_seconds("o_orderdate")).otherwise(0).alias("epoch")))
    body = F.concat(F.lit('[{"legal":"notice"},'), entry, F.lit("]"))
    raw = feeds.adapt_remoteok(_landed(_orders(spark, sf_dir), body, F.lit("feed")))
    return raw.select(_c("source_job_id").alias("job"), "title", "company", "location", "apply_url",
                      F.array_join("skills", "|").alias("tags"), "salary_text", _c("posted_epoch").cast("bigint").alias("posted"))


@query("adapt_rss", f"""
SELECT 'https://w.example/' || o_orderkey AS job_url, 'Python data role ' || o_orderkey || ' & more' AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Unknown company' ELSE c_name END AS company,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Remote' ELSE c_mktsegment END AS location, 'Full-Time ' || o_orderstatus AS job_type,
  'python|data' AS tags, '<p>' || o_orderpriority || '</p>' AS description,
  strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S +0000') AS posted FROM {_J}""")
def adapt_rss(spark, sf_dir):
    k = _c("o_orderkey")
    s = k.cast("string")

    def tag(name, value):
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    body = F.concat(
        F.lit('<?xml version="1.0"?><rss xmlns:w="https://w.example/ns"><channel><title>feed</title><item>'),
        tag("title", F.concat(F.lit("Python data role "), s, F.lit(" &amp; more"))),
        F.when(k % 3 != 0, tag("w:company", _c("c_name"))).otherwise(""),
        F.when(k % 4 != 0, tag("w:region", _c("c_mktsegment"))).otherwise(""),
        tag("description", F.concat(F.lit("<![CDATA[<p>"), "o_orderpriority", F.lit("</p>]]>"))),
        tag("link", F.concat(F.lit("https://w.example/"), s)), tag("category", F.concat(F.lit("Full-Time "), "o_orderstatus")),
        tag("pubDate", F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss '+0000'")),
        F.lit("</item></channel></rss>"))
    raw = feeds.adapt_weworkremotely(feeds.rss_items(_landed(_orders(spark, sf_dir), body, F.lit("feed"))))
    return raw.select("job_url", "title", "company", "location", "job_type",
                      F.array_join("skills", "|").alias("tags"), "description", _c("posted_text").alias("posted"))


_SLUG = "'acme-' || lower(c_mktsegment)"
_NAME = "'Acme ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))"


@query("adapt_json_nested", f"""
SELECT 'greenhouse' AS source, CAST(o_orderkey AS STRING) AS job, 'Role ' || o_orderkey AS title, {_NAME} AS company,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Remote' ELSE 'Nairobi' END AS location, 'Ship & care ' || o_orderpriority || ' contract' AS description,
  'contract' AS job_type, strftime(o_orderdate, '%Y-%m-%d') AS posted, 'https://g.example/' || o_orderkey AS apply_url FROM {_J}
UNION ALL SELECT 'lever', 'L' || o_orderkey, 'Role ' || o_orderkey, {_NAME}, CASE WHEN o_orderkey % 3 = 0 THEN 'Remote' ELSE 'Lagos' END,
  'Plain ' || o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 'unknown' ELSE 'full-time' END,
  CAST(CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) * 1000 AS STRING), 'https://l.example/' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '/apply' ELSE '' END FROM {_J}
UNION ALL SELECT 'ashby', 'A' || o_orderkey, 'Role ' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Board ' || c_name ELSE {_NAME} END,
  CASE o_orderkey % 4 WHEN 0 THEN 'Berlin' WHEN 1 THEN 'Paris' WHEN 2 THEN 'Oslo' ELSE 'Remote' END, 'Html ' || o_orderpriority, 'fulltime',
  strftime(o_orderdate, '%Y-%m-%d'), 'https://a.example/' || o_orderkey FROM {_J}""")
def adapt_json_nested(spark, sf_dir):
    k, rows = _c("o_orderkey"), _orders(spark, sf_dir)
    s = k.cast("string")
    slug = F.concat(F.lit("acme-"), F.lower("c_mktsegment"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    title = F.concat(F.lit("Role "), s)
    link = lambda host: F.concat(F.lit(f"https://{host}.example/"), s)
    green = F.to_json(F.struct(F.array(F.struct(
        k.alias("id"), title.alias("title"),
        F.concat(F.lit("&lt;p&gt;Ship &amp;amp; care&lt;/p&gt;&lt;b&gt;"), "o_orderpriority", F.lit("&lt;/b&gt; contract")).alias("content"),
        F.when(k % 3 != 0, F.struct(F.lit("Nairobi").alias("name"))).alias("location"),
        link("g").alias("absolute_url"), F.when(k % 2 == 0, day).alias("updated_at"), day.alias("first_published"))).alias("jobs")))
    lever = F.concat(F.lit("["), F.to_json(F.struct(
        F.concat(F.lit("L"), s).alias("id"), title.alias("text"), F.concat(F.lit("<i>Plain</i> "), "o_orderpriority").alias("description"),
        F.when(k % 2 == 0, F.concat(F.lit("Plain "), "o_orderpriority")).alias("descriptionPlain"), link("l").alias("hostedUrl"),
        F.when(k % 2 == 0, F.concat(link("l"), F.lit("/apply"))).alias("applyUrl"),
        (F.unix_seconds("o_orderdate") * 1000).alias("createdAt"),
        F.struct(F.when(k % 3 != 0, F.lit("Lagos")).alias("location"), F.when(k % 2 != 0, F.lit(" Full-Time ")).alias("commitment"),
                 F.lit("Ops").alias("team")).alias("categories"))), F.lit("]"))
    second = F.when(k % 4 == 1, F.lit('[{"locationName":"Paris"}]')).when(k % 4 == 2, F.lit('["Oslo"]')).otherwise("[]")
    ashby = F.concat(
        F.lit('{"data":{"jobBoard":{'), F.when(k % 2 == 0, F.concat(F.lit('"name":"Board '), "c_name", F.lit('",'))).otherwise(""),
        F.lit('"jobPostingsByTeam":[{"name":"Empty","jobPostings":[]},{"name":"Core","jobPostings":[{"id":"A'), s,
        F.lit('","title":"Role '), s, F.lit('","descriptionHtml":"<p>Html</p>'), "o_orderpriority",
        F.lit('","locationName":'), F.when(k % 4 == 0, '"Berlin"').otherwise("null"), F.lit(',"secondaryLocations":'), second,
        F.lit(',"jobUrl":"https://a.example/'), s, F.lit('","employmentType":"FullTime","publishedDate":"'), day, F.lit('"}]}]}}}'))
    parts = [feeds.adapt_greenhouse(_landed(rows, green, slug)), feeds.adapt_lever(_landed(rows, lever, slug)),
             feeds.adapt_ashby(_landed(rows, ashby, slug))]
    out = None
    for p in parts:
        p = p.select("source", _c("source_job_id").alias("job"), "title", "company", "location", "description", "job_type",
                     F.coalesce("posted_text", _c("posted_epoch").cast("bigint").cast("string")).alias("posted"), "apply_url")
        out = p if out is None else out.unionByName(p)
    return out


@query("ingest_errors", """
SELECT 'greenhouse' AS source, 'Greenhouse board ''' || c_mktsegment || ''' failed: unreadable response' AS message, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 6 = 0 GROUP BY ALL""")
def ingest_errors(spark, sf_dir):
    body = F.when(_c("o_orderkey") % 6 == 0, F.lit('{"jobs":[')).otherwise('{"jobs":[]}')
    landed = _landed(_orders(spark, sf_dir), body, _c("c_mktsegment"))
    return feeds.feed_errors(landed, "greenhouse", "Greenhouse board").groupBy("source", "message").agg(
        F.count(F.lit(1)).alias("n"))


_BODIES = {
    "lever": ("Lever company", "unexpected shape", '{"id":1}', "[]"), "remoteok": ("RemoteOK feed", "unreadable response", "[{", "[]"),
    "ashby": ("Ashby board", "unexpected shape", "[1]", "{}"), "weworkremotely": (
        "WeWorkRemotely feed", "unreadable response", "<rss><channel><item></rss>", "<rss><channel><title>t</title></channel></rss>"),
    "careerspage": ("CareersPage page", "empty page", " ", "<p>x</p>"), "fuzu": ("fuzu page", "empty page", "", "<p>x</p>"),
}


@query("source_errors", " UNION ALL ".join(
    f"SELECT '{s}' AS source, '{label} ''' || c_mktsegment || ''' failed: {why}' AS message, count(*) AS n "
    f"FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 6 = {i} AND o_orderkey % 5 = 1 GROUP BY ALL"
    for i, (s, (label, why, _, _)) in enumerate(_BODIES.items())))
def source_errors(spark, sf_dir):
    """Messages of all kinds of sources, every fifth text of which is broken in the source's own way."""
    k = _c("o_orderkey")
    source, body = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (s, (_, _, broken, whole)) in enumerate(_BODIES.items()):
        source = F.when(k % 6 == i, s).otherwise(source)
        body = F.when(k % 6 == i, F.when(k % 5 == 1, broken).otherwise(whole)).otherwise(body)
    landed = _landed(_orders(spark, sf_dir).withColumn("source", source), body, _c("c_mktsegment"), "source")
    _, errors = registry.collect_raw(landed, as_of(), list(_BODIES))
    return errors.groupBy("source", "message").agg(F.count(F.lit(1)).alias("n"))


def _jsonld_pages(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, s = _c("p_partkey"), _c("p_partkey").cast("string")
    address = F.struct(_c("p_brand").alias("addressLocality"), F.when(k % 2 == 0, _c("p_type")).alias("addressRegion"),
                       F.lit("Kenya").alias("addressCountry"))
    place = F.struct(F.when(k % 5 != 0, address).alias("address"), F.when(k % 5 == 0, _c("p_name")).alias("name"))
    job = F.to_json(F.struct(
        F.lit("JobPosting").alias("@type"), F.concat(F.lit("Role "), "p_name").alias("title"),
        F.concat(F.lit("<p>Make "), "p_type", F.lit("</p>")).alias("description"),
        F.when(k % 3 != 0, F.struct(F.concat(F.lit("Org "), "p_brand").alias("name"))).alias("hiringOrganization"),
        F.array(place).alias("jobLocation"), F.array(F.lit("FULL_TIME"), F.lit("X")).alias("employmentType"),
        F.struct(F.lit("KES").alias("currency"), F.struct(
            F.when(k % 4 != 0, _c("p_size")).alias("minValue"), F.when(k % 4 == 1, _c("p_size") + 5).alias("maxValue"),
            F.lit("MONTH").alias("unitText")).alias("value")).alias("baseSalary"),
        F.struct(F.concat(F.lit(" ID"), s).alias("value")).alias("identifier"), F.lit("2024-02-03").alias("datePosted")))
    other = F.lit('{"@type":"Organization","name":"x"}')
    script = lambda c: F.concat(F.lit('<script type="application/ld+json">'), c, F.lit("</script>"))
    shaped = F.when(k % 3 == 0, job).when(k % 3 == 1, F.concat(F.lit("["), other, F.lit(","), job, F.lit("]"))).otherwise(
        F.concat(F.lit('{"@graph":['), job, F.lit(","), other, F.lit("]}")))
    html = F.concat(F.lit("<html><head>"), script(F.lit("{bad json")), script(shaped), script(other),
                    F.lit("</head><body><h1>Heading</h1></body></html>"))
    return p.select("p_partkey", k.alias("seq"), F.concat(F.lit("https://www.part-"), s, F.lit("_x.example.org/careers")).alias("url"),
                    html.alias("html"))


_LD_PLACE = "p_brand || CASE WHEN p_partkey % 2 = 0 THEN ', ' || p_type ELSE '' END || ', Kenya'"
_LD_PAY = ("CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'KES ' || p_size || ' - ' || (p_size + 5){u} "
           "ELSE 'KES ' || p_size{u} END")


@query("jsonld_postings", f"""
SELECT 'ID' || p_partkey AS job, 'Role ' || p_name AS title,
  CASE WHEN p_partkey % 3 = 0 THEN 'Part ' || p_partkey || ' X' ELSE 'Org ' || p_brand END AS company,
  CASE WHEN p_partkey % 5 = 0 THEN 'Remote' ELSE {_LD_PLACE} END AS location, 'Make ' || p_type AS description,
  'full_time' AS job_type, {_LD_PAY.format(u="")} AS salary_text, '2024-02-03' AS posted, 'part' || p_partkey || 'x' AS site FROM part""")
def jsonld_postings(spark, sf_dir):
    raw = jsonld.adapt_careerspage(_jsonld_pages(spark, sf_dir))
    return raw.select(_c("source_job_id").alias("job"), "title", "company", "location", "description", "job_type",
                      "salary_text", _c("posted_text").alias("posted"), _c("source_website").alias("site"))


@query("page_links", r"""
SELECT page_id, href, min(pos) AS pos, min_by(txt, pos) AS text FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
    unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS txt,
    unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')))) AS pos FROM pages)
GROUP BY page_id, href""")
def page_links(spark, sf_dir):
    return crawl.page_links(table(spark, sf_dir, "pages")).select(
        "page_id", "href", _c("pos").cast("bigint").alias("pos"), "text")


_START = "'https://b.example/jobs?q=x%20y&page=1'"


@query("crawl_frontier", f"""
SELECT start_url, CASE page_id % 5 WHEN 0 THEN 'https://b.example/list/' || page_id WHEN 1 THEN 'https://b.example/jobs?page=9'
    ELSE 'https://b.example/jobs?q=x+y&page=' || (num + 1) || '&s=' || page_id END AS url, num + 1 AS page_number
FROM (SELECT page_id, 'https://b.example/jobs?q=x%20y&page=1&s=' || page_id AS start_url, CAST(page_id % 3 + 1 AS INT) AS num FROM pages)
WHERE num < 3 AND page_id % 7 <> 0 OR num < 3 AND page_id % 7 = 0 AND page_id % 5 <> 0""")
def crawl_frontier(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    k, s = _c("page_id"), _c("page_id").cast("string")
    nav = F.when(k % 5 == 0, F.concat(F.lit('<div class="box pagination"><a href="/x">1</a><a href="/list/'), s, F.lit('">Next &raquo;</a></div>'))) \
        .when(k % 5 == 1, F.lit('<a rel="next" href="?page=9">go to next page</a>')).otherwise("")
    pages = p.select(
        "page_id", F.concat(F.lit("https://b.example/jobs?q=x%20y&page=1&s="), s).alias("start_url"),
        F.concat(F.lit("https://b.example/jobs?p="), s).alias("url"), (k % 3 + 1).cast("int").alias("page_number"),
        F.concat(F.lit("<html><body><p>"), F.regexp_replace(F.regexp_extract("html", "<h1>([^<]*)", 1), "(?i)next|older", ""),
                 F.lit("</p>"), nav, F.lit("</body></html>")).alias("html"))
    visited = pages.filter(k % 7 == 0).select("start_url", F.concat(F.lit("https://b.example/list/"), s).alias("url"))
    return crawl.crawl_frontier(pages.drop("page_id"), visited, page_param="page", max_pages=vocab.MAX_RESULT_PAGES)


# ---- job boards: listing and detail pages written from the documents


def _board_pages(spark, sf_dir):
    """Five listings per page (by number), each a list item; the title names the document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    k, s = _c("doc_id"), _c("doc_id").cast("string")
    item = F.concat(
        F.lit('<li><a href="/listings/role-'), s, F.lit('">Analyst '), s, F.lit("</a><span>Acme &amp; "), "source", F.lit("</span>"),
        F.when(k % 2 == 0, "<p>Mombasa</p>").otherwise("<p>somewhere</p>"), F.lit("<p>Part Time</p><p>KSh "), s, F.lit(",000</p>"),
        F.when(k % 3 == 0, "<p>2 days ago</p>").otherwise("<p>3 May 2024</p>"), F.lit("<p>New</p></li>"))
    html = F.concat(F.lit('<html><body><ul><li><a href="/listings/login">Login</a></li>'), item, item, F.lit("</ul></body></html>"))
    return d.select(k.alias("seq"), F.concat(F.lit("https://www.board.example/jobs?page="), s).alias("url"), html.alias("html"))


_BOARD = boards.BOARDS["brightermonday"]


@query("board_listings", """
SELECT 'https://www.board.example/listings/role-' || doc_id AS job_url, 'Analyst ' || doc_id AS title, 'Acme & ' || source AS company,
  CASE WHEN doc_id % 2 = 0 THEN 'Mombasa' ELSE 'Kenya' END AS location, 'part-time' AS job_type, 'KSh ' || doc_id || ',000 ' ||
  CASE WHEN doc_id % 3 = 0 THEN '2 days ago' ELSE '3' END AS salary_text,
  CASE WHEN doc_id % 2 = 0 THEN 'Mombasa' ELSE 'somewhere' END || ' KSh ' || doc_id || ',000 ' || CASE WHEN doc_id % 3 = 0 THEN '2 days ago' ELSE '3 May 2024' END AS description,
  CASE WHEN doc_id % 3 = 0 THEN '2024-06-29' ELSE '2024-05-03' END AS posted FROM documents""")
def board_listings(spark, sf_dir):
    rows = boards.board_listings(_board_pages(spark, sf_dir), _BOARD, as_of())
    return rows.select("job_url", "title", "company", "location", "job_type", "salary_text", "description",
                       F.date_format("posted_ts", "yyyy-MM-dd").alias("posted"))


def _detail_pages(spark, sf_dir, every=False):
    """Detail page of every second document, or of all."""
    d = table(spark, sf_dir, "documents").filter(F.lit(every) | F.expr("doc_id % 2 = 0")).select("doc_id", "source")
    s = _c("doc_id").cast("string")
    html = F.concat(
        F.lit('<html><head><meta property="og:title" content=" Og "></head><body><main><h1>Page role '), s,
        F.lit('</h1><h2>Page company</h2><span class="skill-tag">Excel</span><p>Applicant Location: Kisumu</p><p>Full Time</p>'
              '<div>Job descriptions &amp; requirements</div><p>Do the '), "source",
        F.lit(' work</p><p>Second line</p><p>Similar jobs</p></main></body></html>'))
    return d.select(F.concat(F.lit("https://www.board.example/listings/role-"), s).alias("url"), html.alias("html"))


@query("listing_detail_enrich", """
SELECT 'https://www.board.example/listings/role-' || doc_id AS job_url, 'Analyst ' || doc_id AS title,
  CASE WHEN doc_id % 2 = 0 THEN 'Mombasa' ELSE 'Kenya' END AS location, 'part-time' AS job_type,
  CASE WHEN doc_id % 2 = 0 THEN '<h1>Page role ' || doc_id || '</h1><h2>Page company</h2><span class="skill-tag">Excel</span><p>Applicant Location: Kisumu</p><p>Full Time</p><div>Job descriptions &amp; requirements</div><p>Do the '
    || source || ' work</p><p>Second line</p><p>Similar jobs</p>' END AS description_html,
  CASE WHEN doc_id % 2 = 1 THEN 'brightermonday listing ''https://www.board.example/listings/role-' || doc_id || ''' detail parsing degraded: no detail page' END AS degraded
FROM documents""")
def listing_detail_enrich(spark, sf_dir):
    listings = boards.board_listings(_board_pages(spark, sf_dir), _BOARD, as_of())
    details = boards.extract_details(_detail_pages(spark, sf_dir), _BOARD)
    return boards.enrich_listings(listings, details, _BOARD).select(
        "job_url", "title", "location", "job_type", "description_html", "degraded")


@query("html_postings", """
SELECT 'https://www.board.example/listings/role-' || doc_id AS url, 'Page role ' || doc_id AS title, 'Page company' AS company,
  'Excel' AS skills, 'Page role ' || doc_id || '~Page company~Excel~Applicant Location: Kisumu~Full Time~Job descriptions & requirements~Do the '
  || source || ' work~Second line~Similar jobs' AS description FROM documents""")
def html_postings(spark, sf_dir):
    rows = boards.extract_details(_detail_pages(spark, sf_dir, every=True), _BOARD)
    return rows.select("url", "own.title", "own.company", F.array_join("own.skills", "|").alias("skills"),
                       F.replace("own.description", F.lit("\n"), F.lit("~")).alias("description"))


def _sheet(spark, sf_dir, listing, page, detail, link):
    """Result pages (each listing twice on a page) and detail pages (each read twice) of a board, from the documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    html = F.expr(f"'<html><body><ul><li><a href=\"/about\">About us</a></li>' || {listing} || {listing} || '</ul></body></html>'")
    lists = d.select(_c("doc_id").alias("seq"), F.expr(page).alias("url"), html.alias("html"))
    pages = d.filter("doc_id % 4 <> 3").select(F.expr(link).alias("url"), F.expr(detail).alias("html"))
    other = d.select(F.expr(f"{link} || '-unlinked'").alias("url"), F.lit("<main><h1>Not linked</h1></main>").alias("html"))
    return lists, pages.unionByName(pages).unionByName(other)


def _board_rows(spark, sf_dir, name, *sheet):
    lists, pages = _sheet(spark, sf_dir, *sheet)
    rows = boards.adapt_board(lists, pages, boards.BOARDS[name], as_of())
    return rows.select("job_url", "title", "company", "location", "job_type", "experience_level", "description",
                       F.coalesce(F.date_format("posted_ts", "yyyy-MM-dd"), "posted_text").alias("posted"))


@query("board_myjobmag", """
SELECT 'https://www.myjobmag.co.ke/job/clerk-' || doc_id AS job_url, 'Clerk ' || doc_id AS title, 'Firm ' || source AS company,
  CASE WHEN doc_id % 2 = 0 THEN 'Lagos' ELSE 'Kenya' END AS location, CASE WHEN doc_id % 4 <> 3 THEN 'Contract' ELSE 'unknown' END AS job_type,
  CASE WHEN doc_id % 4 <> 3 THEN '2 years' END AS experience_level,
  CASE WHEN doc_id % 2 = 0 THEN 'based in LAGOS' ELSE 'anywhere' END || ' 2 days ago' AS description, '2024-06-29' AS posted FROM documents""")
def board_myjobmag(spark, sf_dir):
    return _board_rows(
        spark, sf_dir, "myjobmag",
        "'<li><a href=\"/job/clerk-' || doc_id || '\">Clerk ' || doc_id || ' at Firm ' || source || '</a><p>' || "
        "CASE WHEN doc_id % 2 = 0 THEN 'based in LAGOS' ELSE 'anywhere' END || '</p><p>2 days ago</p></li>'",
        "'https://www.myjobmag.co.ke/jobs-in/kenya?page=' || doc_id",
        "'<main><h1>Clerk in full</h1><p>Posted: May 3, 2024</p><p>Job Type Contract</p><p>Experience 2 years</p><p>Location Abuja</p>"
        "<p>Description</p><p>Body of ' || source || '</p><p>Method of Application</p></main>'",
        "'https://www.myjobmag.co.ke/job/clerk-' || doc_id")


@query("board_corporatestaffing", """
SELECT 'https://www.corporatestaffing.co.ke/jobs/driver-' || doc_id || '/' AS job_url, 'Best Shop Jobs ' || doc_id || 'K' AS title, 'Best Shop' AS company,
  CASE WHEN doc_id % 2 = 0 THEN 'Kakamega' ELSE 'Kenya' END AS location, 'contract' AS job_type, NULL::VARCHAR AS experience_level,
  CASE WHEN doc_id % 2 = 0 THEN 'near kakamega' ELSE 'up country' END || ' Contract 3 May 2024' AS description, '2024-05-03' AS posted FROM documents""")
def board_corporatestaffing(spark, sf_dir):
    return _board_rows(
        spark, sf_dir, "corporatestaffing",
        "'<li><a href=\"/jobs/driver-' || doc_id || '/\">Best Shop Jobs ' || doc_id || 'K</a><p>' || "
        "CASE WHEN doc_id % 2 = 0 THEN 'near kakamega' ELSE 'up country' END || '</p><p>Contract</p><p>3 May 2024</p></li>'",
        "'https://www.corporatestaffing.co.ke/jobs/page/' || doc_id", "'<main></main>'",
        "'https://www.corporatestaffing.co.ke/jobs/driver-' || doc_id || '/'")


@query("board_fuzu", """
SELECT 'https://www.fuzu.com/job/cook-' || doc_id AS job_url, 'Cook ' || doc_id AS title, 'Fuzu Employer' AS company, 'Africa' AS location,
  'unknown' AS job_type, CASE WHEN doc_id % 4 <> 3 THEN 'Mid-level' END AS experience_level, 'Cook ' || doc_id AS description, NULL::VARCHAR AS posted
FROM documents""")
def board_fuzu(spark, sf_dir):
    return _board_rows(
        spark, sf_dir, "fuzu",
        "'<li><a href=\"/job/cook-' || doc_id || '\">Cook ' || doc_id || '</a><p>x</p></li>'",
        "'https://www.fuzu.com/job?page=' || doc_id",
        "'<main><p>[menu]</p><p>Big Inn</p><p>logo</p><h1># Cook in full</h1><p>in nairobi, KENYA</p><p>Mid-level</p><p>Description</p>"
        "<p>Body of ' || source || '</p><p>Tags</p></main>'",
        "'https://www.fuzu.com/job/cook-' || doc_id")


@query("detail_cap", """
SELECT seq, job_url, looked AS has_detail FROM (SELECT doc_id // 5 AS seq, 'https://www.board.example/listings/role-' || doc_id AS job_url,
  row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) <= 2 AS looked FROM documents)""")
def detail_cap(spark, sf_dir):
    """Five listings on a result page, the first two of which are looked up."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id DIV 5").alias("seq"))
    listings = d.select("seq", _c("doc_id").alias("pos"), F.lit("p").alias("page_url"), _c("doc_id").alias("arrival"), F.lit("brightermonday").alias("source"),
                        F.concat(F.lit("https://www.board.example/listings/role-"), _c("doc_id").cast("string")).alias("job_url"))
    details = boards.extract_details(_detail_pages(spark, sf_dir, every=True), _BOARD)
    rows = boards.enrich_listings(listings, details, _BOARD, per_page=2)
    return rows.select(F.expr("arrival DIV 5").alias("seq"), "job_url", _c("degraded").isNull().alias("has_detail"))


@query("jsonld_nested", """
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 2 ELSE 1 END AS n, 'Role ' || doc_id || CASE WHEN doc_id % 3 = 2 THEN '|Role [x]' ELSE '' END AS titles FROM documents""")
def jsonld_nested(spark, sf_dir):
    """Postings in up to eight levels of lists and @graph lists."""
    item = "'{\"@type\":\"JobPosting\",\"title\":\"Role ' || doc_id || '\",\"skills\":[\"[[[\",[\"b\"]]}'"
    page = F.expr(f"""'<script type="application/ld+json">' || CASE doc_id % 3
      WHEN 0 THEN repeat('[', CAST(doc_id % 9 AS INT)) || {item} || repeat(']', CAST(doc_id % 9 AS INT))
      WHEN 1 THEN repeat('{{"@graph":[', CAST(doc_id % 9 AS INT)) || {item} || repeat(']}}', CAST(doc_id % 9 AS INT))
      ELSE repeat('[{{"@graph":[', 4) || {item} || ',{{"@type":"JobPosting","title":"Role [x]"}}' || repeat(']}}]', 4) END || '</script>'""")
    found = table(spark, sf_dir, "documents").select("doc_id", jsonld.job_postings(page).alias("found"))
    return found.select("doc_id", F.size("found").alias("n"), F.array_join(F.transform("found", lambda v: F.try_variant_get(v, "$.title", "string")), "|").alias("titles"))


_LABEL_SRC = """'Role ' || p_name || chr(10) || 'Posted: May 3, 2024' || chr(10) || 'Job Type ' || p_type || chr(10) || 'Experience ' || p_size || ' years'
  || chr(10) || 'Location ' || p_brand || chr(10) || 'View Jobs at ' || p_name || ' Ltd' || chr(10) || 'Description' || chr(10) || 'Body of ' || p_type
  || chr(10) || 'Method of Application: mail'"""


@query("labelled_fields", """
SELECT p_partkey, 'May 3, 2024' AS posted, p_type AS job_type, p_size || ' years' AS level, p_brand AS location, p_name || ' Ltd' AS company,
  'Body of ' || p_type AS body, 'Kisumu' AS a_location, 'Contract' AS a_type, 'KSh ' || p_size AS a_salary,
  p_name AS f_title, 'Nairobi, Kenya' AS f_location, 'Mid-level' AS f_level, 'Body' AS f_skills FROM part""")
def labelled_fields(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    c = F.expr(_LABEL_SRC.replace("chr(10)", "'\\n'"))
    a = F.expr("'Applicant Location: Kisumu\\nContract\\nKSh ' || p_size || '\\nend'")
    f = F.expr("'[menu]\\nlogo\\n# ' || p_name || '\\nin nairobi, KENYA\\nmid-level\\nDescription\\nBody of ' || lower(p_type) || '\\nTags'")
    m, b, z = boards.myjobmag_meta(c), boards.brightermonday_meta(a), boards.fuzu_meta(f)
    return p.select(
        "p_partkey", m["posted_text"].alias("posted"), m["job_type"].alias("job_type"), m["experience_level"].alias("level"),
        m["location"].alias("location"), m["company"].alias("company"), m["description"].alias("body"),
        b["location"].alias("a_location"), b["job_type"].alias("a_type"), b["salary_text"].alias("a_salary"),
        z["title"].alias("f_title"), z["location"].alias("f_location"), F.initcap(z["experience_level"]).alias("f_level"),
        F.array_join(z["skills"], "|").alias("f_skills"))


@query("line_fields", """
SELECT p_partkey, 'Best Firm' AS a_company, CASE WHEN p_partkey % 2 = 0 THEN 'Remote' ELSE 'Nakuru' END AS a_location, 'internship' AS a_type,
  'Brand Shop' AS b_company, 'Kakamega' AS b_location, p_size || 'K - ' || (p_size + 1) || 'K' AS b_salary, 'made in 2023' AS b_posted,
  'Driver' AS c_title, p_name || ' Ltd' AS c_company, 'Kampala' AS c_location FROM part""")
def line_fields(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = _c("p_partkey")
    t = F.concat(F.lit("Clerk "), "p_name")
    a = boards.brightermonday_fields(t, F.array(F.lit("x"), t, F.lit("Best Firm"), F.when(k % 2 == 0, "Remote (Work From Home)").otherwise("in Nakuru"),
                                                F.lit("Internship")), F.lit("u"), as_of())
    b = boards.corporatestaffing_fields(
        F.concat(F.lit("Brand Shop Jobs "), _c("p_size").cast("string"), F.lit("K - "), (_c("p_size") + 1).cast("string"), F.lit("K")),
        F.array(F.lit("made in 2023"), F.lit("near kakamega")), F.lit("u"), as_of())
    c = boards.myjobmag_fields(F.concat(F.lit("Driver - at "), "p_name", F.lit(" Ltd")), F.array(F.lit("based in KAMPALA")),
                               F.lit("https://m.example"), as_of())
    return p.select("p_partkey", a["company"].alias("a_company"), a["location"].alias("a_location"), a["job_type"].alias("a_type"),
                    b["company"].alias("b_company"), b["location"].alias("b_location"), b["salary_text"].alias("b_salary"),
                    b["posted_text"].alias("b_posted"), c["title"].alias("c_title"), c["company"].alias("c_company"),
                    c["location"].alias("c_location"))
