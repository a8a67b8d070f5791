"""Feed adapters: landed responses to raw rows.

A landed response is one row ``(seq, origin, body)``: its place in the run, the board slug or page
address it came from, and the text.  Responses that cannot be read appear in ``feed_errors`` and
never stop the others.
"""

from pyspark.sql import functions as F

from ..functions import salary, skills, text, urls
from ..functions.classify import commitment, job_type_from_labels
from ..schema import RAW_SCHEMA, conform

_c = F.col
# A response text holds fewer than 2**31 entries, so (seq, position) fits one LONG.
POSITION_BITS = 31


def _arrival(pos="pos"):
    return F.shiftleft(_c("seq").cast("bigint"), POSITION_BITS) + _c(pos)


def _raw(df, source, **columns):
    columns = {"source": F.lit(source), "arrival": _arrival(), **columns}
    return conform(df.select(*[c.alias(n) for n, c in columns.items()]), RAW_SCHEMA)


def _filled(*cols):
    return F.coalesce(*[text.nonblank(c) for c in cols])


def _get(v, path, kind="string"):
    return F.try_variant_get(v, "$." + path, kind)


def _entries(landed, path=None):
    """One row per element of the JSON array at ``path`` (or at the top)."""
    doc = landed.withColumn("doc", F.try_parse_json("body"))
    arr = F.try_variant_get("doc", "$" + (f".{path}" if path else ""), "array<variant>")
    return doc.select("seq", "origin", "doc", F.posexplode(arr).alias("pos", "e"))


def adapt_remoteok(landed):
    e = _c("e")
    # Only objects with the key count; the key may hold null.
    has_key = F.exists(F.json_object_keys(F.to_json("e")), lambda k: k == "position")
    epoch = _get(e, "epoch", "double")
    return _raw(
        _entries(landed).filter(has_key), "remoteok",
        title=_get(e, "position"), company=F.coalesce(_get(e, "company"), F.lit("Unknown company")),
        location=F.coalesce(_get(e, "location"), F.lit("Remote")), description=_get(e, "description"),
        description_html=_get(e, "description"),
        job_url=_filled(_get(e, "url"), F.lit("https://remoteok.com/")),
        apply_url=_filled(_get(e, "apply_url"), _get(e, "url"), F.lit("https://remoteok.com/")),
        job_type=_filled(_get(e, "employment_type"), _get(e, "job_type")),
        skills=_get(e, "tags", "array<string>"),
        salary_text=salary.salary_text(_filled(_get(e, "salary_currency"), F.lit("USD")),
                                       _get(e, "salary_min"), _get(e, "salary_max")),
        posted_epoch=F.nullif(epoch, F.lit(0.0)),
        source_job_id=_get(e, "id"), source_website=F.lit("remoteok.com"),
    )


RSS_FIELDS = ("title", "description", "link", "category", "pubDate", "company", "region")


def read_rss(spark, path):
    """Landed RSS files as item rows; namespaces are ignored, so ``ns:company`` is ``company``."""
    ddl = ", ".join(f"{n} string" for n in RSS_FIELDS)
    items = spark.read.format("xml").options(rowTag="item", ignoreNamespace="true").schema(ddl).load(path)
    return items.withColumns({
        "seq": F.lit(0).cast("bigint"), "pos": F.monotonically_increasing_id(), "origin": F.input_file_name()})


def rss_items(landed):
    """Items of landed RSS texts, one row per item, read with the built-in XML functions."""
    item = "(?s)<item\\b[^>]*>.*?</item>"
    blocks = landed.select("seq", "origin", F.posexplode(
        F.regexp_extract_all("body", F.lit(item), F.lit(0))).alias("pos", "xml"))
    # The root declares the namespace prefixes; inside one item they are plain name parts.
    plain = F.regexp_replace("xml", r"(</?)[A-Za-z][\w.\-]*:", "$1")
    ddl = ", ".join(f"{n} string" for n in RSS_FIELDS)
    return blocks.select("seq", "origin", "pos", F.from_xml(plain, ddl, {"mode": "PERMISSIVE"}).alias("i")).select(
        "seq", "origin", "pos", "i.*")


def adapt_weworkremotely(items):
    title = F.trim(text.text_or_empty(_c("title")))
    link = _filled(_c("link"), F.lit("https://weworkremotely.com/"))
    return _raw(
        items, "weworkremotely",
        title=F.coalesce(text.nonblank(title), F.lit("Unknown role")),
        company=F.trim(_filled(_c("company"), F.lit("Unknown company"))),
        location=F.trim(_filled(_c("region"), F.lit("Remote"))),
        description=_c("description"), description_html=_c("description"), job_url=link, apply_url=link,
        job_type=_c("category"), skills=skills.title_tags(title), posted_text=_c("pubDate"),
        source_website=F.lit("weworkremotely.com"),
    )


def adapt_greenhouse(landed):
    e = _c("e")
    rows = _entries(landed, "jobs").withColumns({
        "page": F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/"), "origin", F.lit("/jobs?content=true")),
        "title": F.coalesce(_get(e, "title"), F.lit("Unknown role")),
        "html": _get(e, "content"),
    }).withColumn("plain", text.clean_html(_c("html")))
    url = _filled(_get(e, "absolute_url"), _c("page"))
    return _raw(
        rows, "greenhouse", title=_c("title"), company=urls.slug_company(_c("origin")),
        location=F.coalesce(_get(e, "location.name"), F.lit("Remote")),
        description=_c("plain"), description_html=_c("html"), job_url=url, apply_url=url,
        job_type=job_type_from_labels(F.lower(F.concat_ws(" ", "title", "plain"))),
        skills=skills.infer_tags(_c("title"), _c("plain")),
        posted_text=_filled(_get(e, "updated_at"), _get(e, "first_published")),
        source_job_id=_get(e, "id"), source_website=F.lit("boards.greenhouse.io"),
    )


def adapt_lever(landed):
    e = _c("e")
    rows = _entries(landed).withColumns({
        "page": F.concat(F.lit("https://api.lever.co/v0/postings/"), "origin", F.lit("?mode=json")),
        "html": text.text_or_empty(_get(e, "description")),
        "title": F.coalesce(_get(e, "text"), F.lit("Unknown role")),
    }).withColumn("plain", F.coalesce(text.nonblank(_get(e, "descriptionPlain")), text.clean_html(_c("html"))))
    return _raw(
        rows, "lever", title=_c("title"), company=urls.slug_company(_c("origin")),
        location=F.coalesce(_get(e, "categories.location"), F.lit("Remote")),
        description=_c("plain"), description_html=_c("html"),
        job_url=_filled(_get(e, "hostedUrl"), _c("page")),
        apply_url=_filled(_get(e, "applyUrl"), _get(e, "hostedUrl"), _c("page")),
        job_type=commitment(_get(e, "categories.commitment")),
        skills=skills.infer_tags(_get(e, "text"), _c("plain"), _get(e, "categories.team")),
        posted_epoch=_get(e, "createdAt", "double"), salary_text=_get(e, "salaryDescriptionPlain"),
        source_job_id=_get(e, "id"), source_website=F.lit("jobs.lever.co"),
    )


def adapt_ashby(landed):
    board = F.try_variant_get(F.try_parse_json("body"), "$.data.jobBoard", "variant")
    # Postings of all teams in one list, so that positions count through the whole response.
    postings = F.flatten(F.transform(
        _get(_c("board"), "jobPostingsByTeam", "array<variant>"),
        lambda t: F.coalesce(F.transform(
            _get(t, "jobPostings", "array<variant>"),
            lambda p: F.struct(_get(t, "name").alias("team"), p.alias("e"))),
            F.array().cast("array<struct<team:string,e:variant>>"))))
    rows = landed.withColumn("board", board).select(
        "seq", "origin", "board", F.posexplode(postings).alias("pos", "p")).select(
        "seq", "origin", "board", "pos", "p.team", "p.e")
    e = _c("e")
    second = F.try_element_at(_get(e, "secondaryLocations", "array<variant>"), F.lit(1))
    is_object = F.schema_of_variant(second).startswith("OBJECT")
    place = F.coalesce(
        text.nonblank(_get(e, "locationName")),
        F.when(is_object, F.coalesce(_get(second, "locationName"), F.lit("Remote")))
        .otherwise(F.try_variant_get(second, "$", "string")), F.lit("Remote"))
    rows = rows.withColumns({
        "page": F.concat(F.lit("https://jobs.ashbyhq.com/api/non-user-graphql?op=apiJobBoardWithTeams"
                               "&organizationHostedJobsPageName="), "origin"),
        "title": F.coalesce(_get(e, "title"), F.lit("Unknown role")), "html": _get(e, "descriptionHtml"),
    }).withColumn("plain", text.clean_html(_c("html")))
    url = _filled(_get(e, "jobUrl"), _c("page"))
    return _raw(
        rows, "ashby", title=_c("title"),
        company=_filled(_get(_c("board"), "name"), urls.slug_company(_c("origin"))),
        location=place, description=_c("plain"), description_html=_c("html"), job_url=url, apply_url=url,
        job_type=F.lower(_filled(_get(e, "employmentType"), F.lit("unknown"))),
        skills=skills.infer_tags(_get(e, "title"), _c("plain"), _c("team")),
        posted_text=_get(e, "publishedDate"), source_job_id=_get(e, "id"),
        source_website=F.lit("jobs.ashbyhq.com"),
    )


def _failed(landed, source, label, why):
    """(source, message) of the landed texts for which ``why`` gives a reason."""
    return landed.select(F.lit(source).alias("source"), F.concat(
        F.lit(label + " '"), F.coalesce("origin", F.lit("")), F.lit("' failed: "), why).alias("message")).filter(_c("message").isNotNull())


#: What a JSON feed's response has to be.
SHAPES = {"remoteok": "ARRAY", "lever": "ARRAY", "greenhouse": "OBJECT", "ashby": "OBJECT"}


def feed_errors(landed, source, label):
    """(source, message) for every landed response that is not readable JSON or not of the feed's shape."""
    doc = F.try_parse_json("body")
    wrong = ~F.schema_of_variant(doc).startswith(SHAPES.get(source, ""))
    return _failed(landed, source, label, F.when(doc.isNull(), "unreadable response").when(wrong, "unexpected shape"))


def rss_errors(landed, source, label):
    """(source, message) for every landed feed that is not well-formed XML."""
    read = F.from_xml("body", "channel string, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    broken = _c("body").isNull() | ~F.contains("body", F.lit("<")) | read["broken"].isNotNull()
    return _failed(landed, source, label, F.when(broken, "unreadable response"))


def page_errors(landed, source, label):
    """(source, message) for every landed page without any text."""
    return _failed(landed, source, label, F.when(text.normalize_ws(_c("body")) == "", "empty page"))
