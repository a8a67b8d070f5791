"""HTML job boards: listing pages to listing rows, detail pages to metadata, and their join."""

from dataclasses import dataclass, field

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import dates, skills, text, urls
from ..functions.classify import job_type
from ..operators.normalise import looks_like_job, merge_lists, merge_values
from ..operators.ordering import unique_first
from ..schema import RAW_SCHEMA, conform
from ..session import cut_lineage, stage_boundary
from . import dom, jsonld
from .feeds import POSITION_BITS

_c = F.col

# Badges and labels of the boards.
_BADGES = ("FEATURED", "New", "Popular", "Easy apply")
_PLACES_A = r"(Remote \(Work From Home\)|Nairobi|Mombasa|Kisumu|Nakuru|Rest of Kenya|Outside Kenya)"
_PLACES_B = ("Nairobi", "Mombasa", "Kisumu", "Nakuru", "Kakamega", "Rest of Kenya", "Remote")
_PLACES_C = r"(?U)\b(nairobi|mombasa|kisumu|nakuru|kampala|lagos|abuja|accra)\b"
_PAY_A = r"(KSh(?U:\s)+[^A-Z\n]+|Confidential)"
_PAY_B = (r"(\d[\d,]*(?:\.\d+)?\s*[Kk]\s*(?:-|to|–)\s*\d[\d,]*(?:\.\d+)?\s*[Kk]"
          r"|\d[\d,]*(?:\.\d+)?\s*[Kk])")
_COMPANY_B = r"([A-Z][A-Za-z0-9&.\-\s]{2,60})\s+Jobs"


def _first(values):
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(1))


def _match(c, pattern, group=1):
    return text.nonblank(F.regexp_extract(c, pattern, group))


def _type_of_lines(lines):
    known = F.filter(F.transform(lines, lambda x: job_type(x)), lambda t: t != "unknown")
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.lit("unknown"))


def line_date(lines, as_of):
    """First line that reads as a listing date."""
    return _first(F.transform(lines, lambda x: dates.parse_relative_date(x, as_of)))


def split_role_company(title):
    """Role and employer of "Role at Employer"."""
    clean = text.normalize_ws(title)
    has = F.contains(clean, F.lit(" at "))
    role = F.substring_index(clean, " at ", 1)
    company = F.regexp_extract(clean, r"(?s)^.*? at (.*)$", 1)
    shown = F.when(F.lower(role).startswith("fresh jobs"), F.lit("Multiple Open Roles")).otherwise(
        F.regexp_replace(role, "^[ -]+|[ -]+$", ""))
    return F.struct(F.when(has, shown).otherwise(clean).alias("role"),
                    F.when(has, F.trim(company)).otherwise("MyJobMag Employer").alias("company"))


# ---- listing fields per board: (title, lines, page url, as_of) -> dict of columns


def brightermonday_fields(title, lines, page, as_of):
    at = F.array_position(lines, title)
    nxt = F.when(at > 0, F.try_element_at(lines, at.cast("int") + 1))
    company = F.coalesce(F.when(~nxt.isin(*_BADGES), nxt), F.lit("BrighterMonday Employer"))
    place = _first(F.transform(lines, lambda x: _match(x, _PLACES_A)))
    body = F.filter(lines, lambda x: ~x.isin(*_BADGES) & (x != title) & (x != company) & (job_type(x) == "unknown"))
    return {
        "company": company,
        "location": F.when(place.startswith("Remote"), F.lit("Remote")).otherwise(F.coalesce(place, F.lit("Kenya"))),
        "description": F.array_join(body, " "),
        "job_type": _type_of_lines(lines),
        "salary_text": F.trim(_match(F.array_join(lines, " "), _PAY_A)),
        "posted_ts": line_date(lines, as_of),
        "source_website": F.lit("brightermonday.co.ke"),
    }


def corporatestaffing_fields(title, lines, page, as_of):
    body = F.filter(lines, lambda x: (x != title) & (x != "Page navigation"))
    description = F.array_join(body, " ")
    both = F.lower(F.concat_ws(" ", title, description))
    place = F.when(F.lit(False), F.lit(""))
    for name in _PLACES_B:
        place = place.when(F.contains(both, F.lit(name.lower())), name)
    company = F.coalesce(_match(title, _COMPANY_B), _match(description, _COMPANY_B))
    by_line = _type_of_lines(lines)
    # Each line in turn: a date, or the line itself when it shows a four-digit number.
    stamps = F.transform(lines, lambda x: F.struct(
        dates.parse_relative_date(x, as_of).alias("ts"), x.rlike(r"(?U)\b\d{4}\b").alias("year"), x.alias("line")))
    stamp = F.try_element_at(F.filter(stamps, lambda s: s["ts"].isNotNull() | s["year"]), F.lit(1))
    return {
        "company": F.coalesce(F.regexp_replace(company, "^[ .]+|[ .]+$", ""), F.lit("Corporate Staffing Services")),
        "location": place.otherwise("Kenya"),
        "description": description,
        "job_type": F.when(by_line == "unknown", job_type(description)).otherwise(by_line),
        "salary_text": F.trim(F.coalesce(_match(title, _PAY_B), _match(description, _PAY_B))),
        "posted_ts": stamp["ts"], "posted_text": F.when(stamp["ts"].isNull(), stamp["line"]),
        "source_website": F.lit("corporatestaffing.co.ke"),
    }


def myjobmag_fields(title, lines, page, as_of):
    description = F.array_join(F.filter(lines, lambda x: x != title), " ")
    low = F.lower(description)
    pair = split_role_company(title)
    fallback = F.when(F.contains(page, F.lit("kenya")), F.lit("Kenya")).when(
        F.contains(page, F.lit(".com/jobs")), "Nigeria").otherwise("Africa")
    city = text.py_title(_match(low, _PLACES_C))
    return {
        "title": pair["role"], "company": pair["company"],
        "location": F.coalesce(city, F.when(F.contains(low, F.lit("remote")), F.lit("Remote")), fallback),
        "description": description, "job_type": F.lit("unknown"), "posted_ts": line_date(lines, as_of),
        "source_website": F.when(F.contains(page, F.lit(".co.ke")), F.lit("myjobmag.co.ke")).otherwise("myjobmag.com"),
    }


def fuzu_fields(title, lines, page, as_of):
    return {
        "title": F.coalesce(text.nonblank(title), F.lit("Unknown role")), "company": F.lit("Fuzu Employer"),
        "location": F.lit("Africa"), "description": title, "job_type": F.lit("unknown"),
        "source_website": F.lit("fuzu.com"),
    }


# ---- metadata of detail pages: text of the page -> dict of columns


# Fixed values below: labels and places as the boards print them.
def _label(page_text, pattern, strip=True):
    value = F.regexp_extract(page_text, pattern, 1)
    return text.nonblank(F.trim(value) if strip else value)


def brightermonday_meta(page_text):
    body = text.nonblank(text.slice_between(
        text.text_lines(page_text), ("Job descriptions & requirements",),
        ("Important safety tips", "Log in to apply now", "Similar jobs")))
    return {
        "location": _label(page_text, r"Applicant Location:\s*([^\n]+)"),
        "experience_level": _label(
            page_text, r"Experience Level:\s*([^\n]+?)(?:Experience Length:|Applicant Location:)"),
        "job_type": _label(page_text, r"(?U)\b(Full Time|Contract|Part Time|Internship & Graduate)\b"),
        "salary_text": _label(page_text, r"(KSh\s+[^\n]+|Confidential)"),
        "description": body, "description_html": body,
    }


def myjobmag_meta(page_text):
    body = text.nonblank(text.slice_between(
        text.text_lines(page_text), ("Description",),
        ("Method of Application", "Jobs You Might Be Interested in", "Career Advice")))
    return {
        "posted_text": _label(page_text, r"Posted:\s*([^\n]+)"),
        "job_type": _label(page_text, r"Job Type\s+([^\n]+)"),
        "experience_level": _label(page_text, r"Experience\s+([^\n]+)"),
        "location": _label(page_text, r"Location\s+([^\n]+)"),
        "company": _label(page_text, r"View Jobs at\s+([^\n]+)"),
        "description": body, "description_html": body,
    }


_FUZU_PLACE = (r"(?isU)\b(Nairobi|Mombasa|Kisumu|Nakuru|Kampala|Lagos|Abuja|Ibadan|Jinja|Mukono)\b[^\n]*?"
               r"\b(Kenya|Uganda|Nigeria)\b")


def fuzu_meta(page_text):
    lines = text.text_lines(page_text)
    marked = F.array_position(F.transform(lines, lambda x: x.startswith("# ")), F.lit(True))
    plain = F.array_position(F.transform(lines, lambda x: ~x.startswith("[")), F.lit(True))
    at = F.when(marked > 0, marked).otherwise(plain).cast("int")
    company = F.when(at > 2, F.try_element_at(lines, at - 2)).when(at == 2, F.try_element_at(lines, F.lit(1)))
    body = text.nonblank(text.slice_between(
        lines, ("Description", "Responsibilities"), ("Tags", "Start hiring with Fuzu", "Job search tips from Fuzu")))
    words = F.regexp_extract_all(text.text_or_empty(body), F.lit(r"(?U)\b([A-Z][A-Za-z]+(?:,\s*[A-Za-z]+)?)\b"), F.lit(1))
    title = F.try_element_at(F.filter(lines, lambda x: x.startswith("# ")), F.lit(1))
    city, country = (text.py_title(_match(page_text, _FUZU_PLACE, i)) for i in (1, 2))
    return {
        "title": F.trim(F.regexp_replace(title, "^# ", "")),
        "company": company,
        "location": F.when(city.isNotNull(), F.concat(city, F.lit(", "), country)),
        "experience_level": _match(page_text, r"(?iU)\b(Entry-level|Entry and Basic-level|Mid-level|Senior-level)\b"),
        "description": body, "description_html": body,
        "skills": F.when(F.size(words) > 0, words),
    }


@dataclass(frozen=True)
class Board:
    """What distinguishes one board: link patterns, listing fields, detail metadata, selectors."""

    source: str
    patterns: tuple
    fields: object
    meta: object = None
    min_title: int = 0
    stop_titles: tuple = ()
    selectors: dict = field(default_factory=dict)


BOARDS = {b.source: b for b in (
    Board("myjobmag", ("/job/",), myjobmag_fields, myjobmag_meta, 6,
          selectors={"title": ("h1",), "company": ("a[href*='view-jobs-at']",), "description": ("main",)}),
    Board("brightermonday", ("/listings/", "/job/"), brightermonday_fields, brightermonday_meta, 4,
          ("homepage", "search results"),
          {"title": ("h1",), "company": ("h2",), "location": ("main",), "description": ("main",)}),
    Board("corporatestaffing", ("/job/", "/jobs/"), corporatestaffing_fields, None, 6),
    Board("fuzu", ("/job/",), fuzu_fields, fuzu_meta, 0,
          selectors={"title": ("h1",), "company": ("main",), "location": ("main",), "description": ("main",)}),
)}


def board_listings(pages, board, as_of):
    """Listing rows of result pages ``(seq, url, html)`` in page and link order."""
    any_link = text.contains_any(_c("html"), board.patterns)
    nodes = dom.with_nodes(pages.filter(any_link).select("seq", "url", "html"))
    found = nodes.select("seq", "url", F.posexplode(dom.links(board.patterns, vocab.BLOCKED_LINK_TEXTS)).alias("pos", "a"))
    rows = found.select("seq", "url", "pos", "a.*")
    if board.source == "fuzu":
        rows = rows.filter(~F.regexp_replace("href", "/+$", "").isin("", "/job")
                           & ~F.contains(F.lower("title"), F.lit("get personalised job alerts")))
    else:
        rows = rows.filter((F.length("title") >= board.min_title) & ~F.lower("title").isin("", *board.stop_titles))
    # Under another name: inside a lambda ``title`` would mean the field made here.
    rows = rows.withColumnRenamed("title", "anchor")
    fields = {"title": _c("anchor"), **board.fields(_c("anchor"), _c("lines"), _c("url"), as_of)}
    rows = rows.select(
        "seq", "pos", _c("url").alias("page_url"), urls.absolute_href(_c("url"), _c("href")).alias("job_url"),
        *[c.alias(n) for n, c in fields.items()])
    out = stage_boundary(rows).withColumns({"source": F.lit(board.source), "apply_url": _c("job_url"),
                            "arrival": F.shiftleft(_c("seq").cast("bigint"), POSITION_BITS) + _c("pos")})
    if board.source != "fuzu":
        out = out.withColumn("skills", skills.infer_tags(_c("title"), _c("company"), _c("description")))
    return out


# ---- detail pages


def detail_fields(board):
    """Fields a detail page offers on its own, in the order JSON-LD, selectors, page metadata.

    Needs the columns ``url``, ``html``, ``nodes``, ``texts``.
    """
    def chosen(name, key=None):
        return [*board.selectors.get(name, ()), *vocab.FIELD_SELECTORS[key or name]]

    ld = F.try_element_at(jsonld.job_postings(_c("html")), F.lit(1))
    get = lambda path: F.trim(F.try_variant_get(ld, "$." + path, "string"))
    pick = lambda *cols: F.coalesce(*[text.nonblank(F.trim(c)) for c in cols])
    stamp = F.try_element_at(F.filter(_c("nodes"), lambda n: (n["tag"] == "time") & dom.attr(n, "datetime").isNotNull()), F.lit(1))
    node = dom.select_first(chosen("description"))
    return {
        "title": pick(get("title"), dom.first_text(chosen("title")), dom.meta_content("og:title")),
        "company": pick(get("hiringOrganization.name"), dom.first_text(chosen("company")), dom.meta_content("og:site_name")),
        "location": pick(jsonld.any_location(ld), dom.first_text(chosen("location")), get("applicantLocationRequirements[0].name")),
        "description": pick(text.html_text(get("description")), text.let(node, lambda n: dom.node_text(n, "\n"))),
        "description_html": pick(get("description"), text.let(node, lambda n: dom.inner_html(n))),
        "apply_url": get("url"), "job_url": get("url"),
        "job_type": pick(get("employmentType"), dom.first_text(chosen("job_type"))),
        "salary_text": pick(jsonld.pay_text(ld, with_unit=True), dom.first_text(chosen("salary"))),
        "posted_text": pick(get("datePosted"), dom.attr(stamp, "datetime"), dom.first_text(chosen("posted_at"))),
        "source_job_id": jsonld.identifier(ld),
        "experience_level": pick(get("experienceRequirements"), dom.first_text(chosen("experience"))),
        "skills": dom.short_texts(chosen("skills")),
    }


def extract_details(pages, board):
    """Detail pages ``(url, html)`` to one row of fields and metadata each."""
    rows = dom.with_nodes(pages.select("url", "html"))
    page_text = text.html_text(_c("html"))
    own = F.struct(*[c.alias(n) for n, c in detail_fields(board).items()])
    if board.meta is None:
        return rows.select("url", own.alias("own"))
    rows = rows.withColumn("page_text", page_text)
    meta = F.struct(*[c.alias(n) for n, c in board.meta(_c("page_text")).items()])
    return rows.select("url", own.alias("own"), meta.alias("meta"))


def enrich_listings(listings, details, board, per_page=None):
    """Listings joined with their detail pages.

    With ``per_page`` only the first listings of a result page are looked up; all stay.  Values of the listing come
    first, then the page's own, then its metadata; list fields are united.  Listings without a
    detail page stay as they are and carry a message in ``degraded``.
    """
    wanted = listings.withColumn("_look", F.lit(True) if per_page is None else F.row_number().over(
        Window.partitionBy("seq", "page_url").orderBy("pos")) <= per_page)
    # Each address has one detail page, however often it was read.
    pages = unique_first(details.withColumn("_order", F.xxhash64("own")), "url", "_order").withColumnsRenamed(
        {"url": "_url"}).drop("_order")
    joined = wanted.join(pages, _c("_look") & (_c("job_url") == _c("_url")), "left")
    found = _c("own").isNotNull()
    own, meta = set(detail_fields(board)), set() if board.meta is None else set(board.meta(F.lit("")))
    out = {}
    for f in RAW_SCHEMA.fields:
        n = f.name
        listed = _c(n) if n in listings.columns else F.lit(None).cast(f.dataType)
        if n in ("source", "arrival", "posted_ts", "source_website") or n not in own | meta:
            out[n] = listed
        elif n == "skills":
            base = F.when(F.size(listed) > 0, listed).otherwise(_c("own.skills"))
            groups = [base] + ([_c("meta.skills")] if n in meta else []) + [listed]
            out[n] = F.when(found, merge_lists(groups)).otherwise(listed)
        else:
            base = F.coalesce(text.nonblank(F.trim(listed)), _c(f"own.{n}") if n in own else F.lit(None))
            if n in ("job_url", "apply_url"):
                base = urls.absolute_href(_c("job_url"), base)
            groups = [base] + ([_c(f"meta.{n}")] if n in meta else []) + [listed]
            out[n] = F.when(found, merge_values(groups)).otherwise(listed)
    # A parsed listing date wins over any text of the detail page.
    out["posted_text"] = F.when(_c("posted_ts").isNull(), out["posted_text"]) if "posted_ts" in listings.columns else out["posted_text"]
    label = F.concat(F.lit(board.source + " listing '"), _c("job_url"), F.lit("' detail parsing degraded: no detail page"))
    return joined.select(*[c.alias(n) for n, c in out.items()], F.when(~found, label).alias("degraded"))


def linked_pages(listings, pages):
    """The detail pages ``(url, html)`` that a listing links to, each address once.

    Cut down before anything is parsed, so that pages nobody links to cost a look at their address.  Of
    several readings of an address the one with the smallest digest stays.
    """
    wanted = listings.select(_c("job_url").alias("url")).distinct()
    linked = pages.select("url", "html").join(wanted, "url", "left_semi")
    return unique_first(linked.withColumn("_order", F.xxhash64("html")), "url", "_order").drop("_order")


def adapt_board(listing_pages, detail_pages, board, as_of, per_page=None):
    """Raw rows of a board; noise is dropped as the listing is read."""
    listings = board_listings(listing_pages, board, as_of)
    if board.meta is None:
        rows = conform(listings, RAW_SCHEMA)
    else:
        listings = cut_lineage(listings)  # their addresses choose the pages, their rows are joined to them
        rows = enrich_listings(listings, extract_details(linked_pages(listings, detail_pages), board), board, per_page)
    return stage_boundary(rows).filter(looks_like_job(_c("title"), _c("description")))
