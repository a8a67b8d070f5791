"""Postings embedded in pages as JSON-LD."""

from pyspark.sql import functions as F

from ..functions import salary, skills, text, urls
from ..schema import RAW_SCHEMA, conform
from .feeds import POSITION_BITS

_c = F.col
_SCRIPT = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""
_STRING = r'"(?:[^"\\]++|\\.)*+"'


def _unfold(v):
    """Elements of a list, members of a @graph list, or the item itself."""
    return F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"),
        F.try_variant_get(v, '$["@graph"]', "array<variant>"),
        F.array(v))


def _nesting(script):
    """How deep lists are nested in a JSON text: the greatest number of open brackets."""
    brackets = F.regexp_replace(F.regexp_replace(script, _STRING, ""), r"[^\[\]]", "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(held, sign):
        now = held["open"] + F.when(sign == "[", 1).when(sign == "]", -1).otherwise(0)
        return F.struct(now.alias("open"), F.greatest(held["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step)["most"]


def jsonld_items(html):
    """All JSON-LD objects of a page, in lists and @graph lists of any depth; unreadable scripts are skipped.

    Each round takes up one level of every item.  A list cannot lie deeper than its brackets, so their
    nesting is the number of rounds.
    """
    scripts = F.regexp_extract_all(html, F.lit(_SCRIPT), F.lit(1))
    items = F.filter(F.transform(scripts, F.try_parse_json), lambda v: v.isNotNull())
    rounds = F.array_max(F.transform(scripts, _nesting))
    work = F.aggregate(F.sequence(F.lit(1), rounds), items, lambda held, _: F.flatten(F.transform(held, _unfold)))
    return F.when(rounds > 0, work).otherwise(items)


def job_postings(html):
    """The items whose type is exactly JobPosting."""
    return F.filter(jsonld_items(html),
                    lambda v: F.try_variant_get(v, '$["@type"]', "string") == "JobPosting")


def _get(v, path, kind="string"):
    return F.try_variant_get(v, "$." + path, kind)


def _is(v, kind):
    return F.schema_of_variant(v).startswith(kind)


def _address(place):
    parts = [_get(place, f"address.{n}") for n in ("addressLocality", "addressRegion", "addressCountry")]
    return text.join_nonblank(", ", *parts)


def first_location(item):
    """Address of the first location, '' without one."""
    place = F.coalesce(_get(item, "jobLocation[0]", "variant"), _get(item, "jobLocation", "variant"))
    return text.text_or_empty(_address(place))


def any_location(item):
    """First location that yields a text: its address, else its name, else the text itself."""
    value = _get(item, "jobLocation", "variant")
    places = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))

    def read(p):
        has_address = F.coalesce(_is(_get(p, "address", "variant"), "OBJECT"), F.lit(False))
        name = F.when(_is(_get(p, "name", "variant"), "STRING"), F.trim(_get(p, "name")))
        return F.when(_is(p, "STRING"), F.trim(F.try_variant_get(p, "$", "string"))).otherwise(
            F.when(has_address, _address(p)).otherwise(name))

    return F.try_element_at(F.filter(F.transform(places, read), lambda t: t != ""), F.lit(1))


def pay_text(item, with_unit=False):
    currency = F.coalesce(text.nonblank(_get(item, "baseSalary.currency")), _get(item, "baseSalary.currencyCode"))
    low, high = _get(item, "baseSalary.value.minValue"), _get(item, "baseSalary.value.maxValue")
    unit = _get(item, "baseSalary.value.unitText") if with_unit else None
    return salary.salary_text(currency, low, high, unit)


def identifier(item):
    value = F.coalesce(
        text.nonblank(_get(item, "identifier.value")), text.nonblank(_get(item, "identifier.name")),
        F.when(~_is(_get(item, "identifier", "variant"), "OBJECT"), text.nonblank(_get(item, "identifier"))))
    return F.trim(value)


def employment_type(item):
    first = F.coalesce(_get(item, "employmentType[0]"), F.when(
        _is(_get(item, "employmentType", "variant"), "STRING"), _get(item, "employmentType")))
    return F.lower(F.coalesce(first, F.lit("unknown")))


def adapt_careerspage(pages):
    """Every JobPosting of every page ``(seq, url, html)`` as a raw row."""
    rows = pages.select("seq", "url", F.posexplode(job_postings(_c("html"))).alias("pos", "e"))
    e = _c("e")
    rows = rows.withColumns({
        "title": F.coalesce(_get(e, "title"), F.lit("Unknown role")),
        "company": F.coalesce(text.nonblank(_get(e, "hiringOrganization.name")), urls.domain_company(_c("url"))),
        "plain": text.clean_html(_get(e, "description")),
        "link": F.coalesce(text.nonblank(_get(e, "url")), _c("url")),
    })
    place = F.coalesce(text.nonblank(first_location(e)), text.nonblank(_get(e, "jobLocationType")), F.lit("Remote"))
    return conform(rows.select(
        F.lit("careerspage").alias("source"),
        (F.shiftleft(_c("seq").cast("bigint"), POSITION_BITS) + _c("pos")).alias("arrival"),
        "title", "company", place.alias("location"), _c("plain").alias("description"),
        _get(e, "description").alias("description_html"), _c("link").alias("job_url"), _c("link").alias("apply_url"),
        employment_type(e).alias("job_type"),
        skills.infer_tags(_get(e, "title"), _c("plain"), _c("company")).alias("skills"),
        _get(e, "datePosted").alias("posted_text"), pay_text(e).alias("salary_text"),
        identifier(e).alias("source_job_id"),
        F.lower(F.replace(urls.domain_company(_c("url")), F.lit(" "), F.lit(""))).alias("source_website"),
    ), RAW_SCHEMA)
