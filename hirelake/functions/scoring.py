"""Identity and completeness of postings."""

from pyspark.sql import functions as F

from .text import normalize_ws, text_or_empty
from .urls import canonical_url


def fingerprint(title, company, location, source_job_id, url):
    parts = [F.lower(normalize_ws(c)) for c in (title, company, location)]
    parts += [F.lower(text_or_empty(c)) for c in (source_job_id, url)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def _given(c):
    return text_or_empty(c) != ""


def score_flags():
    """The 13 yes/no parts of the score over posting columns, in a fixed order."""
    c = F.col
    num = lambda name: F.coalesce(c(name) != 0, F.lit(False))
    return [
        _given(c("title")),
        _given(c("company")) & (F.lower(c("company")) != "unknown company"),
        _given(c("location")) & ~F.lower(c("location")).isin("unspecified", "africa", "kenya"),
        _given(c("description")),
        c("posted_at").isNotNull(),
        _given(c("job_url")),
        F.coalesce(c("job_type") != "unknown", F.lit(True)),
        F.coalesce(c("experience_level") != "unknown", F.lit(True)),
        _given(c("salary_text")) | num("salary_min") | num("salary_max"),
        F.coalesce(F.size("skills") > 0, F.lit(False)),
        _given(c("source_website")),
        _given(c("source_job_id")),
        c("scraped_at").isNotNull(),
    ]


def completeness():
    """Score 0..22 of a posting row."""
    total = F.lit(0)
    for flag in score_flags():
        total = total + F.coalesce(flag, F.lit(False)).cast("int")
    size = lambda name, cap: F.least(F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0)), F.lit(cap))
    return (total + size("description_sections", 4) + size("skills", 5)).cast("int")


def signature_list(source, job_id, url_key, title, company, city, country, job_type):
    """Match keys in priority order; ``url_key`` is already canonical and lower-cased."""
    low = lambda c: F.lower(normalize_ws(c))
    return joined_signatures(source, F.lower(job_id), url_key, low(title), low(company), low(city), low(country), low(job_type))


def joined_signatures(source, job_id, url_key, title, company, city, country, job_type):
    """``signature_list`` of values that are lower-cased and tidied already."""
    t, co, city, country, job_type = map(text_or_empty, (title, company, city, country, job_type))
    return F.array_compact(F.array(
        F.when(_given(job_id), F.concat(F.lit("source-id:"), source, F.lit(":"), job_id)),
        F.when(_given(url_key), F.concat(F.lit("url:"), url_key)),
        F.when((t != "") & (co != ""), F.concat(F.lit("content:"), F.concat_ws("|", t, co, city, country, job_type))),
    ))


def url_key():
    first = F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in ("canonical_url", "job_url", "apply_url")])
    return F.lower(canonical_url(first))


def job_signatures():
    """Signatures over posting columns."""
    c = F.col
    return signature_list(c("source"), c("source_job_id"), url_key(), c("title"), c("company"),
                          c("location_city"), c("location_country"), c("job_type"))
