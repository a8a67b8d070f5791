"""Posting filters."""

from functools import reduce

from pyspark.sql import functions as F

_c = F.col


def _has(column, text):
    """Case-insensitive substring; percent and underscore are ordinary characters."""
    return F.contains(F.lower(_c(column)), F.lit(text))


def _any_skill(text):
    return F.exists("skills", lambda s: F.contains(s, F.lit(text)))


def filter_postings(postings, keyword=None, location=None, source=None, company=None,
                    job_type=None, workplace_type=None, experience_level=None, skill=None):
    """All given conditions hold; a missing or empty argument is no condition."""
    tests = []
    if source:
        tests.append(_c("source") == source)
    if workplace_type:
        tests.append(_c("workplace_type") == workplace_type)
    if experience_level:
        tests.append(_c("experience_level") == experience_level)
    for column, value in (("location", location), ("company", company), ("job_type", job_type)):
        if value:
            tests.append(_has(column, value.lower()))
    if skill:
        tests.append(_any_skill(skill.lower()))
    if keyword:
        word = keyword.lower()
        tests.append(_has("title", word) | _has("company", word) | _has("description", word) | _any_skill(word))
    if not tests:
        return postings
    return postings.filter(reduce(lambda a, b: a & b, tests))
