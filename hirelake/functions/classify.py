"""Job type, seniority and workplace labels.

Each rule has a core over prepared text (cleaned, lower-cased) and a form that prepares the text
itself.  Jobs that apply several rules prepare the text once and use the cores.
"""

import re

from pyspark.sql import functions as F

from .. import vocab
from .text import clean_html, contains_any, join_nonblank, let, nonblank, text_or_empty


def _first_label(cases, default):
    out = None
    for test, label in cases:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default)


def prepared(*parts):
    return F.lower(clean_html(join_nonblank(" ", *[p for p in parts if p is not None])))


def job_type_in(low):
    """First pattern, in fixed order, found in prepared text.

    The stem of a pattern is looked for first: a plain search costs next to nothing, and a text
    without the stem cannot match.
    """
    def found(pattern):
        stem = re.match(r"\\b([a-z]+)", pattern).group(1)
        return F.contains(low, F.lit(stem)) & low.rlike("(?U)" + pattern)

    return _first_label([(found(p), n) for p, n in vocab.JOB_TYPES], "unknown")


def job_type(value, title=None, description=None):
    """First pattern found anywhere in value, title and description."""
    return let(prepared(value, title, description), job_type_in)


def job_type_from_labels(low):
    """Literal labels used by one feed, tested in order on lower-cased text."""
    return _first_label([(F.contains(low, F.lit(n)), n) for n in vocab.FEED_JOB_LABELS], "unknown")


def commitment(c):
    return F.lower(F.trim(F.coalesce(nonblank(c), F.lit("unknown"))))


def experience_in(low):
    return _first_label([(contains_any(low, ws), n) for n, ws in vocab.EXPERIENCE_WORDS], "unknown")


def experience_level(value):
    return let(prepared(value), experience_in)


def level_of_years(digits):
    """Level for the digits of a stated duration; '' gives unknown."""
    years = F.coalesce(nonblank(digits).try_cast("int"), F.lit(1_000_000))
    cases = [(digits == "", "unknown"), *[(years <= b, n) for b, n in vocab.YEARS_TO_LEVEL]]
    return _first_label(cases, "lead")


_YEARS = r"(\d+)\+?\s+years?"


def infer_experience_in(low):
    explicit = F.nullif(experience_in(low), F.lit("unknown"))
    digits = F.when(F.contains(low, F.lit("year")), F.regexp_extract(low, _YEARS, 1)).otherwise("")
    return F.coalesce(explicit, let(digits, level_of_years))


def infer_experience(title, description):
    """Seniority words in title and description, else the first stated number of years."""
    return let(prepared(title, description), infer_experience_in)


def workplace_in(low, location):
    """Workplace of prepared text; without a keyword a stated place means onsite."""
    place = F.lower(text_or_empty(location))
    cases = [(contains_any(low, ws), n) for n, ws in vocab.WORKPLACE_WORDS]
    cases += [(place.isin(*vocab.VAGUE_PLACES), "unknown"), (place != "", "onsite")]
    return _first_label(cases, "unknown")


def workplace_type(location, title=None, description=None):
    return let(prepared(location, title, description), lambda low: workplace_in(low, location))
