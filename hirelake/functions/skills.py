"""Skill extraction."""

from pyspark.sql import functions as F

from .. import vocab
from .text import (
    clean_html, contains_any, join_nonblank, let, normalize_tags, normalize_ws, text_or_empty,
)

_PHRASE = "(?U)(?:" + "|".join(vocab.SKILL_LEAD_INS) + r")\s+([a-z0-9+/#\-\s]{3,60})"


def skills_in(padded, tags=None, limit=None):
    """Skills of prepared text with a blank at both ends."""
    known = F.array_compact(F.array(*[
        F.when(contains_any(padded, aliases), F.lit(name)) for name, aliases in vocab.SKILLS
    ]))
    none = F.array().cast("array<string>")
    matches = F.when(contains_any(padded, vocab.SKILL_LEAD_INS),
                     F.regexp_extract_all(padded, F.lit(_PHRASE), F.lit(1))).otherwise(none)
    phrases = F.filter(
        F.transform(matches, lambda m: normalize_ws(
            F.element_at(F.split(m, r"[.;:,]| and | or ", 2), 1))),
        lambda p: F.size(F.split(p, " ")).between(2, 4))
    extra = phrases if tags is None else F.concat(normalize_tags(tags), phrases)
    # Known names are clean and distinct already.
    found = F.array_union(known, normalize_tags(extra))
    return found if limit is None else F.slice(found, 1, limit)


def extract_skills(title, company=None, description=None, tags=None, limit=None):
    """Known skills in vocabulary order, then given tags, then phrases after a lead-in."""
    words = [text_or_empty(c) for c in (title, company, description) if c is not None]
    padded = F.concat(F.lit(" "), F.lower(clean_html(F.concat_ws(" ", *words))), F.lit(" "))
    return let(padded, lambda p: skills_in(p, tags, limit))


def infer_tags(*values):
    return extract_skills(join_nonblank(" ", *values))


def title_tags(title):
    """Feed keywords contained in a title."""
    low = F.lower(title)
    return F.array_compact(F.array(*[
        F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in vocab.FEED_TITLE_TAGS]))
