"""Detail-view transforms: sections, bullet points and previews of one description."""

from pyspark.sql import functions as F

from .. import vocab
from .text import let, nonblank, text_or_empty

_WS = r"(?U)[\s\ufeff]+"
_EDGE = r"(?U)^[\s\ufeff]+|[\s\ufeff]+$"
_POINT_SPLIT = (
    r"(?i)(?:(?:^|\s)(?:" + "|".join(vocab.POINT_HEADINGS) + r")\s*:?)|[•;]|(?<=\.)\s+(?=[A-Z0-9])"
)
_LEAD = r"(?i)^(" + "|".join(vocab.LEAD_HEADINGS) + r")\s*:?\s*"
_HOURS = r"(?i)(\d{1,2}\s*(?:-|to)\s*\d{1,2}|\d{1,2})\s*(hours|hrs)\s*(?:per|/)\s*week"


def _trim(c):
    return F.regexp_replace(c, _EDGE, "")


def split_points(c):
    """Readable points: cut at headings, bullets, semicolons and sentence ends; short ones dropped."""
    flat = F.regexp_replace(text_or_empty(c), _WS, " ")
    parts = F.filter(F.transform(F.split(flat, _POINT_SPLIT), _trim), lambda p: F.length(p) > 20)
    return F.filter(F.transform(parts, lambda p: _trim(F.regexp_replace(p, _LEAD, ""))), lambda p: p != "")


def humanize(c):
    parts = F.transform(F.split(text_or_empty(c), "[-_]"), lambda p: F.concat(
        F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))
    return F.array_join(parts, " ")


def hours_per_week(c):
    g = lambda i: F.regexp_extract(text_or_empty(c), _HOURS, i)
    return F.when(g(0) != "", F.concat(g(1), F.lit(" "), g(2), F.lit("/week")))


def _first_of(text, markers):
    """1-based position of the earliest marker in lower-cased text, 0 when none occurs."""
    hits = F.filter(F.array(*[F.position(F.lit(m), text)
                             for m in markers]), lambda p: p > 0)
    return F.coalesce(F.array_min(hits), F.lit(0))


def detail_parts(description):
    """struct(about, responsibilities, requirements) as raw text slices."""
    text = text_or_empty(description)

    def cut(at):
        req, resp, end = at["req"], at["resp"], F.length(text) + 1
        starts = F.filter(F.array(req, resp), lambda p: p > 0)
        intro = F.coalesce(F.array_min(starts), end)
        resp_end = F.when(req > resp, req).otherwise(end)
        return F.struct(
            F.substring(text, F.lit(1), intro - 1).alias("about"),
            F.when(resp > 0, F.substring(text, resp, resp_end - resp)).otherwise("").alias("responsibilities"),
            F.when(req > 0, F.substring(text, req, end - req)).otherwise("").alias("requirements"),
        )

    marks = let(F.lower(text), lambda low: F.struct(
        _first_of(low, vocab.REQUIREMENT_MARKERS).alias("req"),
        _first_of(low, vocab.RESPONSIBILITY_MARKERS).alias("resp")))
    return let(marks, cut)


def about_fields(title, job_type, location, salary_text, description):
    """Labelled facts of a posting; facts without a value are left out."""
    rows = [("Position", title), ("Type", humanize(job_type)), ("Location", location),
            ("Compensation", salary_text), ("Time per week", hours_per_week(description))]
    return F.filter(
        F.array(*[F.struct(F.lit(k).alias("label"), nonblank(v).alias("value")) for k, v in rows]),
        lambda f: f["value"].isNotNull())


_FIELD_DDL = "array<struct<label:string,value:string>>"
_SECTION_DDL = f"array<struct<title:string,fields:{_FIELD_DDL},items:array<string>>>"


def _section(title, fields, items):
    return F.struct(F.lit(title).alias("title"), fields.cast(_FIELD_DDL).alias("fields"),
                    items.cast("array<string>").alias("items"))


def _keep_filled(sections):
    return F.filter(sections, lambda s: (F.size(s["fields"]) > 0) | (F.size(s["items"]) > 0))


def _rows(sections):
    return F.aggregate(sections, F.lit(0), lambda n, s: n + F.size(s["fields"]) + F.size(s["items"]))


def detail_view(title, job_type, location, salary_text, description, budget=vocab.DETAIL_ROW_BUDGET):
    """struct(full, preview, has_more): all sections, and a preview within the row budget."""
    none = F.array().cast(_FIELD_DDL)
    t1, t2, t3 = vocab.DETAIL_TITLES

    def build(v):
        fields, lists = v["fields"], [v["about"], v["resp"], v["req"]]
        full = _keep_filled(F.array(_section(t1, fields, lists[0]), _section(t2, none, lists[1]),
                                    _section(t3, none, lists[2])))
        left = F.greatest(F.lit(budget) - F.size(fields), F.lit(0))
        shown = []
        for items in lists:
            take = F.least(F.size(items), left)
            shown.append(F.slice(items, F.lit(1), take))
            left = left - take
        preview = _keep_filled(F.array(
            _section(t1, F.slice(fields, 1, budget), shown[0]),
            _section(t2, none, shown[1]), _section(t3, none, shown[2])))
        empty = F.array(_section(t1, fields, F.array(F.lit(vocab.DETAIL_EMPTY_TEXT))))
        return let(F.struct(full.alias("f"), preview.alias("p")), lambda s: F.struct(
            F.when(F.size(s["f"]) > 0, s["f"]).otherwise(empty).cast(_SECTION_DDL).alias("full"),
            F.when(F.size(s["p"]) > 0, s["p"]).otherwise(empty).cast(_SECTION_DDL).alias("preview"),
            (_rows(s["f"]) > _rows(s["p"])).alias("has_more")))

    parts = detail_parts(description)
    return let(parts, lambda p: let(F.struct(
        about_fields(title, job_type, location, salary_text, description).alias("fields"),
        split_points(p["about"]).alias("about"),
        split_points(p["responsibilities"]).alias("resp"),
        split_points(p["requirements"]).alias("req")), build))
