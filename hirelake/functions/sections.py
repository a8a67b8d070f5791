"""Description sections: lines grouped under the last heading above them."""

from pyspark.sql import functions as F

from .. import vocab
from ..schema import SECTIONS_DDL
from .text import LINE_BREAK, clean_html, html_text, is_title_case, let, literal_map, normalize_ws, text_or_empty, unescape_html

_BULLET = r"^[•*\-\d.)(]+(?U:\s)*"


def heading_of(line):
    """Section label a line opens; NULL for ordinary lines."""
    known = literal_map(vocab.HEADINGS)

    def label(text):
        short = (text != "") & ~F.lower(text).isin("remote", "onsite") & is_title_case(text)
        return F.coalesce(F.try_element_at(known, F.lower(text)), F.when(short, text))

    cleaned = normalize_ws(F.regexp_replace(line, r"^[: ]+|[: ]+$", ""))
    return let(cleaned, lambda t: F.when(F.length(t) <= 48, label(t)))


def _first(values, most):
    return values if most is None else F.slice(values, 1, most)


def _items(lines, heading, most):
    cleaned = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, _BULLET, "")))
    # Headings have at most 48 characters, so long lines need no comparison.
    repeats = lambda x: (F.length(x) <= 48) & F.lower(x).isin(F.lower(heading), F.lit("description"))
    return _first(F.filter(cleaned, lambda x: (x != "") & ~repeats(x)), most)


def _group(marked, most):
    """Cut the marked lines at their headings; row-local and linear in the number of lines."""
    n = F.size(marked)
    heads = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(marked, i)["heading"].isNotNull())
    starts = F.concat(F.array(F.lit(0)), heads)
    ends = F.concat(heads, F.array(n + 1))

    def section(span):
        first, nxt = span["s"], span["e"]
        head = F.when(first == 0, F.lit("Overview")).otherwise(
            F.element_at(marked, F.greatest(first, F.lit(1)))["heading"])
        body = F.slice(marked, first + 1, nxt - first - 1)
        return let(head, lambda h: F.struct(
            h.alias("heading"), _items(F.transform(body, lambda m: m["line"]), h, most).alias("items")))

    spans = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    return F.filter(F.transform(spans, section), lambda x: F.size(x["items"]) > 0)


def structure_description(value, items=None, sentences=None):
    """Sections ``(heading, items)`` of a description; without any, its sentences.

    ``items`` and ``sentences`` limit how many are kept; without them all are.
    """
    return let(text_or_empty(value), lambda v: _structure(v, items, sentences))


def _structure(value, most_items, most_sentences):
    text = F.when(F.contains(value, F.lit("<")), html_text(unescape_html(value))).otherwise(value)
    lines = F.filter(F.transform(F.split(text, LINE_BREAK), normalize_ws), lambda x: x != "")
    marked = F.transform(lines, lambda x: F.struct(x.alias("line"), heading_of(x).alias("heading")))
    sentences = F.filter(F.transform(
        F.split(clean_html(value), r"(?<=\.)(?U:\s)+"), F.trim), lambda x: x != "")
    fallback = F.array(F.struct(F.lit("Overview").alias("heading"),
                                _first(sentences, most_sentences).alias("items")))

    def build(m):
        return F.when(F.size(m) == 0, F.array().cast(SECTIONS_DDL)).otherwise(
            let(_group(m, most_items), lambda s: F.when(F.size(s) > 0, s).otherwise(fallback)))

    return let(marked, build).cast(SECTIONS_DDL)


def render_sections(c):
    """One text per section list, for comparison and display."""
    return F.array_join(F.transform(c, lambda s: F.concat(
        s["heading"], F.lit("="), F.array_join(s["items"], "|"))), "#")
