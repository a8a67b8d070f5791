"""Text scalars: whitespace, markup, entities, casing, line slicing."""

import html.entities as _entities
import json

from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators.
WS = r"(?U)[\s\x1c-\x1f]+"
EDGE_WS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

_TAG = r"""</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[!?][^>]*+>"""
_COMMENT = r"(?s:<!--.*?-->)"
# Elements whose content is not text: for prose, and for plain text nodes.
_PROSE_DROP = rf"{_COMMENT}|(?is:<(script|style|svg|noscript)\b[^>]*+>.*?</\1\s*+>)|{_TAG}"
_NODE_DROP = rf"{_COMMENT}|(?is:<(script|style|template)\b[^>]*+>.*?</\1\s*+>)|{_TAG}"

_ENTITY_PIECE = r"[^&]+|&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)?"
_BARE_NAMES = sorted(
    (n for n in _entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n)
)
_ENTITY_JSON = json.dumps({
    n: _entities.html5[n + ";"]
    for n in sorted({*_entities.name2codepoint, *_BARE_NAMES, "apos"})
})
# Code points 0x80-0x9f are read as Windows-1252, as browsers do.
_C1_CHARS = "".join(bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0))


def let(value, body):
    """Evaluate ``value`` once and hand it to ``body`` as a column."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(c):
    return F.coalesce(c, F.lit(""))


def nonblank(c):
    """NULL instead of an empty string."""
    return F.nullif(c, F.lit(""))


def is_blank(c):
    """Missing for merging purposes: NULL, empty or the literal label ``unknown``."""
    return c.isNull() | c.isin("", "unknown")


def normalize_ws(c):
    return F.trim(F.regexp_replace(text_or_empty(c), WS, " "))


def strip_ws(c):
    return F.regexp_replace(c, EDGE_WS, "")


def join_nonblank(sep, *cols):
    return F.concat_ws(sep, *[nonblank(c) for c in cols])


def literal_map(table, value_type="string"):
    """A fixed lookup table as one foldable expression."""
    return F.from_json(F.lit(json.dumps(table)), f"map<string,{value_type}>")


def _sql_text(value):
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Written as SQL text because the same lambda stands in many expressions: one parser call instead
# of some hundred calls to build it.  ``p`` is a piece of text or one character reference.
_RESOLVE_ENTITY = f"""p -> CASE
  WHEN NOT startswith(p, '&') OR p = '&' THEN p
  WHEN p RLIKE '^&#([0-9]|[xX][0-9a-fA-F])' THEN element_at(transform(array(CASE
      WHEN p RLIKE '^&#[0-9]' THEN coalesce(try_cast(regexp_extract(p, '^&#([0-9]+)', 1) AS BIGINT), 1114112L)
      WHEN length(p) > 14 THEN 1114112L
      ELSE CAST(conv(regexp_extract(p, '^&#[xX]([0-9a-fA-F]+)', 1), 16, 10) AS BIGINT) END),
    k -> CASE WHEN k BETWEEN 128 AND 159 THEN substring({_sql_text(_C1_CHARS)}, CAST(k - 127 AS INT), 1)
      WHEN k BETWEEN 1 AND 55295 OR k BETWEEN 57344 AND 1114111 THEN decode(unhex(lpad(hex(k), 8, '0')), 'UTF-32')
      ELSE '\ufffd' END), 1)
  ELSE coalesce(
    try_element_at(from_json({_sql_text(_ENTITY_JSON)}, 'map<string,string>'), regexp_extract(p, '^&(.*);$', 1)),
    element_at(transform(array(regexp_extract(p, '^&({"|".join(_BARE_NAMES)})', 1)), b -> concat(
      try_element_at(from_json({_sql_text(_ENTITY_JSON)}, 'map<string,string>'), b), substring(p, length(b) + 2))), 1),
    p) END"""


def unescape_html(c):
    """Resolve character references; text without an ampersand passes untouched."""
    pieces = F.regexp_extract_all(c, F.lit(_ENTITY_PIECE), F.lit(0))
    resolved = F.call_function("transform", pieces, F.expr(_RESOLVE_ENTITY))
    return F.when(F.contains(c, F.lit("&")), F.array_join(resolved, "")).otherwise(c)


def _tidy(c):
    bullets = F.regexp_replace(F.replace(c, F.lit("â€¢"), F.lit("•")),
                               r"(?U)[\s\x1c-\x1f]*[•·][\s\x1c-\x1f]*", " • ")
    # Plain searches are far cheaper than the pattern; most texts have no bullet.
    return normalize_ws(F.when(contains_any(c, ("•", "·", "â€¢")), bullets).otherwise(c))


def clean_html(c):
    """Readable text of a fragment: entities resolved, markup dropped, one blank between nodes."""
    markup = let(unescape_html(c), lambda v: unescape_html(F.regexp_replace(v, _PROSE_DROP, " ")))
    marked = contains_any(c, ("<", "&"))
    return let(F.when(marked, markup).otherwise(text_or_empty(c)), _tidy)


def clean_again(c):
    """``clean_html`` of text that is clean already: only rows that still show markup pay for it."""
    return F.when(contains_any(c, ("<", "&")), clean_html(c)).otherwise(c)


def html_text(c, sep="\n"):
    """Text nodes of a page joined by ``sep``; scripts, styles and comments are not text."""
    body = F.regexp_replace(text_or_empty(c), _NODE_DROP, "\x00")
    nodes = F.transform(F.split(body, "\x00"), lambda n: strip_ws(unescape_html(n)))
    return F.array_join(F.filter(nodes, lambda n: n != ""), sep)


def text_lines(c):
    """Non-blank, edge-stripped lines."""
    return F.filter(F.transform(F.split(text_or_empty(c), LINE_BREAK), strip_ws), lambda n: n != "")


def normalize_tags(c):
    """Cleaned, lower-cased tags in first-seen order."""
    cleaned = F.transform(c, lambda t: F.lower(clean_html(t)))
    return F.array_distinct(F.filter(
        F.coalesce(cleaned, F.array().cast("array<string>")), lambda t: t != ""))


def distinct_lower(c):
    """Whitespace-normalised, lower-cased items in first-seen order."""
    # Lists joined from two columns often repeat; each text is tidied once.
    cleaned = F.transform(F.array_distinct(c), lambda t: F.lower(normalize_ws(t)))
    return F.array_distinct(F.filter(cleaned, lambda t: t != ""))


def py_title(c):
    """Capital at the start of every run of cased letters, the rest lower."""
    runs = F.regexp_extract_all(
        c, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(
        F.initcap(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def is_title_case(c):
    """True when ``py_title`` would change nothing; text without cased letters counts too."""
    return ~c.rlike(
        r"(?<![\p{Lu}\p{Ll}\p{Lt}])\p{Ll}|(?<=[\p{Lu}\p{Ll}\p{Lt}])[\p{Lu}\p{Lt}]")


def csv_quote(c):
    return F.concat(F.lit('"'), F.replace(text_or_empty(c), F.lit('"'), F.lit('""')), F.lit('"'))


def slice_between(lines, starts, ends):
    """Lines after the first exact start marker, up to a line that begins with an end marker."""
    def after(ls):
        start = F.array_min(F.filter(
            F.array(*[F.array_position(ls, F.lit(s)) for s in starts]), lambda p: p > 0))
        return F.when(start.isNotNull(),
                      F.slice(ls, start.cast("int") + 1, F.size(ls)))

    def before(ls):
        stops = F.transform(ls, lambda x: _starts_with_any(x, ends))
        stop = F.array_position(stops, F.lit(True))
        return F.when(stop > 0, F.slice(ls, F.lit(1), stop.cast("int") - 1)).otherwise(ls)

    return text_or_empty(F.array_join(let(let(lines, after), before), " "))


def _starts_with_any(c, prefixes):
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | c.startswith(p)
    return hit


def contains_any(c, words):
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(c, F.lit(w))
    return hit
