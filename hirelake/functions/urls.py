"""URL scalars built on the generic URI split of RFC 3986."""

from pyspark.sql import functions as F

from .. import vocab
from .text import clean_html, let, nonblank, py_title, text_or_empty

_SPLIT = (
    r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)


# What ``canonical_url`` leaves as it is: lower-case scheme and host, a path without a slash at its end, nothing after it.
_CANONICAL = r"^[a-z][a-z0-9+.\-]*+://[a-z0-9._:\-]++/[!-~&&[^?#;]]*+(?<!/)\z"


def split_url(c):
    """struct(scheme, netloc, path, params, query, fragment); parts that are absent are ''."""
    def part(n):
        return F.regexp_extract(c, _SPLIT, n)

    path = part(3)
    return F.struct(
        F.lower(part(1)).alias("scheme"),
        part(2).alias("netloc"),
        F.regexp_replace(path, r";[^/]*$", "").alias("path"),
        F.regexp_extract(path, r";([^/]*)$", 1).alias("params"),
        part(4).alias("query"),
        part(5).alias("fragment"),
    )


def _decode(c):
    plain = F.replace(c, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(c), plain)


def _encode(c):
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(query):
    """Decoded (k, v) pairs in order; pairs with an empty value are dropped."""
    raw = F.filter(F.split(query, "&"), lambda p: p.rlike("=.") )
    return F.transform(raw, lambda p: F.struct(
        _decode(F.substring_index(p, "=", 1)).alias("k"),
        _decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"),
    ))


def _encode_pairs(pairs):
    """Form-encode, values of one key side by side at the key's first position."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    grouped = F.flatten(F.transform(keys, lambda k: F.filter(pairs, lambda p: p["k"] == k)))
    return F.array_join(
        F.transform(grouped, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def _join_url(scheme, netloc, path, query, params=None, fragment=None):
    tail = F.lit("") if params is None else F.when(
        params != "", F.concat(F.lit(";"), params)).otherwise("")
    end = F.lit("") if fragment is None else F.when(
        fragment != "", F.concat(F.lit("#"), fragment)).otherwise("")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""),
        path, tail,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        end,
    )


def canonical_url(c):
    """Scheme and host lower-cased, trailing slash, parameters, fragment and tracking removed."""
    def build(u):
        bare = F.regexp_replace(u["path"], "/+$", "")
        kept = F.when(u["query"] != "", _encode_pairs(F.filter(
            query_pairs(u["query"]), lambda p: F.lower(p["k"]).isin(*vocab.ID_QUERY_KEYS))))
        return _join_url(u["scheme"], F.lower(u["netloc"]),
                         F.when(bare == "", u["path"]).otherwise(bare), text_or_empty(kept))

    # One plain match is far cheaper than taking an address apart; most stored ones are canonical.
    return F.when(text_or_empty(c) == "", F.lit("")).when(c.rlike(_CANONICAL), c).otherwise(
        let(split_url(F.trim(c)), build))


def source_job_id(c):
    """Identifier found in the query, else the trailing run of the last path segment."""
    def find(u):
        pairs = F.when(u["query"] != "", query_pairs(u["query"]))

        def value_of(name):
            return F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(1))["v"]

        by_key = [value_of(k) for k in vocab.ID_QUERY_KEYS]
        last = F.try_element_at(F.filter(F.split(u["path"], "/"), lambda s: s != ""), F.lit(-1))
        run = nonblank(F.regexp_extract(F.lower(last), "([a-z0-9]{6,})$", 1))
        return F.coalesce(*[F.trim(k) for k in by_key], run, last)

    return let(split_url(text_or_empty(c)), find)


def host_name(c):
    """Lower-cased host without user info and port; NULL when there is none."""
    netloc = F.regexp_extract(text_or_empty(c), _SPLIT, 2)
    return nonblank(F.lower(F.regexp_extract(netloc, r"^(?:.*@)?([^:@]*)", 1)))


def net_location(c):
    return F.regexp_extract(text_or_empty(c), _SPLIT, 2)


def _first_label(host):
    return F.substring_index(F.replace(host, F.lit("www."), F.lit("")), ".", 1)


def company_name(c, fallback_url):
    """Cleaned employer name; a placeholder is replaced by the first label of the host."""
    def choose(name):
        host = host_name(fallback_url)
        label = py_title(F.replace(_first_label(host), F.lit("-"), F.lit(" ")))
        return (
            F.when((name != "") & ~F.lower(name).isin("unknown company", "company"), name)
            .when(host.isNotNull(), label)
            .otherwise("Unknown company")
        )

    return let(clean_html(c), choose)


def domain_company(c):
    label = _first_label(F.coalesce(host_name(c), F.lit("Unknown company")))
    return py_title(F.translate(label, "-_", "  "))


def slug_company(c):
    """Board slug shown as an employer name."""
    return py_title(F.replace(c, F.lit("-"), F.lit(" ")))


def _resolve_dots(base_path, path):
    base = F.split(base_path, "/")
    folder = F.when(F.element_at(base, -1) != "", F.slice(base, F.lit(1), F.size(base) - 1)).otherwise(base)
    whole = F.when(path.startswith("/"), F.split(path, "/")).otherwise(F.concat(folder, F.split(path, "/")))

    def tidy(s):
        n = F.size(s)
        inner = F.filter(F.slice(s, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda x: x != "")
        dense = F.when(n > 1, F.concat(F.slice(s, 1, 1), inner, F.slice(s, n, 1))).otherwise(s)
        out = F.aggregate(
            dense, F.array().cast("array<string>"),
            lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(x == ".", acc).otherwise(F.array_append(acc, x)))
        closed = F.when(F.element_at(dense, -1).isin(".", ".."),
                        F.array_append(out, F.lit(""))).otherwise(out)
        joined = F.array_join(closed, "/")
        return F.when(joined == "", F.lit("/")).otherwise(joined)

    return let(whole, tidy)


def absolute_href(base, href):
    """Resolve ``href`` against the page it stands on; nothing to resolve gives the page itself."""
    def resolve(pair):
        b, h = pair["b"], pair["h"]
        path = F.concat(h["path"], F.when(h["params"] != "", F.concat(F.lit(";"), h["params"])).otherwise(""))
        base_path = F.concat(b["path"], F.when(b["params"] != "", F.concat(F.lit(";"), b["params"])).otherwise(""))
        same = _join_url(b["scheme"], b["netloc"], base_path,
                         F.when(h["query"] != "", h["query"]).otherwise(b["query"]), None, h["fragment"])
        return (
            F.when((h["scheme"] != "") & (h["scheme"] != b["scheme"]), href)
            .when(h["netloc"] != "", _join_url(b["scheme"], h["netloc"], path, h["query"], None, h["fragment"]))
            .when(path == "", same)
            .otherwise(_join_url(b["scheme"], b["netloc"], _resolve_dots(b["path"], path),
                                 h["query"], None, h["fragment"]))
        )

    return F.when(text_or_empty(href) == "", base).otherwise(
        let(F.struct(split_url(base).alias("b"), split_url(href).alias("h")), resolve))


def paged_url(c, number, param="page"):
    """Same URL with one query parameter set to the page number."""
    def build(u):
        pairs = F.coalesce(
            F.when(u["query"] != "", query_pairs(u["query"])),
            F.array().cast("array<struct<k:string,v:string>>"))
        page = F.struct(F.lit(param).alias("k"), number.cast("string").alias("v"))
        first = F.array_position(F.transform(pairs, lambda p: p["k"]), F.lit(param))
        kept = F.filter(pairs, lambda p, i: (p["k"] != param) | (i == first - 1))
        placed = F.transform(kept, lambda p: F.when(p["k"] == param, page).otherwise(p))
        final = F.when(first > 0, placed).otherwise(F.array_append(pairs, page))
        return _join_url(u["scheme"], u["netloc"], u["path"], _encode_pairs(final),
                         u["params"], u["fragment"])

    return let(split_url(c), build)
