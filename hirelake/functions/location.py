"""Location parsing."""

from pyspark.sql import functions as F

from .. import vocab
from .classify import workplace_in, workplace_type
from .text import clean_html, let, literal_map, nonblank, normalize_ws, py_title

_CITY_RE = r"(?iU)\b(" + "|".join(vocab.CITY_IN_TEXT) + r")\b"


def _lookup(table, key):
    return F.try_element_at(literal_map(table), key)


def parse_location(value, title=None, description=None, low=None):
    """struct(location, city, region, country, workplace_type).

    The last city or country token decides, the first other short token is the region; without a
    city token the text is searched for a known city.  ``low`` is the prepared text of title and
    description, for callers that have it.
    """
    def kind_of(raw):
        if low is None:
            return workplace_type(raw, title, description)
        return let(F.concat_ws(" ", nonblank(F.lower(raw)), low), lambda text: workplace_in(text, raw))

    def build(v):
        swapped = F.replace(F.replace(F.replace(
            v["raw"], F.lit("•"), F.lit(", ")), F.lit("/"), F.lit(", ")), F.lit("  "), F.lit(" "))
        return let(F.regexp_replace(swapped, "^[ ,]+|[ ,]+$", ""), lambda s: _place(v["raw"], v["kind"], s))

    return let(clean_html(value), lambda r: let(
        F.struct(r.alias("raw"), kind_of(r).alias("kind")), build))


def _place(raw, kind, text):
    tokens = F.filter(F.transform(F.split(text, r",|\|"), normalize_ws), lambda t: t != "")

    cities = list(vocab.CITY_COUNTRY)
    known = [*cities, *vocab.COUNTRY_TOKENS]

    def choose(ts):
        pick = lambda test, at: F.try_element_at(F.filter(ts, test), F.lit(at))
        city_tok = pick(lambda t: F.lower(t).isin(*cities), -1)
        return F.struct(
            city_tok.alias("city"),
            pick(lambda t: F.lower(t).isin(*known), -1).alias("place"),
            py_title(pick(lambda t: ~F.lower(t).isin(*known) & (F.length(t) <= 32), 1)).alias("region"),
            F.when(~F.exists(ts, lambda t: F.lower(t).isin(*cities)),
                   nonblank(F.regexp_extract(text, _CITY_RE, 1))).alias("found"))

    def name(v):
        found = F.lower(v["found"])
        return F.struct(
            F.coalesce(py_title(v["city"]), _lookup(vocab.CITY_SHORT_FORMS, found), py_title(v["found"])).alias("city"),
            F.coalesce(_lookup(vocab.CITY_COUNTRY, F.lower(v["place"])), py_title(v["place"]),
                       _lookup(vocab.CITY_COUNTRY, found)).alias("country"),
            v["region"].alias("region"))

    def finish(v):
        shown = F.coalesce(nonblank(text),
                           F.when(kind == "remote", F.lit("Remote")).otherwise("Unspecified"))
        shown = F.when((kind == "hybrid") & ~F.contains(F.lower(shown), F.lit("hybrid")),
                       F.concat(shown, F.lit(" (Hybrid)"))).otherwise(shown)
        only_remote = (kind == "remote") & F.lower(raw).isin(*vocab.REMOTE_ONLY_PLACES)
        return F.struct(
            F.when(only_remote, F.lit("Remote")).otherwise(shown).alias("location"),
            F.when(~only_remote, v["city"]).alias("city"),
            F.when(~only_remote & ~v["region"].eqNullSafe(v["city"]), v["region"]).alias("region"),
            F.when(~only_remote, v["country"]).alias("country"),
            kind.alias("workplace_type"))

    return let(let(let(tokens, choose), name), finish)
