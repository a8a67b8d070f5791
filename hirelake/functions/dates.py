"""Date scalars.  Nothing reads the clock: the caller passes ``as_of``."""

from pyspark.sql import functions as F

from .text import clean_html, let, literal_map, nonblank, normalize_ws

_MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
)
# Zone names of the mail date format, in hours.
_ZONES = {
    "ut": 0, "utc": 0, "gmt": 0, "z": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5,
    "mst": -7, "mdt": -6, "pst": -8, "pdt": -7,
}
_RELATIVE = r"(\d+)\s+(day|days|week|weeks|month|months)\s+ago"
_DAY_NAMED = r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$"
_MONTH_NAMED = r"^([A-Za-z]+)\s+(\d{1,2}),\s+(\d{4})$"
_MONTH_NAMED_TIME = (
    r"^([A-Za-z]{3})\s+(\d{1,2}),\s+(\d{4})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})\s+(Z|[+-]\d\d:?\d\d)$"
)
_LOOSE_DAY = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:\s(\d{1,2}):(\d{1,2}):(\d{1,2}))?$"
_ISO = (
    r"^(\d{4})-?(\d\d)-?(\d\d)(?:.(\d\d)(?::?(\d\d)(?::?(\d\d)(?:[.,](\d{1,6})\d*)?)?)?"
    r"(Z|[+-]\d\d(?::?\d\d)?(?::?\d\d)?)?)?$"
)
_MAIL = (
    r"(?i)^(?:[a-z]{3,9}\s*,?\s+)?(\d{1,2})\s+([a-z]{3,9})\s+(\d{4})\s+(\d{1,2}):(\d\d)(?::(\d\d))?"
    r"(?:\s+([+-]\d{4}|[a-z]{1,4}))?$"
)


def _num(c):
    return nonblank(c).try_cast("int")


def _month(name, full=True, short=True):
    names = {}
    for i, m in enumerate(_MONTHS, start=1):
        names.update({m: i} if full else {})
        names.update({m[:3]: i} if short else {})
    return F.try_element_at(literal_map(names, "int"), F.lower(name))


def _stamp(y, m, d, h=None, mi=None, s=None, micros=None):
    zero = F.lit(0)
    base = F.try_make_timestamp(
        y, m, d, F.coalesce(h, zero) if h is not None else zero,
        F.coalesce(mi, zero) if mi is not None else zero,
        (F.coalesce(s, zero) if s is not None else zero).cast("decimal(16,6)"), F.lit("UTC"))
    if micros is None:
        return base
    return F.timestamp_micros(F.unix_micros(base) + micros)


def _offset_seconds(zone):
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    part = lambda i: F.coalesce(_num(F.substring(digits, i, 2)), F.lit(0))
    named = F.try_element_at(literal_map({n: h * 3600 for n, h in _ZONES.items()}, "int"), F.lower(zone))
    return F.coalesce(named, sign * (part(1) * 3600 + part(3) * 60 + part(5)), F.lit(0))


def _shift(ts, seconds):
    return F.timestamp_micros(F.unix_micros(ts) - seconds.cast("bigint") * 1_000_000)


def _groups(text, pattern, *idx):
    return [F.regexp_extract(text, pattern, i) for i in idx]


def _relative(lowered, as_of):
    amount, unit = _groups(lowered, _RELATIVE, 1, 2)
    days = nonblank(amount).try_cast("bigint") * (
        F.when(F.contains(unit, F.lit("month")), 30).when(F.contains(unit, F.lit("week")), 7).otherwise(1))
    back = F.timestamp_micros(F.unix_micros(as_of) - days * 86_400_000_000)
    return (
        F.when(lowered == "today", as_of)
        .when(lowered == "yesterday", as_of - F.expr("interval 1 day"))
        .when((amount != "") & (days <= 700_000), back)
    )


def _named_dates(text):
    d, m, y = _groups(text, _DAY_NAMED, 1, 2, 3)
    m2, d2, y2 = _groups(text, _MONTH_NAMED, 1, 2, 3)
    return F.coalesce(
        F.when(text.rlike(_DAY_NAMED), _stamp(_num(y), _month(m), _num(d))),
        F.when(text.rlike(_MONTH_NAMED), _stamp(_num(y2), _month(m2), _num(d2))),
    )


def _absolute(text):
    y, mo, d, h, mi, s = map(_num, _groups(text, _LOOSE_DAY, 1, 2, 3, 4, 5, 6))
    iy, imo, idd, ih, imi, isec = map(_num, _groups(text, _ISO, 1, 2, 3, 4, 5, 6))
    frac, zone = _groups(text, _ISO, 7, 8)
    nm, nd, ny, nh, nmi, ns, nz = _groups(text, _MONTH_NAMED_TIME, 1, 2, 3, 4, 5, 6, 7)
    md, mm, my, mh, mmi, ms, mz = _groups(text, _MAIL, 1, 2, 3, 4, 5, 6, 7)
    return F.coalesce(
        F.when(text.rlike(_LOOSE_DAY), _stamp(y, mo, d, h, mi, s)),
        _named_dates(text),
        F.when(text.rlike(_MONTH_NAMED_TIME), _shift(
            _stamp(_num(ny), _month(nm, full=False), _num(nd), _num(nh), _num(nmi), _num(ns)),
            _offset_seconds(nz))),
        F.when(text.rlike(_ISO), _shift(
            _stamp(iy, imo, idd, ih, imi, isec,
                   F.coalesce(_num(F.rpad(nonblank(frac), 6, "0")), F.lit(0)).cast("bigint")),
            _offset_seconds(zone))),
        F.when(text.rlike(_MAIL), _shift(
            _stamp(_num(my), _month(F.substring(mm, 1, 3), full=False), _num(md), _num(mh), _num(mmi), _num(ms)),
            _offset_seconds(mz))),
    )


def parse_datetime(text, as_of, epoch=None, ts=None):
    """Moment described by a timestamp, an epoch number or a text; NULL parts fall through to
    ``as_of``.

    Texts: today, yesterday, "N days/weeks/months ago", ``YYYY-M-D [H:M:S]``, ISO-8601 with or
    without offset, day-month-year and month-day-year with month names, mail dates.
    """
    parsed = let(clean_html(text), lambda t: F.when(
        t != "", F.coalesce(let(F.lower(t), lambda lo: _relative(lo, as_of)), _absolute(t))))
    numeric = None if epoch is None else F.timestamp_micros(
        (F.when(epoch > 1e12, epoch / 1000).otherwise(epoch) * 1_000_000).cast("bigint"))
    return F.coalesce(*[c for c in (ts, numeric, parsed) if c is not None], as_of)


def parse_relative_date(line, as_of):
    """Listing date: relative words or a day with a month name, else NULL."""
    return let(normalize_ws(line), lambda t: F.coalesce(
        let(F.lower(t), lambda lo: _relative(lo, as_of)), _named_dates(t)))
