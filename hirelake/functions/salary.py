"""Salary parsing and salary texts."""

from pyspark.sql import functions as F

from .. import vocab
from .text import clean_html, join_nonblank, let, literal_map, nonblank, text_or_empty

_CURRENCY = r"(?i)(KSh|KES|\$|USD|EUR|€|GBP|£)"
_INTERVAL = r"(?iU)\b(hour|day|week|month|year|annum)\b"
_AMOUNT = r"(\d[\d,]*(?:\.\d+)?)"
_RANGE = _AMOUNT + r"\s*([Kk])?\s*(?:-|to|–)\s*" + _AMOUNT + r"\s*([Kk])?"
_SINGLE = _AMOUNT + r"\s*([Kk])?"


def _amount(digits, suffix):
    n = nonblank(F.replace(digits, F.lit(","), F.lit(""))).try_cast("double")
    return F.when(suffix != "", n * 1000).otherwise(n)


def parse_salary(value, title=None, description=None, number=None, search=None):
    """struct(text, min, max, currency, interval) from the salary text, the title and the first
    300 characters of the description.  A numeric salary is taken as the minimum."""
    def find(t):
        """Each pattern runs over the text once; groups are cut from the short match."""
        usable = (t != "") & ~F.contains(F.lower(t), F.lit("confidential"))
        whole = lambda p: F.when(usable, nonblank(F.regexp_extract(t, p, 0)))
        return F.struct(
            F.lower(whole(_CURRENCY)).alias("currency"), F.lower(whole(_INTERVAL)).alias("interval"),
            whole(_RANGE).alias("range"), whole(_SINGLE).alias("single"))

    def read(m):
        code = F.try_element_at(literal_map(vocab.CURRENCY_CODES), m["currency"])
        g = lambda c, p, i: F.regexp_extract(c, p, i)
        is_range = m["range"].isNotNull()
        single = F.when(m["currency"].isNotNull(), m["single"])
        one = _amount(g(single, _SINGLE, 1), g(single, _SINGLE, 2))
        low, high = (_amount(g(m["range"], _RANGE, i), g(m["range"], _RANGE, i + 1)) for i in (1, 3))
        return F.struct(
            F.trim(F.coalesce(m["range"], single)).alias("text"),
            F.when(is_range, low).otherwise(one).alias("min"),
            F.when(is_range, high).otherwise(one).alias("max"),
            code.alias("currency"), m["interval"].alias("interval"))

    parts = [value]
    if title is not None:
        parts.append(title)
    if description is not None:
        parts.append(description if search is None else F.substring(description, 1, search))
    parsed = let(let(let(join_nonblank(" ", *parts), lambda t: clean_html(t)), find), read)
    if number is None:
        return parsed
    none = F.lit(None)
    direct = F.struct(number.cast("string").alias("text"), number.cast("double").alias("min"),
                      none.cast("double").alias("max"), none.cast("string").alias("currency"),
                      none.cast("string").alias("interval"))
    return F.when(number.isNotNull(), direct).otherwise(parsed)


def salary_text(currency, low, high, unit=None):
    """``CUR low - high`` or ``CUR low``; NULL when the lower bound is absent or zero.

    ``low`` and ``high`` are texts, as the feed wrote them.
    """
    def given(c):
        return (text_or_empty(c) != "") & ~F.coalesce(c.try_cast("double") == 0, F.lit(False))

    tail = F.lit("") if unit is None else F.concat(F.lit(" "), text_or_empty(unit))
    head = F.concat(text_or_empty(currency), F.lit(" "), low)
    both = F.concat(head, F.lit(" - "), high)
    out = F.when(given(low) & given(high), F.concat(both, tail)).when(given(low), F.concat(head, tail))
    return out if unit is None else F.trim(out)
