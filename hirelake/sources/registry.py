"""Adapters by source; landing rows of several sources to one raw table."""

from functools import reduce

from pyspark.sql import functions as F

from .. import vocab
from . import boards, feeds, jsonld

_c = F.col
# Adapters of landed texts ``(source, seq, origin, body)``.
ADAPTERS = {
    "remoteok": feeds.adapt_remoteok,
    "weworkremotely": lambda landed: feeds.adapt_weworkremotely(feeds.rss_items(landed)),
    "greenhouse": feeds.adapt_greenhouse,
    "lever": feeds.adapt_lever,
    "ashby": feeds.adapt_ashby,
    "careerspage": lambda landed: jsonld.adapt_careerspage(
        landed.select("seq", _c("origin").alias("url"), _c("body").alias("html"))),
}
# What is wrong with landed texts, and how messages call the source.
_CHECKS = {
    "remoteok": (feeds.feed_errors, "RemoteOK feed"), "greenhouse": (feeds.feed_errors, "Greenhouse board"),
    "lever": (feeds.feed_errors, "Lever company"), "ashby": (feeds.feed_errors, "Ashby board"),
    "weworkremotely": (feeds.rss_errors, "WeWorkRemotely feed"), "careerspage": (feeds.page_errors, "CareersPage page"),
}


def register(source, adapter):
    """Add or replace the adapter of a source."""
    ADAPTERS[source] = adapter


def collect_raw(landed, as_of, sources=None, detail_pages=None):
    """(raw rows, errors) of the chosen sources, all of them by default.

    ``landed``: source, seq, origin, body.  Boards read their result pages from ``landed`` and
    their detail pages from ``detail_pages`` (url, html); a source that yields nothing is no error.
    Landed texts of a source without adapter are reported, one message per source.
    """
    known = [*vocab.SOURCES, *(s for s in ADAPTERS if s not in vocab.SOURCES)]
    wanted = [s for s in known if not sources or s in sources]
    other = landed.filter(~F.coalesce(_c("source").isin(*known), F.lit(False)))
    if sources:
        other = other.filter(_c("source").isin(*sources))
    rows = []
    errors = [other.groupBy("source").agg(F.concat(
        F.lit("no adapter for this source: "), F.count(F.lit(1)).cast("string"), F.lit(" texts")).alias("message"))]
    for source in wanted:
        part = landed.filter(_c("source") == source).drop("source")
        if source in boards.BOARDS and source not in ADAPTERS:
            board = boards.BOARDS[source]
            pages = part.select("seq", _c("origin").alias("url"), _c("body").alias("html"))
            details = detail_pages if detail_pages is not None else pages.select("url", "html")
            raw = boards.adapt_board(pages, details, board, as_of)
            errors.append(feeds.page_errors(part, source, f"{source} page"))
            if "degraded" in raw.columns:
                errors.append(raw.filter(_c("degraded").isNotNull()).select(
                    F.lit(source).alias("source"), _c("degraded").alias("message")))
                raw = raw.drop("degraded")
        else:
            raw = ADAPTERS[source](part)
            if source in _CHECKS:
                check, label = _CHECKS[source]
                errors.append(check(part, source, label))
        rows.append(raw)
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    return union(rows), union(errors)
