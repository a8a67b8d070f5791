"""Data side of following result pages: links of a page, next page, pages still to visit."""

from pyspark.sql import functions as F

from .. import vocab
from ..functions import text, urls
from ..sources import dom

_c = F.col
_NEXT_SELECTORS = (
    "a[rel='next']", "a[aria-label*='Next']", "a[title*='Next']", ".pagination a",
    "nav[aria-label*='Pagination'] a",
)
# Possessive: a long tag neither recurses nor backtracks.
_ANCHOR = r"(?is)<a\b((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>(.*?)</a\s*+>"
_HREF = r"""(?is)(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def page_links(pages, patterns=None):
    """(page key, href, link) of every distinct link of a page, stop texts left out.

    Anchors are read with expressions only; comments and scripts do not count.
    """
    body = F.regexp_replace("html", r"(?s:<!--.*?-->)|(?is:<(script|style|template)\b[^>]*+>.*?</\1\s*+>)", " ")
    attrs = F.regexp_extract_all(body, F.lit(_ANCHOR), F.lit(1))
    texts = F.regexp_extract_all(body, F.lit(_ANCHOR), F.lit(2))
    anchors = F.zip_with(attrs, texts, lambda a, t: F.struct(
        F.concat(*[F.regexp_extract(a, _HREF, i) for i in (1, 2, 3)]).alias("href"),
        a.rlike(_HREF).alias("has_href"), text.normalize_ws(text.html_text(t, " ")).alias("text")))
    rows = pages.select("page_id", "url", F.posexplode(anchors).alias("pos", "a"))
    keep = _c("a.has_href") & ~F.lower("a.text").isin(*vocab.BLOCKED_LINK_TEXTS)
    if patterns:
        keep = keep & text.contains_any(_c("a.href"), patterns)
    kept = rows.filter(keep).select("page_id", "url", "pos", text.unescape_html(_c("a.href")).alias("href"), "a.text")
    firsts = kept.groupBy("page_id", "href").agg(
        F.min_by(F.struct("url", "text"), "pos").alias("v"), F.min("pos").alias("pos"))
    return firsts.select("page_id", "pos", "href", _c("v.text").alias("text"),
                         urls.absolute_href(_c("v.url"), _c("href")).alias("link"))


def next_pages(pages):
    """Pages with their ``next_url``: the first link, by selector order, that says next or older."""
    wanted = F.coalesce(F.lower("html").rlike("next|older"), F.lit(False))
    with_word = dom.with_nodes(pages.filter(wanted))

    def says_next(node):
        words = F.lower(text.normalize_ws(dom.node_text(node)))
        return text.contains_any(words, vocab.NEXT_PAGE_WORDS) & (text.text_or_empty(dom.attr(node, "href")) != "")

    hits = [F.try_element_at(F.filter(dom.select(s), says_next), F.lit(1)) for s in _NEXT_SELECTORS]
    href = dom.attr(F.coalesce(*hits), "href")
    found = with_word.select(*pages.columns, F.when(
        href.isNotNull(), urls.absolute_href(_c("url"), href)).alias("next_url"))
    rest = pages.filter(~wanted).withColumn("next_url", F.lit(None).cast("string"))
    return found.unionByName(rest)


def crawl_frontier(pages, visited, page_param=None, max_pages=None):
    """Result pages to fetch next: (start_url, url, page_number).

    ``pages`` are the pages just read (start_url, url, page_number, html); without a next link the
    numbered form of the start address is tried.  Addresses already visited from the same start
    and, where ``max_pages`` is given, pages beyond it are left out.
    """
    following = next_pages(pages if max_pages is None else pages.filter(_c("page_number") < max_pages))
    target = _c("next_url")
    if page_param:
        target = F.coalesce(target, urls.paged_url(_c("start_url"), _c("page_number") + 1, page_param))
    ahead = following.select("start_url", target.alias("url"), (_c("page_number") + 1).alias("page_number"))
    ahead = ahead.filter(_c("url").isNotNull()).groupBy("start_url", "url").agg(F.min("page_number").alias("page_number"))
    return ahead.join(visited.select("start_url", "url"), ["start_url", "url"], "left_anti")
