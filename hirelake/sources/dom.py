"""Page structure as columns.

``with_nodes`` adds the elements of each page in document order and its text nodes.  Only the
tokenising runs in Python, in Arrow batches; selecting, reading and joining are expressions.
"""

import re
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions.text import let, normalize_ws, text_lines, text_or_empty

_c = F.col
NODE_DDL = "array<struct<tag:string,attrs:map<string,string>,up:array<int>,t0:int,t1:int,h0:int,h1:int>>"
_NODE_PA = pa.list_(pa.struct([
    ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("up", pa.list_(pa.int32())),
    ("t0", pa.int32()), ("t1", pa.int32()), ("h0", pa.int32()), ("h1", pa.int32())]))
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style", "template"))
#: Pages that a task holds as parsed trees at a time: so many at most, and so many bytes of markup (one page at least).
PORTION_ROWS, PORTION_BYTES = 128, 1 << 20


class _Outline(HTMLParser):
    """Elements with their ancestors (1-based), text range and inner-markup range."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.nodes, self.texts, self.stack = [], [], []
        self.starts = [0] + [m.end() for m in re.finditer("\n", html)]
        self.feed(html)
        self.close()
        self._pop_to(0, len(html))

    def _at(self):
        line, col = self.getpos()
        return self.starts[line - 1] + col

    def _pop_to(self, depth, end):
        for i in self.stack[depth:]:
            self.nodes[i - 1].update(t1=len(self.texts), h1=end)
        del self.stack[depth:]

    def handle_starttag(self, tag, attrs):
        inner = self._at() + len(self.get_starttag_text() or "")
        merged = {}
        for k, v in attrs:
            merged.setdefault(k, v or "")
        self.nodes.append({"tag": tag, "attrs": list(merged.items()), "up": list(self.stack),
                           "t0": len(self.texts), "t1": len(self.texts), "h0": inner, "h1": inner})
        if tag not in _VOID:
            self.stack.append(len(self.nodes))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.nodes[self.stack[depth] - 1]["tag"] == tag:
                self._pop_to(depth, self._at())
                return

    def handle_data(self, data):
        silent = self.stack and self.nodes[self.stack[-1] - 1]["tag"] in _SILENT
        if not silent and data.strip():
            self.texts.append(data.strip())


def with_nodes(pages, html="html"):
    """Add ``nodes`` and ``texts`` to a table of pages."""
    from pyspark.sql import types as T

    names = pages.columns
    probe = pages.sparkSession.range(0).select(
        F.lit(None).cast(NODE_DDL).alias("nodes"), F.lit(None).cast("array<string>").alias("texts"))
    schema = T.StructType([*pages.schema.fields, *probe.schema.fields])

    def outline(batches):
        for batch in batches:
            for part in portions(batch, names.index(html)):
                trees = [_Outline(v or "") for v in part.column(names.index(html)).to_pylist()]
                nodes = pa.array([t.nodes for t in trees], _NODE_PA)
                texts = pa.array([t.texts for t in trees], pa.list_(pa.string()))
                del trees  # not held while the rows are sent
                yield pa.RecordBatch.from_arrays([*part.columns, nodes, texts], [*names, "nodes", "texts"])
                del nodes, texts

    return pages.mapInArrow(outline, schema)


def portions(batch, index, rows=None, size=None):
    """Slices of an Arrow batch by rows and by bytes of one text column, cut between rows only."""
    rows, size = rows or PORTION_ROWS, size or PORTION_BYTES
    at = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(index)), 0).to_pylist()):
        if i > at and (i - at >= rows or held + n > size):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def node_text(node, sep=" "):
    """Text nodes inside an element, joined."""
    return F.array_join(F.slice(_c("texts"), node["t0"] + 1, node["t1"] - node["t0"]), sep)


def inner_html(node, html="html"):
    return F.substring(_c(html), node["h0"] + 1, node["h1"] - node["h0"])


def attr(node, name):
    return F.try_element_at(node["attrs"], F.lit(name))


_STEP = re.compile(r"^([a-z0-9]*)(?:\.([\w-]+))?(?:\[([\w-]+)(?:(\*?=)'([^']*)')?\])?$")


def _matches(node, step):
    """One selector step: tag, .class, [a], [a='v'], [a*='v'] in any combination."""
    tag, cls, name, op, value = _STEP.match(step).groups()
    test = F.lit(True)
    if tag:
        test = test & (node["tag"] == tag)
    if cls:
        test = test & F.coalesce(F.array_contains(F.split(attr(node, "class"), r"\s+"), cls), F.lit(False))
    if name:
        given = attr(node, name)
        hit = given.isNotNull() if not op else (given == value if op == "=" else F.contains(given, F.lit(value)))
        test = test & F.coalesce(hit, F.lit(False))
    return test


def select(selector):
    """Elements that match a selector of one step, or two steps as ancestor and descendant."""
    *above, last = selector.split(" ")

    def keep(node):
        test = _matches(node, last)
        for step in above:
            test = test & F.exists(node["up"], lambda i: _matches(F.element_at(_c("nodes"), i), step))
        return test

    return F.filter(_c("nodes"), keep)


def select_first(selectors):
    """First element of the first selector that finds one; NULL when none does."""
    return F.coalesce(*[F.try_element_at(select(s), F.lit(1)) for s in selectors])


def first_text(selectors):
    return let(select_first(selectors), lambda n: node_text(n))


def meta_content(name):
    hits = [_meta(key, name) for key in ("property", "name")]
    return F.trim(text_or_empty(attr(F.coalesce(*hits), "content")))


def _meta(key, name):
    return F.try_element_at(F.filter(
        _c("nodes"), lambda n: (n["tag"] == "meta") & F.coalesce(attr(n, key) == name, F.lit(False))), F.lit(1))


def short_texts(selectors, limit=64):
    """Distinct texts of all matching elements, long ones left out."""
    texts = F.concat(*[F.transform(select(s), lambda n: node_text(n)) for s in selectors])
    return F.array_distinct(F.filter(texts, lambda t: (t != "") & (F.length(t) <= limit)))


def container_lines(node):
    """Lines of the nearest article, else list item, section or div around an element."""
    def nearest(tag):
        return F.try_element_at(F.filter(
            node["up"], lambda i: F.element_at(_c("nodes"), i)["tag"] == tag), F.lit(-1))

    index = F.coalesce(*[nearest(t) for t in ("article", "li", "section", "div")])
    box = F.coalesce(F.try_element_at(_c("nodes"), index), node)
    return let(box, lambda b: text_lines(node_text(b, "\n")))


def links(patterns, blocked):
    """Struct list (href, title, lines): first link per address that fits, stop texts left out."""
    found = F.transform(
        F.filter(_c("nodes"), lambda n: (n["tag"] == "a") & attr(n, "href").isNotNull()),
        lambda n: F.struct(attr(n, "href").alias("href"), node_text(n).alias("title"), n.alias("node")))

    def fits(x):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.contains(x["href"], F.lit(p))
        return hit & ~F.lower(normalize_ws(x["title"])).isin(*blocked)

    def first_only(kept):
        hrefs = F.transform(kept, lambda x: x["href"])
        return F.filter(kept, lambda x, i: F.array_position(hrefs, x["href"]) == i + 1)

    return F.transform(let(F.filter(found, fits), first_only), lambda x: F.struct(
        x["href"].alias("href"), x["title"].alias("title"), container_lines(x["node"]).alias("lines")))
