"""Main text of a page by minimum cut.

A page is split into text blocks.  A linear classifier over tags, class names, link share and length
says how much each block looks like content; its logistic losses are the capacities to the two
terminals.  Blocks that follow each other, and blocks that are neighbours under the same parent, are
tied by smoothness edges that weaken with their distance in the document tree.  The minimum cut
labels all blocks of the page at once.  Blocks whose own cost outweighs all their edges keep their
label in every minimum cut and are settled first; max-flow decides the rest.

Names that are bad only in part (``search-page``), names of layouts and forms may stand on the wrapper
of a whole page.  Such a mark is void where the element holds the page: where less than a quarter of
its own text is found outside all bad elements.  ``<main>`` ends the marks around it.

Spark deals the pages; a page is worked on whole inside one task, and nothing else is held.

Defined results: NULL or empty html: empty text.  Broken markup is read leniently: unclosed and stray
tags, unquoted attributes, a missing end of a comment or script (which then takes the rest), a head
without end tag (which ends at the first tag or text that cannot be in it).  Text
outside any tag counts as a block.  Repeated rows and ids are separate, NULL ids and urls pass.  Very
long pages are read whole.  No rows: no rows.  Extra columns are not read.
"""

import html as html_lib
import math
import re
from collections import deque

from pyspark.sql import types as T

from .common import small_batches

#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol "
    "optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements without end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
DROPPED = frozenset(
    "script style template noscript iframe object svg math head title textarea select option button datalist audio "
    "video canvas map noframes noembed".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: An opening tag ends these open elements, as HTML says.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
#: Elements that may stand in a head; any other ends it.
HEAD_CONTENT = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
_SCOPES = frozenset("ul ol dl table select body html article section main div td th".split())

BAD_TAGS = frozenset("nav footer aside menu dialog search label input".split())
#: Elements and roles that are bad unless the page stands in them.
WEAK_TAGS, WEAK_ROLES = frozenset(("form", "fieldset")), frozenset(("form", "search"))
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar note".split())
_BAD = re.compile(
    r"^(ad|ads|adv|advert\w*|adsense|adbox|adslot|banner\w*|breadcrumbs?|comments?|commentlist|consent|cookies?|copyright|"
    r"dialog|disclaimer|discussion|disqus|footer|gdpr|header|login|masthead|menu\w*|modal|nav|navbar|navigation|"
    r"newsletter|notice|notices|notification|alert|outbrain|overlay|pager|pagination|paywall|popup|privacy|promo\w*|"
    r"recommend\w*|related|replies|reply|respond|rail|search|share|sharing|sidebar|signup|site|skip|social|sponsor\w*|"
    r"subscribe|subscription|taboola|tags|teaser|toolbar|topbar|toc|tracking|widgets?|warning|feedback|hidden)$")
#: Bad words that also name layouts, and words after which a name tells what else the page has.
_WEAK = frozenset("site search share sharing rail sidebar skip".split())
_STATE = frozenset("with has no without".split())
_WRAPPER = re.compile(r"^(wrap\w*|container|layout|inner|outer|root|app|grid|row)$")
_GOOD = re.compile(r"^(article\w*|body|content|entry|main|post|story|text|page)$")
_TOKEN = re.compile(r"[A-Za-z]+")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_TAG = re.compile(r"""<(?:!--|!|\?|(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>)""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Weights of the classifier; ``OUTSIDE`` counts where the page marks its content and the block is not in it.
BIAS, OUTSIDE, LENGTH, LINKS, GOOD, BAD, HEADING, PUNCTUATION = 0.3, -3.0, 0.7, -4.0, 3.0, -9.0, 0.8, 0.6
SMOOTH = 0.8


#: How sure a bad mark is: by its name in full, by a part of it, by a word that also names layouts.
FULL, PART, WEAK = 3, 2, 1


def _name_mark(name):
    """How bad a class name or id is: 0, ``WEAK``, ``PART`` or ``FULL``."""
    parts = [t.lower() for t in _TOKEN.findall(name)]
    at = next((i for i, t in enumerate(parts) if t in _STATE), len(parts))
    parts = parts[:at]
    if "site" in parts:
        parts.remove("site")
        if parts and not any(_BAD.match(t) or _GOOD.match(t) or _WRAPPER.match(t) for t in parts):
            return WEAK
    bad = [t for t in parts if _BAD.match(t)]
    if not bad:
        return 0
    if all(t in _WEAK for t in bad):
        return WEAK
    return FULL if len(bad) == len(parts) else PART


def _node(parent, tag, attributes, n):
    """What an open element says about the text inside it.

    (tag, id, depth, good, bad, dropped, in article, in marked content, mark): ``bad`` is sure, ``mark``
    is the nearest mark that may be void: (id, kind, mark around it) or None.
    """
    good, bad, dropped, core, mark = parent[3], parent[4], parent[5] or tag in DROPPED, parent[7], parent[8]
    in_article = parent[6] or tag == "article"
    own = WEAK if tag in WEAK_TAGS else 0
    if tag in ("article", "main"):
        good = core = True
    if tag == "main":
        mark = None
    if tag in BAD_TAGS or (tag == "header" and not in_article):
        bad = True
    if attributes:
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
        names = f"{found.get('class', '')} {found.get('id', '')}".split()
        parts = {t.lower() for x in names for t in _TOKEN.findall(x)}
        role = found.get("role", "").lower()
        if role in WEAK_ROLES:
            own = max(own, WEAK)
        elif role in BAD_ROLES:
            bad = True
        if role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
            good = core = True
        if role == "main":
            mark = None
        if any(_BAD.match(t) and t.startswith(("comment", "repl")) for t in parts):
            bad = True
        if tag not in ("html", "body", "main", "article"):
            own = max([own, *map(_name_mark, names)])
        if any(_GOOD.match(t) for t in parts) and tag != "body":
            good = True
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
            # A whole page is hidden only until its scripts have run.
            dropped = dropped or tag not in ("html", "body")
    return tag, n, parent[2] + 1, good, bad, dropped, in_article, core, (n, own, mark) if own else mark


class _Page:
    """Blocks of one page: text, characters in links, and the element they stand in."""

    def __init__(self):
        self.n = 0
        self.stack = [("", 0, 0, False, False, False, False, False, None)]
        self.blocks, self.text, self.linked, self.links = [], [], 0, 0

    def add(self, text):
        if self.stack[-1][0] == "head" and text.strip():
            self.pop_to(len(self.stack) - 1)
        if text and not self.stack[-1][5]:
            self.text.append(text)
            if self.links:
                self.linked += len(text.strip())

    def cut(self):
        if self.text:
            whole = " ".join(html_lib.unescape("".join(self.text)).split())
            if whole:
                path = [e for e in self.stack if e[0] in BLOCKS or not e[0]]
                self.blocks.append((whole, min(self.linked, len(whole)), path))
            self.text, self.linked = [], 0

    def open(self, tag, attributes):
        if tag == "body":
            self.end_dropped()
        elif self.stack[-1][0] == "head" and tag not in HEAD_CONTENT:
            self.pop_to(len(self.stack) - 1)
        if tag in BLOCKS:
            self.cut()
            if tag not in ("head", "title", "option", "optgroup", "legend"):
                self.close_implied(("p",), stop=("table", "button"))
        if tag in CLOSES:
            self.close_implied(CLOSES[tag], stop=_SCOPES - set(CLOSES[tag]))
        if tag in VOID:
            return
        self.n += 1
        self.stack.append(_node(self.stack[-1], tag, attributes, self.n))
        self.links += tag == "a"

    def end_dropped(self):
        """A body ends the elements before it whose content is no text."""
        i = next((i for i, e in enumerate(self.stack) if e[5]), None)
        if i is not None:
            self.pop_to(i)

    def close_implied(self, tags, stop):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                self.pop_to(i)
                return
            if self.stack[i][0] in stop or (tags == ("p",) and self.stack[i][0] in BLOCKS):
                return

    def pop_to(self, i):
        if any(e[0] in BLOCKS for e in self.stack[i:]):
            self.cut()
        self.links -= sum(e[0] == "a" for e in self.stack[i:])
        del self.stack[i:]

    def close(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self.pop_to(i)
                return
            if tag not in BLOCKS and self.stack[i][0] in BLOCKS:
                break
        if tag in BLOCKS:
            self.cut()


def page_blocks(source):
    """Blocks in page order: text, characters in links, path, whether they stand in a bad element."""
    page, at, size = _Page(), 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        if m is None:
            page.add(source[at:])
            break
        page.add(source[at:m.start()])
        at = m.end()
        if m[2] is None:
            mark = "-->" if m[0] == "<!--" else ">"
            if mark == "-->" and source.startswith((">", "->"), at):
                at = source.index(">", at) + 1
                continue
            end = source.find(mark, at)
            at = size if end < 0 else end + len(mark)
            continue
        tag = m[2].lower()
        if m[1]:
            page.close(tag)
            continue
        if tag == "br":
            page.add(" ")
        page.open(tag, m[3])
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
            if tag not in DROPPED:
                page.add(source[at:end.start() if end else size])
            at = end.start() if end else size
    page.cut()
    return [(*block, bad) for block, bad in zip(page.blocks, _bad_blocks(page.blocks))]


def _bad_blocks(blocks):
    """Whether each block is bad, after marks on wrappers of the page are found void.

    The marks are gone through from the one with most text on, outer ones first; the text of a void
    mark is free for the smaller ones, so that a side column never counts as the page.
    """
    kinds, under, held, core_held = {}, {}, {}, {}
    live, free, core_free = [0] * len(blocks), 0, 0
    sizes = [len(text) - linked for text, linked, _ in blocks]
    for i, (_, _, path) in enumerate(blocks):
        top = path[-1]
        if top[4]:
            continue
        mark = top[8]
        if mark is None:
            free += sizes[i]
            core_free += sizes[i] * top[7]
        while mark is not None:
            n, kind, mark = mark
            kinds[n] = kind
            under.setdefault(n, []).append(i)
            held[n] = held.get(n, 0) + sizes[i]
            core_held[n] = core_held.get(n, 0) + sizes[i] * top[7]
            live[i] += 1
    has_core = any(core_held.values()) or core_free > 0
    for n in sorted(kinds, key=lambda n: (-held[n], n)):
        if kinds[n] == FULL and not core_held[n]:
            continue
        inside, outside = (core_held[n], core_free) if kinds[n] == WEAK and has_core else (held[n], free)
        if 4 * outside >= inside:
            continue
        for i in under[n]:
            live[i] -= 1
            if not live[i]:
                free += sizes[i]
                core_free += sizes[i] * blocks[i][2][-1][7]
    return [path[-1][4] or live[i] > 0 for i, (_, _, path) in enumerate(blocks)]


def content_score(block, marked=False):
    """Log-odds that a block is content; ``marked`` tells that the page marks its content."""
    text, linked, path, bad = block
    top = path[-1]
    z = BIAS + LENGTH * math.log1p(len(text) / 20) + LINKS * linked / len(text)
    if re.search(r"[.!?]['\"”»)]?$", text):
        z += PUNCTUATION
    if top[0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
        z += HEADING
    return z + (GOOD if top[3] else OUTSIDE * marked) + BAD * bad


def edges(blocks):
    """Smoothness edges (i, j, weight): following blocks, and neighbours under one parent."""
    out, last = [], {}
    for j, (_, _, path, _) in enumerate(blocks):
        parent = path[-2][1] if len(path) > 1 else 0
        if j:
            before = blocks[j - 1][2]
            same = 0
            for a, b in zip(before, path):
                if a[1] != b[1]:
                    break
                same += 1
            out.append((j - 1, j, SMOOTH / (1 + max(0, len(before) + len(path) - 2 * same - 2))))
        i = last.get(parent)
        if i is not None and i < j - 1:
            out.append((i, j, SMOOTH / 2))
        last[parent] = j
    return out


def minimum_cut(scores, ties):
    """Label of every block in a minimum cut: True for content; ties between cuts go to content last."""
    n = len(scores)
    around = [[] for _ in range(n)]
    for i, j, w in ties:
        around[i].append((j, w))
        around[j].append((i, w))
    # log(1 + e^z) - log(1 + e^-z) = z: the difference of the two terminal capacities.
    pull, label, free = list(scores), [None] * n, [sum(w for _, w in a) for a in around]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(pull[i]) >= free[i] and (pull[i] or not free[i]):
            label[i] = pull[i] > 0
            for j, w in around[i]:
                if label[j] is None:
                    pull[j] += w if label[i] else -w
                    free[j] -= w
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _max_flow(rest, pull, around, label)):
            label[i] = side
    return label


def _max_flow(rest, pull, around, label):
    """Dinic's algorithm on the undecided blocks; True on the content side."""
    at = {i: k for k, i in enumerate(rest)}
    s, t = len(rest), len(rest) + 1
    graph = [[] for _ in range(t + 1)]

    def link(a, b, there, back):
        graph[a].append([b, there, len(graph[b])])
        graph[b].append([a, back, len(graph[a]) - 1])

    for i, k in at.items():
        if pull[i] > 0:
            link(s, k, pull[i], 0.0)
        elif pull[i] < 0:
            link(k, t, -pull[i], 0.0)
        for j, w in around[i]:
            if j in at and i < j:
                link(k, at[j], w, w)
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            a = queue.popleft()
            for b, room, _ in graph[a]:
                if room > 1e-12 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if t not in level:
            return [k in level for k in range(len(rest))]
        turn = [0] * (t + 1)
        path = []
        a = s
        while True:
            if a == t:
                flow = min(graph[x][e][1] for x, e in path)
                for x, e in path:
                    edge = graph[x][e]
                    edge[1] -= flow
                    graph[edge[0]][edge[2]][1] += flow
                cut = next(k for k, (x, e) in enumerate(path) if graph[x][e][1] <= 1e-12)
                a = path[cut][0]
                del path[cut:]
                continue
            while turn[a] < len(graph[a]):
                b, room, _ = graph[a][turn[a]]
                if room > 1e-12 and level.get(b, -1) == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(graph[a]):
                path.append((a, turn[a]))
                a = graph[a][turn[a]][0]
            elif path:
                a, e = path.pop()
                turn[a] += 1
            else:
                break


def main_text(source):
    """Text of the content blocks, one line each."""
    if not source:
        return ""
    blocks = page_blocks(source)
    marked = any(b[2][-1][3] and not b[3] for b in blocks)
    keep = minimum_cut([content_score(b, marked) for b in blocks], edges(blocks))
    return "\n".join(b[0] for b, k in zip(blocks, keep) if k)


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages):
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    small_batches(pages.sparkSession)
    schema = T.StructType([*(T.StructField(c, pages.schema[c].dataType) for c in ("page_id", "url")),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select("page_id", "url", "html").mapInArrow(_extract, schema)
