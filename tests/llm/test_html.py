import itertools
import random

from hirelake.llm import html_mincut as m
from hirelake.llm import queries

PLAIN = """<html><head><title>T</title></head><body class="page"><header class="site-header"><h1>Site</h1><ul class=menu><li><a href=/>Home</a></ul></header>
<div class="cookie-notice">We use cookies to improve your experience. Please accept them now.</div>
<div id="wrap"><div class="left"><h2>My story &amp; more</h2><p>First para is here, with some words in it that are long enough.</p><div class="ad-slot">Buy this great thing now. It is very cheap and good for all.</div><p>Short.</p><p>Second   para&nbsp;has a lot
 of text, too, and it ends in a <b>st</b>op.</p></div>
<div class="sidebar"><p>Other stories that you might like to read in the weekend, and more.</p></div></div>
<form><p>Sign up for our mail letter and get news every day.</p><input name=x></form>
<section id="comments"><h3>Comments</h3><div class=comment><p>I like this very much, it is a good text and I will read it again.</p></div></section>
<footer>(c) 2024</footer></body></html>"""
WANTED = ("My story & more\nFirst para is here, with some words in it that are long enough.\nShort.\n"
          "Second para has a lot of text, too, and it ends in a stop.")


def test_pages():
    assert m.main_text(PLAIN) == WANTED
    marked = PLAIN.replace('<div class="left">', "<article>").replace("stop.</p></div>", "stop.</p></article>")
    assert m.main_text("<!-- <p>no</p> -->" + marked) == WANTED
    assert m.main_text("<article><p>One<p>Two<script>if (a<b) x='</p>'</script><ul><li>a<li>b</ul>&lt;c&gt;</article>") == "One\nTwo\na\nb\n<c>"
    assert m.main_text("<article><p>Some text here.</p><aside>no</aside><p hidden>no</p><nav>no</nav><p>End.</p></article>") == "Some text here.\nEnd."


def test_wrappers_with_bad_names():
    text = " ".join(f"This is sentence number {i} of the article, and it is of quite ordinary length." for i in range(5))
    inner = f"<p>{text}</p><p>{text}</p>"
    wanted = f"{text}\n{text}"
    notice = '<div class="cookie-notice">We use cookies to improve your experience. Please accept them now.</div>'
    side = "<p>Other stories that you might like to read in the weekend, and more.</p>"
    for wrap in ('<div id="page" class="site">%s</div>', '<div class="site-content">%s</div>', '<div class="content-with-sidebar">%s</div>',
                 '<div class="search-page">%s</div>', '<form action="/" id="aspnetForm">%s</form>', '<div class="no-sidebar">%s</div>',
                 '<div class="login-layout"><div class="site"><form>%s</form></div></div>', '<div class="header"><main>%s</main></div>'):
        for body in (inner, f"<article>{inner}</article>"):
            for page in (body + notice, f'{body}<div class="sidebar">{side}</div><aside>{side}</aside>{notice}'):
                assert m.main_text("<html><body>" + wrap % page + "</body></html>").startswith(wanted), wrap
            assert m.main_text("<body>" + wrap % body + notice + f'<div class="sidebar">{side}</div>') == wanted, wrap
    # The marks stay on elements beside the text, however they nest.
    cards = f'<div class="related-posts"><article><p>{text[:150]}.</p></article></div>'
    assert m.main_text(f'<div class="site"><div><p>{text}</p></div>{cards}<div class="site-info">{side}</div></div>') == text
    comments = f'<div id="comments"><div class="comment-body">{inner}{inner}{inner}</div></div>'
    assert m.main_text(f'<div class="site"><article>{inner}</article>{comments}</div>') == wanted


def test_head_without_end_tag():
    text = "This text is in the body, and it has enough words to be kept as text."
    for page in ("<html><head><title>T</title><body><p>%s</p>", "<head><title>T</title><p>%s", "<head><meta x><title>T</title>%s",
                 "<head><noscript><link x><body><p>%s</p>", '<html><head><title>T</title></head><body style="visibility:hidden"><p>%s</p>'):
        assert m.main_text(page % text) == text, page


def test_broken_and_edge_pages():
    for x in (None, "", "   ", "<", "<p", "<!--", "<script>", "</p></div>", "<p a='<b>", "<a><a><p></a>", "&#x110000; &bogus; &#0;", "<![CDATA[x]]>"):
        assert isinstance(m.main_text(x), str)
    deep = "<div>" * 3000 + "<p>This text is deep inside, and it has enough words to be kept as text.</p>"
    assert m.main_text(deep).startswith("This text")
    assert m.main_text("<article>" + "<p>A line of words.</p>" * 20000 + "</article>").count("\n") == 19999
    assert m.main_text("A text without any tag, which is as long as a sentence.") != ""


def test_cut_is_minimal():
    rnd = random.Random(3)
    for _ in range(150):
        n = rnd.randint(1, 8)
        scores = [rnd.uniform(-2, 2) for _ in range(n)]
        ties = [(i, j, rnd.uniform(0, 1.5)) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.6]

        def cost(label):
            return (sum(max(z, 0) for z, k in zip(scores, label) if not k) - sum(min(z, 0) for z, k in zip(scores, label) if k)
                    + sum(w for i, j, w in ties if label[i] != label[j]))

        got = m.minimum_cut(scores, ties)
        assert abs(cost(got) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-9


def test_query(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.QUERIES["op9_html_mincut"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == m.main_text(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
        inner = pages[r.page_id].html.split("<article>")[1].split("</article>")[0]
        assert r.text.split("\n")[0][:10] in m.html_lib.unescape(inner)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x", 2), (1, "u", "<p>x", 2)], "page_id long, url string, html string, text int")
    assert sorted(r.n_chars for r in m.extract_pages(odd).collect())[0] == 0
    assert m.extract_pages(odd.limit(0)).collect() == []
