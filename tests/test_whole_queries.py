"""Queries over whole texts and all documents, next to a plain Python version."""

import html
import re

import pytest

from hirelake import vocab
from hirelake.plans import catalog

ODD = [
    "Fish &amp; chips &lt;now&gt; &&& more \u2022 one\u00b7two\nlast line", "A <b>bold</b> word & a line\n\nend", "\u2022", "",
    "Long text. " * 200 + "What you'll do: " + "Tell the tale to everyone; " * 30 + "Requirements: " + "Patience with all of it. " * 40,
    "About you: You can read this long line of text. Responsibilities: You write it down for all others, 5-10 hours per week.",
    "Qualifications of many kinds are in this text, and more of them follow; your work matters a lot to us.", "Some more words. " * 40,
]


@pytest.fixture(scope="module")
def docs(spark, sf, tmp_path_factory):
    """A folder with the given documents and odd ones."""
    given = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = given + [(1_000_000 + i, t, "en", "board") for i, t in enumerate(ODD)]
    folder = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def run(spark, docs, name):
    got = catalog.QUERIES[name](spark, docs[0]).collect()
    assert len(got) == len(docs[1])
    return got


def ws(x):
    return " ".join(x.split())


def plain(x):
    """Text behind entities and tags, each resolved as the functions say: before and after the tags go."""
    return html.unescape(re.sub(r"</?[a-z]+>", " ", html.unescape(x)))


def test_clean_html(spark, docs):
    got = {r.doc_id: r.clean for r in run(spark, docs, "clean_html")}
    for doc_id, text, _, _ in docs[1]:
        whole = plain(text.replace("&", "&amp;").replace("\n", " ")) + "\u2022tail\xa0\xe9A\xa9 b"
        assert got[doc_id] == ws(re.sub(r"\s*[\u2022\u00b7]\s*", " \u2022 ", whole)), doc_id


def test_structure_description(spark, docs):
    got = {r.doc_id: r.sections for r in run(spark, docs, "structure_description")}
    for doc_id, text, lang, source in docs[1]:
        if re.search("<b>|&lt;", text):
            continue  # inner tags begin lines of their own
        about = re.sub(r"^[\u2022*\-\d.)(]+\s*", "", ws(plain(text.replace("\n", " ") + ".x")))
        want = [f"Overview={about}"]
        if doc_id % 2 == 0:
            want.append(f"Requirements=years of {source}|must {lang}")
        if doc_id % 30:
            want.append("Benefits=" + "|".join(f"perk no {i}" for i in range(1, doc_id % 30 + 1)))
        assert got[doc_id] == "#".join(want), doc_id


def test_html_postings(spark, docs):
    got = {r.url: r for r in run(spark, docs, "html_postings")}
    for doc_id, _, _, source in docs[1]:
        r = got[f"https://www.board.example/listings/role-{doc_id}"]
        assert (r.title, r.company, r.skills) == (f"Page role {doc_id}", "Page company", "Excel")
        assert r.description == (f"Page role {doc_id}~Page company~Excel~Applicant Location: Kisumu~Full Time~Job descriptions & "
                                 f"requirements~Do the {source} work~Second line~Similar jobs")


def points(x):
    cut = r"(?i:(?:(?:^|\s)(?:" + "|".join(vocab.POINT_HEADINGS) + r")\s*:?))|[\u2022;]|(?<=\.)\s+(?=[A-Za-z0-9])"
    parts = [p.strip() for p in re.split(cut, re.sub(r"\s+", " ", x))]
    lead = r"(?i)^(" + "|".join(vocab.LEAD_HEADINGS) + r")\s*:?\s*"
    return [p for p in (re.sub(lead, "", p).strip() for p in parts if len(p) > 20) if p]


def test_preview_sections(spark, docs):
    got = {r.doc_id: r for r in run(spark, docs, "preview_sections")}
    for doc_id, text, lang, source in docs[1]:
        t = text.replace("\n", " ").replace(";", ",")
        resp = f"What you'll do: Build pipelines number {doc_id} and keep them running; Review the work of peers every day."
        req = f"Requirements: Ten years of patience with {lang} text; Fluent in {source} and one more."
        whole = (f"{t} {resp} {req}", f"{t} {req} {resp}", t, resp)[doc_id % 4]
        low = whole.lower()
        first = [min([low.find(x) for x in marks if x in low], default=-1)
                 for marks in (vocab.RESPONSIBILITY_MARKERS, vocab.REQUIREMENT_MARKERS)]
        at_resp, at_req = first
        about = whole[:min([x for x in first if x >= 0], default=len(whole))]
        mine = whole[at_resp:at_req if at_req > at_resp else len(whole)] if at_resp >= 0 else ""
        lists = [points(about), points(mine), points(whole[at_req:]) if at_req >= 0 else []]
        fields = ["Role", "Full Time", "Berlin"]
        hours = re.search(r"(?i)(\d{1,2}\s*(?:-|to)\s*\d{1,2}|\d{1,2})\s*(hours|hrs)\s*(?:per|/)\s*week", whole)
        fields += [f"{hours[1]} {hours[2]}/week"] if hours else []
        left, shown = vocab.DETAIL_ROW_BUDGET - len(fields), []
        for items in lists:
            shown.append(items[:left])
            left -= len(shown[-1])
        shown[0] = fields + shown[0]
        assert got[doc_id].preview == "#".join(f"{n}=" + "|".join(x) for n, x in zip(vocab.DETAIL_TITLES, shown) if x), doc_id
        assert got[doc_id].has_more == (sum(map(len, lists)) + len(fields) > sum(map(len, shown))), doc_id
