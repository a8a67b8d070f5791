"""Scalar rules against values worked out by hand; one DataFrame per rule."""

import re
from datetime import datetime
from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hirelake.functions import classify, dates, detail, location, salary, sections, skills, text, urls

AS_OF = datetime(2024, 7, 1, 12)


def apply(spark, fn, values, *more):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string")
    out = df.select("i", fn(F.col("v"), *more).alias("o")).orderBy("i").collect()
    return [r["o"] for r in out]


def check(spark, fn, table, *more):
    got = apply(spark, fn, list(table), *more)
    assert dict(zip(table, got)) == table


def test_whitespace_and_html(spark):
    check(spark, text.normalize_ws, {None: "", " a\xa0\t b\x1f": "a b", "x": "x", "a  b": "a b"})
    check(spark, text.clean_html, {
        None: "", "a & b": "a & b", "&lt;p&gt;x&lt;/p&gt;y": "x y", "&amp;amp;": "&", "AT&ampT &notit; &bogus;": "AT&T ¬it; &bogus;",
        "<a title='x>y'>t</a><!-- <b>no</b> -->u": "t u", "<script>if (a<b) {}</script>z": "z", "1 < 2": "1 < 2",
        "one•two · three": "one • two • three", "â€¢ q": "• q", "&#128;&#x1F600;&#0;": "€😀�", "<noscript>n</noscript>m": "m",
    })


def test_html_text_keeps_nodes_apart(spark):
    check(spark, text.html_text, {"<p>a <b>b</b></p><style>s</style>c": "a\nb\nc", "": ""})


def test_casing(spark):
    values = ["o'neil rest-of 3rd", "ÉCOLE été", "mcDonald", "a1b", ""]
    check(spark, text.py_title, {v: v.title() for v in values})
    check(spark, text.is_title_case, {v: v == v.title() for v in ["Rest Of", "Rest of", "2024", "O'Neil", "O'neil", "ABC"]})


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aZé1 -'ßx_.", max_size=12), min_size=20, max_size=40))
def test_title_casing_matches_python(spark, values):
    assert apply(spark, text.py_title, values) == [v.title() for v in values]


def test_urls(spark):
    check(spark, urls.canonical_url, {
        None: "", "": "", "HTTPS://Ex.Com/A/?utm_source=x#f": "https://ex.com/A", "https://ex.com/": "https://ex.com",
        "https://e.c/p;v=1/x;y?JobId=a+b&jobid=&gh_jid=1&gh_jid=2&z=9": "https://e.c/p;v=1/x?JobId=a+b&gh_jid=1&gh_jid=2",
        "/rel/path/": "/rel/path", "https://e.c/x?vacancy=%C3%A9~*": "https://e.c/x?vacancy=%C3%A9~%2A",
    } | {"https://ex.com/": "https://ex.com/"})
    check(spark, urls.source_job_id, {
        "https://e.c/senior-engineer": "engineer", "https://e.c/a?jid=%20 7&gh_jid=": "7", "https://e.c/": None,
        "https://e.c/jobs/123": "123", "https://e.c/x?vacancy=v&job_id=j": "j"})
    check(spark, urls.host_name, {"https://u:p@WWW.A-b.co:80/x": "www.a-b.co", "nohost": None})
    got = apply(spark, urls.company_name, ["Acme &amp; Co", "", "Unknown Company", "company"], F.lit("https://www.big-corp.io/x"))
    assert got == ["Acme & Co", "Big Corp", "Big Corp", "Big Corp"]
    assert apply(spark, urls.company_name, [""], F.lit("x")) == ["Unknown company"]
    check(spark, urls.domain_company, {"https://careers.a_b.org": "Careers", "x": "Unknown Company"})


def test_canonical_url_is_idempotent(spark):
    values = ["https://E.c/a/b/?gh_jid=1 2&x=1", "https://e.c//", "http://e.c/a;b=1?Vacancy=q%26r", "mailto:x@y"]
    once = apply(spark, urls.canonical_url, values)
    assert apply(spark, urls.canonical_url, once) == once


def test_absolute_href(spark):
    base = "https://h.ex/a/b/c?q=1"
    values = ["d", "../d", "/x/../y", "?p=2", "#top", "//o.ex/z", "https://z.ex/1", "./", "../../..", "d/./e?x=1#f"]
    got = apply(spark, lambda v: urls.absolute_href(F.lit(base), v), values)
    assert got == [urljoin(base, v) for v in values]
    assert apply(spark, lambda v: urls.absolute_href(F.lit(base), v), ["", None]) == [base, base]


def test_paged_url(spark):
    got = apply(spark, lambda v: urls.paged_url(v, F.lit(3)), ["https://a.b/c?x=1&page=2&x=2#f", "https://a.b/c"])
    assert got == ["https://a.b/c?x=1&x=2&page=3#f", "https://a.b/c?page=3"]


def test_dates(spark):
    d = lambda *a: datetime(*a)
    as_of = F.lit(AS_OF)
    check(spark, dates.parse_datetime, {
        None: AS_OF, "": AS_OF, "Today": AS_OF, "yesterday": d(2024, 6, 30, 12), "2 weeks ago": d(2024, 6, 17, 12),
        "1 month ago": d(2024, 6, 1, 12), "2024-2-3": d(2024, 2, 3), "2024-02-30": AS_OF, "2024-02-03T04:05:06.5+02:00": d(2024, 2, 3, 2, 5, 6, 500000),
        "20240203": d(2024, 2, 3), "3 may 2024": d(2024, 5, 3), "Sept 3, 2024": AS_OF, "September 3, 2024": d(2024, 9, 3),
        "Mon, 06 May 2024 10:00:00 EST": d(2024, 5, 6, 15), "Jan 2, 2024 01:02:03 +0100": d(2024, 1, 2, 0, 2, 3), "rubbish": AS_OF,
    }, as_of)
    check(spark, dates.parse_relative_date, {"2024-02-03": None, "3 days ago": d(2024, 6, 28, 12), "May 3, 2024": d(2024, 5, 3), "x": None}, as_of)
    row = spark.range(1).select(
        dates.parse_datetime(F.lit(None).cast("string"), as_of, F.lit(1.7e9)).alias("s"),
        dates.parse_datetime(F.lit(None).cast("string"), as_of, F.lit(1.7e12)).alias("ms")).first()
    assert row["s"] == row["ms"] == d(2023, 11, 14, 22, 13, 20)


def test_labels(spark):
    check(spark, classify.job_type, {"FULL_TIME": "unknown", "Full-Time": "full-time", "consultant": "contract", "an internal post": "unknown",
                                     "éintern": "unknown", "Part time, contract": "part-time", None: "unknown"})
    check(spark, classify.experience_level, {"International sales": "internship", "Sr. dev": "senior", "VP": "executive", "": "unknown"})
    got = apply(spark, lambda v: classify.infer_experience(v, F.lit("")), ["1+ years", "3 years", "5 years", "8 years", "12 years", "99999999999 years", "x"])
    assert got == ["entry", "junior", "mid", "senior", "lead", "lead", "unknown"]
    check(spark, classify.workplace_type, {"Kenya": "unknown", "Berlin": "onsite", "Distributed": "remote", "": "unknown", "Flexible workplace": "hybrid"})


def test_location(spark):
    got = apply(spark, lambda v: location.parse_location(v), ["usa", "Greater NYC", "A, B | Nairobi", "Remote", "Hybrid • Lagos/Accra", ""])
    assert [tuple(r) for r in got] == [
        ("usa", None, None, "Usa", "onsite"), ("Greater NYC", "New York", "Greater Nyc", "USA", "onsite"),
        ("A, B | Nairobi", "Nairobi", "A", "Kenya", "onsite"), ("Remote", None, None, None, "remote"),
        ("Hybrid , Lagos, Accra", "Accra", "Hybrid", "Ghana", "hybrid"), ("Unspecified", None, None, None, "unknown")]


def test_salary(spark):
    got = apply(spark, lambda v: salary.parse_salary(v), ["80-120k", "3-5 years", "USD 5", "5", "Confidential USD 5", "KSh 1,000.5 per Month"])
    assert [tuple(r) for r in got] == [
        ("80-120k", 80.0, 120000.0, None, None), ("3-5", 3.0, 5.0, None, None), ("5", 5.0, 5.0, "USD", None),
        (None, None, None, None, None), (None, None, None, None, None), ("1,000.5", 1000.5, 1000.5, "KES", "month")]
    got = spark.sql("select '0' a, '10' b, '20' c").select(
        salary.salary_text(F.lit("USD"), F.col("a"), F.col("c")).alias("zero"), salary.salary_text(F.lit(""), F.col("b"), F.col("c"), F.lit("DAY")).alias("unit")).first()
    assert tuple(got) == (None, "10 - 20 DAY")


def test_skills(spark):
    got = apply(spark, lambda v: skills.extract_skills(v), ["hiring; experience with apache kafka, docker.", "uses docker now", "reaction"])
    assert got == [["recruitment", "apache kafka"], ["docker"], ["react"]]


def test_sections(spark):
    html = "<h2>Job Summary</h2><p>Do things.</p><ul><li>• first</li><li>5 years here</li></ul><b>Remote</b><b>Tech Stack:</b><p>spark and more</p>"
    got = apply(spark, lambda v: sections.render_sections(sections.structure_description(v)), [html, "Benefits", "One. Two.", ""])
    assert got == ["Overview=Do things.|first|years here|Remote#Tech Stack=spark and more", "Overview=Benefits", "Overview=One.|Two.", ""]


def test_detail_view(spark):
    body = "About us we build many things together. Requirements: ten years of patience; a calm mind at all times. Responsibilities: keep every system running well."
    got = apply(spark, detail.detail_parts, [body, "plain"])
    assert got[0]["about"] == "About us we build many things together. "
    assert got[0]["requirements"].startswith("Requirements") and got[0]["requirements"].endswith("well.")
    assert got[0]["responsibilities"] == "Responsibilities: keep every system running well."
    assert tuple(got[1]) == ("plain", "", "")
    check(spark, detail.humanize, {"full-time_job": "Full Time Job", None: ""})
    check(spark, detail.hours_per_week, {"10 - 20 Hours per week": "10 - 20 Hours/week", "5 hrs/week": "5 hrs/week", "x": None})
    many = "Overview of the whole role in detail. " + " ".join(f"Sentence number {i} is long enough to stay." for i in range(30))
    view = apply(spark, lambda v: detail.detail_view(F.lit("T"), F.lit("full-time"), F.lit("L"), F.lit(None).cast("string"), v), [many, ""])
    assert len(view[0]["preview"][0]["items"]) == 17 and view[0]["has_more"]
    assert not view[1]["has_more"] and len(view[1]["full"][0]["fields"]) == 3


@pytest.mark.parametrize("page,expected", [("a\nDescription\nb\nc\nMethod of Application x\nd", "b c"), ("Description", ""), ("x", "")])
def test_slice_between(spark, page, expected):
    got = apply(spark, lambda v: text.slice_between(text.text_lines(v), ("Description",), ("Method of Application",)), [page])
    assert got == [expected] and re.match(r".*", page)
