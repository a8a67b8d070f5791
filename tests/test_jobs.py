"""Whole jobs on small fixtures: the normalise and merge cases, adapters, boards, store, streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hirelake.operators import admission, merge
from hirelake.operators.filters import filter_postings
from hirelake.operators.normalise import looks_like_job, merge_payloads, normalise
from hirelake.operators.ordering import page_postings
from hirelake.plans.ingest import run_ingest
from hirelake.schema import RAW_SCHEMA, conform
from hirelake.session import cut_lineage, scratch_path
from hirelake.sources import boards, csv_export, dom, store

def as_of():
    return F.lit(datetime(2026, 5, 1))


def raw(spark, rows):
    base = dict.fromkeys(("source", "title", "company", "location", "description", "job_url", "apply_url", "salary_text", "posted_text"))
    data = [tuple({**base, **r}.values()) + (i,) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"{n} string" for n in base) + ", arrival bigint")


def test_normalise_case(spark):
    job = normalise(raw(spark, [{
        "source": "remoteok", "title": "Senior Python Engineer", "company": "Acme Labs", "location": "Remote",
        "description": "<p>Full Time role with 6 years experience using Python, FastAPI, AWS and Docker.</p>",
        "job_url": "https://example.com/jobs/123", "apply_url": "https://example.com/jobs/123/apply",
        "salary_text": "USD 120000 - 150000 per year", "posted_text": "2026-04-20"}]), as_of()).first()
    want = {
        "job_type": "full-time", "workplace_type": "remote", "experience_level": "senior", "skills": ["python", "fastapi", "aws"],
        "salary_currency": "USD", "salary_min": 120000.0, "salary_max": 150000.0, "salary_text": "120000 - 150000",
        "salary_interval": "year", "location": "Remote", "location_city": None, "canonical_url": "https://example.com/jobs/123",
        "source_job_id": "123", "source_website": "example.com", "quality_score": 17, "posted_at": datetime(2026, 4, 20)}
    assert {k: job[k] for k in want} == want and len(job["description_sections"]) == 1


def test_merge_case(spark):
    row = {"title": "Backend Engineer", "company": "Acme", "location": "Remote", "apply_url": "https://example.com/jobs/1/apply", "posted_text": "2026-04-01"}
    both = normalise(raw(spark, [
        {**row, "source": "remoteok", "description": "Python backend role", "job_url": "https://example.com/jobs/1"},
        {**row, "source": "greenhouse", "description": "Senior Python backend role with FastAPI and AWS", "job_url": "https://example.com/jobs/1?utm_source=test"},
    ]), as_of())
    both = cut_lineage(both)
    result = merge.merge_postings(both.filter("arrival = 1"), both.filter("arrival = 0"))
    report, saved = result.report.first(), result.postings.collect()
    assert (report["inserted"], report["updated"], report["deduplicated"]) == (0, 1, 1)
    assert len(saved) == 1 and saved[0]["skills"] == ["python", "fastapi", "aws"]
    assert saved[0]["aggregated_sources"] == ["greenhouse", "remoteok"]


def test_noise_and_payload_merge(spark):
    df = spark.createDataFrame([("Dev", "x"), ("Developer", "Lorem ipsum"), ("Developer", "ok"), (None, "ok")], "t string, d string")
    assert [r[0] for r in df.select(looks_like_job(F.col("t"), F.col("d"))).collect()] == [False, False, True, True]
    a = spark.createDataFrame([(1, "", "unknown", ["X"])], "k int, title string, company string, skills array<string>")
    b = spark.createDataFrame([(1, "T", "Acme", ["x", "Y "])], "k int, title string, company string, skills array<string>")
    assert tuple(merge_payloads([a, b], "k").first()) == (1, "T", "Acme", ["x", "y"])


def test_filters_take_wildcards_literally_and_paging_checks_bounds(spark):
    df = spark.createDataFrame([("100%", "a_b"), ("1000", "axb")], "title string, company string").withColumns({
        "description": F.lit(""), "skills": F.array(F.lit("sql"))})
    assert filter_postings(df, keyword="0%").count() == 1 and filter_postings(df, company="A_B").count() == 1
    assert filter_postings(df, keyword="").count() == 2
    for offset, limit in ((-1, 10), (0, 0), (0, 501)):
        with pytest.raises(ValueError):
            page_postings(df, offset, limit)


def test_csv_quotes_and_timestamps(spark):
    df = spark.createDataFrame([('say "hi", you', datetime(2024, 1, 2, 3, 4, 5, 60))], "title string, posted_at timestamp")
    for n in ("id", "source_job_id", "company", "location", "location_city", "location_country", "workplace_type", "source",
              "source_website", "job_type", "experience_level", "salary_text", "job_url", "apply_url"):
        df = df.withColumn(n, F.lit("v"))
    df = df.withColumns({"scraped_at": F.lit(datetime(2024, 1, 1)), "skills": F.array(F.lit("a"), F.lit("b")), "arrival": F.lit(0)})
    lines = [r["line"] for r in csv_export.csv_lines(df).orderBy("line_no").collect()]
    assert lines[0].startswith("id,source_job_id,title")
    assert lines[1] == ('v,"v","say ""hi"", you","v","v","v","v",v,v,"v","v",v,"v","v","v",'
                        '2024-01-02T03:04:05.000060+00:00,2024-01-01T00:00:00+00:00,"a|b"')


def test_page_structure(spark):
    html = ('<html><head><meta name="og:title" content=" M "></head><body><nav aria-label="Pagination x"><a href="?p=2">Older</a></nav>'
            '<div class="a b"><article><p>one<p>two<br>three</article><ul><li>x<span class="job-title big">T</span></li></ul></div></body></html>')
    df = dom.with_nodes(spark.createDataFrame([(html,)], "html string"))
    row = df.select(
        dom.first_text([".b"]).alias("b"), dom.first_text(["[class*='job-title']"]).alias("t"), dom.meta_content("og:title").alias("m"),
        dom.attr(dom.select_first(["nav[aria-label*='Pagination'] a"]), "href").alias("h"), dom.first_text(["article"]).alias("a"),
        dom.inner_html(dom.select_first(["ul"])).alias("i"), dom.first_text(["ul article"]).alias("none")).first()
    assert tuple(row) == ("one two three x T", "T", "M", "?p=2", "one two three", '<li>x<span class="job-title big">T</span></li>', None)


def test_other_boards(spark):
    page = ('<ul><li><a href="/jobs/clerk-1">Best Shop Jobs 40K - 50K</a><p>made in 2023</p><p>near Kakamega</p></li>'
            '<li><a href="/job/">x</a></li><li><a href="/job/cook">Cook at Big Inn</a><p>in LAGOS</p><p>Yesterday</p></li></ul>')
    pages = spark.createDataFrame([(0, "https://b.co.ke/jobs", page)], "seq bigint, url string, html string")
    rows = boards.board_listings(pages, boards.BOARDS["corporatestaffing"], as_of()).orderBy("arrival").collect()
    assert [(r["company"], r["location"], r["salary_text"], r["posted_text"]) for r in rows] == [
        ("Best Shop", "Kakamega", "40K - 50K", "made in 2023"), ("Corporate Staffing Services", "Kenya", None, None)]
    rows = boards.board_listings(pages, boards.BOARDS["myjobmag"], as_of()).collect()
    assert [(r["title"], r["company"], r["location"], r["posted_ts"], r["source_website"]) for r in rows] == [
        ("Cook", "Big Inn", "Lagos", datetime(2026, 4, 30), "myjobmag.co.ke")]
    rows = boards.board_listings(pages, boards.BOARDS["fuzu"], as_of()).collect()
    assert [(r["title"], r["company"], r["job_url"]) for r in rows] == [("Cook at Big Inn", "Fuzu Employer", "https://b.co.ke/job/cook")]


def test_ingest_twice(spark):
    feed = '[{"legal":1},{"id":7,"position":"Data Engineer","company":"Acme","url":"https://r.ex/7","tags":["sql"],"epoch":1700000000}]'
    landed = spark.createDataFrame([
        ("remoteok", 0, "feed", feed), ("lever", 1, "acme", "{bad"),
        ("lever", 2, "acme", '[{"id":"L1","text":"Data Engineer","hostedUrl":"https://r.ex/7","categories":{"location":"Lagos"},"createdAt":1700000000000}]'),
    ], "source string, seq bigint, origin string, body string")
    root = scratch_path(spark, "jobs")
    first = {r["source"]: r.asDict() for r in run_ingest(spark, landed, root, "a", as_of(), sources=["remoteok", "lever"]).collect()}
    assert (first["remoteok"]["inserted"], first["lever"]["deduplicated"], first["lever"]["errors"]) == (1, 1, 1)
    again = run_ingest(spark, landed, root, "b", as_of(), sources=["remoteok", "lever"]).collect()
    assert sum(r["inserted"] for r in again) == 0
    assert store.snapshots(spark, root) == ["a", "b"] and store.read_postings(spark, root).count() == 1


def test_admission_in_pieces_equals_one_scan(spark):
    import random

    rng = random.Random(3)
    t, rows = datetime(2024, 1, 1), []
    for i in range(400):
        t += timedelta(seconds=rng.choice([1, 5, 20, 61, 200]))
        rows.append((i, rng.choice("ab"), t))
    events = spark.createDataFrame(rows, "n bigint, k string, ts timestamp")
    got = {r["n"]: r["decision"] for r in admission.admit_by_cooldown(events, "k", "ts", "n", 45, 3, 60).collect()}
    want, rules = {}, {}
    for n, k, ts in rows:
        log, done = rules.setdefault(k, ([], [None]))
        now = ts.timestamp()
        log[:] = [x for x in log if now - x <= 60]
        if len(log) >= 3:
            want[n] = "rate"
            continue
        log.append(now)
        if done[0] is not None and now - done[0] < 45:
            want[n] = "cooldown"
        else:
            want[n], done[0] = "admitted", now
    assert got == want


def test_registered_queries_have_unique_columns_and_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    from hirelake.plans import catalog

    # The corpus queries, where they are installed, are tested on their own.
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"merge_replay", "ingest_stream", "preview_sections"}
    assert entry.entry(spark).columns == ["metric", "rank", "label", "count"]


def test_admission_on_a_stream(spark, tmp_path):
    from hirelake.streaming.admission import admit_stream

    rows = [("a", s) for s in (0, 1, 2, 3, 61, 62)] + [("b", 5)]
    events = spark.createDataFrame([(k, datetime(2024, 1, 1) + timedelta(seconds=s)) for k, s in rows], "k string, ts timestamp")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = admit_stream(stream, "k", "ts").writeStream.format("memory").queryName("admitted").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = [r["decision"] for r in spark.sql("SELECT * FROM admitted ORDER BY k, ts").collect()]
    # The third second is full; at 61 s the first event no longer counts, at 62 s neither does the second.
    assert got == ["admitted", "admitted", "admitted", "rate", "admitted", "admitted", "admitted"]


def test_stored_table_prunes_sources_and_columns(spark):
    row = {"title": "Engineer", "company": "Acme", "location": "Lagos", "description": "d"}
    jobs = normalise(raw(spark, [{**row, "source": s, "job_url": f"https://x.ex/{s}"} for s in ("lever", "fuzu")]), as_of())
    root = scratch_path(spark, "jobs")
    store.write_postings(jobs, root, "s1")
    hits = filter_postings(store.read_postings(spark, root), source="lever")
    plan = hits.select("title")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and "description" not in plan
    assert hits.count() == 1


def scans(df):
    """Files scans in the plan that ran."""
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_statistics_scan_the_postings_once(spark):
    from hirelake.operators import stats

    jobs = normalise(raw(spark, [{"source": "lever", "title": f"Engineer {i}", "company": "Acme", "location": "Remote", "description": "sql",
                                  "job_url": f"https://x.ex/{i}"} for i in range(4)]), as_of())
    stored = cut_lineage(jobs)
    assert scans(stats.kpi_cards(stored)) == 1 and scans(stats._counted(stored, "arrival")) == 1
    assert {r["card"]: r["value"] for r in stats.kpi_cards(stored).collect()} == {
        "tracked_jobs": "4", "remote_roles": "4", "top_source": "lever", "hot_skill": "sql"}
    none = stats.posting_stats(stored.filter("false")).collect()
    assert sorted((r["metric"], r["rank"], r["count"]) for r in none) == [("remote_jobs", 1, 0), ("total_jobs", 1, 0)]
    assert {r["card"]: r["value"] for r in stats.kpi_cards(stored.filter("false")).collect()} == {
        "tracked_jobs": "0", "remote_roles": "0", "top_source": "n/a", "hot_skill": "awaiting data"}


def test_a_very_long_tag_is_read(spark):
    from hirelake.operators.crawl import page_links

    rows = [(1, "https://x.ex/", '<a href="/one" ' + "data-x " * 150_000 + 'title="a>b">One</a> <a href="/two">Two</a>'),
            (2, "https://x.ex/", "<a " * 20_000), (3, "https://x.ex/", None)]
    got = page_links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["href"], r["text"]) for r in got) == [(1, "/one", "One"), (1, "/two", "Two")]


def test_json_ld_of_any_depth(spark):
    from hirelake.sources import jsonld

    item = '{"@type":"JobPosting","title":"Cook [a]","skills":["x",["y"]]}'
    pages = ["[" * n + item + "]" * n for n in (0, 1, 8, 40)] + ['{"@graph":[' * n + item + "," + item + "]}" * n for n in (1, 8)]
    pages += ['[[{"@graph":[[' + item + ']]}], {"@type":"Other"}, ' + item + "]", "{broken", '"text ]]] [[["', "[]"]
    rows = [(i, f'<script type="application/ld+json">{p}</script>') for i, p in enumerate(pages)] + [(len(pages), "no script"), (len(pages) + 1, None)]
    df = spark.createDataFrame(rows, "n int, html string").select("n", jsonld.job_postings(F.col("html")).alias("p"))
    got = [r["k"] for r in df.select("n", F.size(F.coalesce("p", F.array().cast("array<variant>"))).alias("k")).orderBy("n").collect()]
    assert got == [1, 1, 1, 1, 2, 2, 2, 0, 0, 0, 0, 0]


def test_only_linked_detail_pages_are_parsed(spark):
    listing = '<ul><li><a href="/job/clerk-1">Clerk one at Firm</a><p>based in Lagos</p></li></ul>'
    lists = spark.createDataFrame([(0, "https://www.myjobmag.com/jobs", listing)], "seq bigint, url string, html string")
    page = "<main><h1>Clerk</h1><p>Job Type Contract</p><p>Description</p><p>Text</p></main>"
    pages = spark.createDataFrame([(f"https://www.myjobmag.com/job/clerk-{i}", page) for i in (1, 1, 2, 3)], "url string, html string")
    board = boards.BOARDS["myjobmag"]
    linked = boards.linked_pages(boards.board_listings(lists, board, as_of()), pages)
    assert [r["url"] for r in linked.collect()] == ["https://www.myjobmag.com/job/clerk-1"]
    [row] = boards.adapt_board(lists, pages, board, as_of()).collect()
    assert (row["title"], row["job_type"], row["location"], row["description"]) == ("Clerk one", "Contract", "Lagos", "based in Lagos")


def test_a_source_of_the_user_and_unknown_sources(spark):
    from hirelake.sources import registry

    landed = spark.createDataFrame([("mine", 0, "o", "Cook"), ("other", 0, "o", "x"), (None, 0, "o", "y")],
                                   "source string, seq bigint, origin string, body string")
    before = dict(registry.ADAPTERS)
    registry.register("mine", lambda part: conform(part.select(
        F.lit("mine").alias("source"), F.col("body").alias("title"), F.lit("Inn").alias("company"), F.lit("https://m.ex/1").alias("job_url"),
        F.col("seq").alias("arrival")), RAW_SCHEMA))
    try:
        rows, errors = registry.collect_raw(landed, as_of(), detail_pages=None)
        assert [(r["source"], r["title"]) for r in rows.filter("source = 'mine'").collect()] == [("mine", "Cook")]
        assert {r["source"] for r in errors.filter("message LIKE 'no adapter%'").collect()} == {"other", None}
    finally:
        registry.ADAPTERS.clear()
        registry.ADAPTERS.update(before)


def test_run_report_is_written(spark):
    from hirelake.plans.ingest import run_report

    landed = spark.createDataFrame([
        ("lever", 0, "acme", "{bad"), ("lever", 1, "beta", '{"id":1}'),
        ("lever", 2, "acme", '[{"id":"L1","text":"Data Engineer","hostedUrl":"https://r.ex/7","categories":{"location":"Lagos"},"createdAt":1700000000000}]'),
        ("weworkremotely", 3, "feed", "<rss><channel><item>"),
    ], "source string, seq bigint, origin string, body string")
    root = scratch_path(spark, "jobs")
    run_ingest(spark, landed, root, "a", as_of(), sources=["weworkremotely", "lever"])
    report = run_report(spark, root, "a")
    assert sorted(r["message"] for r in report.errors.collect()) == [
        "Lever company 'acme' failed: unreadable response", "Lever company 'beta' failed: unexpected shape",
        "WeWorkRemotely feed 'feed' failed: unreadable response"]
    total = report.total.first()
    assert (total["total_collected"], total["total_inserted"], total["total_errors"]) == (1, 1, 3)
    assert total["started_at"] <= total["finished_at"]
    assert {r["source"]: (r["inserted"], r["errors"]) for r in report.sources.collect()} == {"lever": (1, 2), "weworkremotely": (0, 1)}
