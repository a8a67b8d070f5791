from hirelake.llm import warc_revisits as w


def test_revisits(spark):
    rows = [
        (1, "http://A.org/x/", 1, 200, "e1", None, {"Date": "1", "Server": "s"}), (2, "https://a.org/x#top", 2, 304, "W/e1", None, {"date": "2", "X": "no"}),
        (3, "http://a.org/x", 3, 200, "e2", "m", None), (4, "http://a.org/x", 4, 304, "e1", None, None), (5, "http://a.org/x", 5, 304, None, "m", {"ETag": "e2"}),
        (6, "http://b.org", 6, 304, "e", None, None), (7, None, 7, 304, "e", None, None), (8, "http://a.org/x", None, 304, "e2", None, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>")
    for bits in (0, 1, 18):
        got = {r.record_id: (r.origin_id, r.state, r.headers) for r in w.resolve_revisits(df, bits).collect()}
        assert got == {2: (1, "resolved", {"Server": "s", "date": "2"}), 4: (3, "mismatch", None), 5: (3, "resolved", {"ETag": "e2"}),
                       6: (None, "no_origin", None), 7: (None, "no_origin", None), 8: (None, "no_origin", None)}
    assert w.resolve_revisits(df.limit(0)).collect() == []


SCHEMA = "record_id long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>, key string"


def test_ties_repeated_rows_and_states(spark):
    rows = [(5, "http://a.org", 1, 200, "old", None, {"A": "5"}, "x"), (7, "http://a.org", 1, 200, "new", None, {"A": "7"}, "x"),
            (6, "http://a.org", 1, 200, "mid", None, None, "x"), (9, "http://a.org", 1, 304, "new", None, None, "x"),  # same time: not earlier
            (8, "http://a.org", 2, 304, "new", None, None, "x"), (8, "http://a.org", 2, 304, "new", None, None, "x"),
            (1, "http://a.org", 3, 500, "new", None, None, "x"), (2, "http://a.org", 900, 304, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for bits in (0, 4, 18):
        got = sorted((r.record_id, r.origin_id, r.state, r.headers) for r in w.resolve_revisits(df, bits).collect())
        assert got == [(2, 7, "mismatch", None), (8, 7, "resolved", {"A": "7"}), (8, 7, "resolved", {"A": "7"}), (9, None, "no_origin", None)]


def test_query_against_its_sql(spark, sf):
    import duckdb

    from hirelake.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    sf = sf.replace("sf0.001", "sf0.01")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(con.execute(ORACLES["op6_warc_revisits"]).fetchall(), key=str)
    got = sorted(map(tuple, QUERIES["op6_warc_revisits"](spark, sf).collect()), key=str)
    assert got == want
    assert {r[2] for r in got} == {"resolved", "mismatch", "no_origin"}
