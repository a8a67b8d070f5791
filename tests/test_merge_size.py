"""What a merge moves: small keys in one piece, whole rows only where they are needed, no join of the input with itself."""

import random

from pyspark.sql import functions as F
from sequential_model import replay
from test_merge import compare, make_posting, to_df

from hirelake.functions import urls
from hirelake.functions.text import distinct_lower
from hirelake.operators import merge, running
from hirelake.plans import job_queries


def test_only_crowded_keys_are_cut(spark):
    df = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 100).alias("k"), F.col("id").alias("o"),
        F.when(F.col("id") % 4 < 3, F.col("id")).alias("v"))
    kinds = {"a": ("first", F.col("v")), "b": ("last", F.col("v")), "c": ("sum", F.col("v")), "d": ("max", F.col("v")),
             "e": ("bit_or", F.col("v")), "f": ("min", F.col("v"))}
    want = running.running_before(df, "k", "o", kinds, 30)
    hot = running.crowded(df, "k", 5)
    assert len(hot) == 1 and running.crowded(df, "k", 10) == []
    for known in (hot, []):
        got = running.running_before(df, "k", "o", kinds, 5, hot=known)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert "Join" not in running.running_before(df, "k", "o", kinds, 5, hot=[])._jdf.queryExecution().optimizedPlan().toString()


def test_whole_rows_are_taken_only_of_leading_and_filling_rows(spark, monkeypatch):
    rng = random.Random(3)
    rows = [make_posting(rng, i, ids=6, urls=6, titles=6) for i in range(120)]
    written, write = [], merge.cut_lineage

    def spy(df):
        out = write(df)
        if "description_html" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(merge, "cut_lineage", spy)
    records = replay([], rows)[0]
    got = merge.merge_postings(to_df(spark, rows), materialise=False).postings
    assert got.count() == len(records) < 40
    # One leading row a record, and at most one for each blank field that some other row fills.
    blanks = sum(1 for r in records for f in (*merge.PICKED, "salary_min", "salary_max") if r[f] not in (None, "", "unknown"))
    assert sum(written) < len(rows) and sum(written) <= len(records) + blanks


def test_arrivals_far_apart_are_numbered_by_rank(spark):
    rng = random.Random(8)
    rows = [make_posting(rng, i, ids=9, urls=9, titles=9) for i in range(20)]
    far = to_df(spark, rows).withColumn("arrival", F.col("arrival") * (1 << 30) - (1 << 33))
    numbered, repeats = merge._numbered(merge._control(far.withColumn("_stored", F.lit(False))))
    assert not repeats and numbered.agg(F.max("t") - F.min("t")).first()[0] == 19


def test_input_is_not_joined_with_itself(spark, tmp_path):
    orders = spark.range(30).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 4).alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
        F.lit("2024-01-01").cast("timestamp").alias("o_orderdate"))
    orders.write.parquet(f"{tmp_path}/a/orders.parquet")
    once = job_queries._order_postings(spark, f"{tmp_path}/a")
    assert once.count() == 30 and "Join" not in once._jdf.queryExecution().optimizedPlan().toString()
    orders.unionByName(orders.filter("o_orderkey < 2")).unionByName(
        orders.limit(1).withColumn("o_orderkey", F.lit(None).cast("bigint"))).write.parquet(f"{tmp_path}/b/orders.parquet")
    got = job_queries._order_postings(spark, f"{tmp_path}/b").groupBy("arrival").count().collect()
    assert {r["arrival"]: r["count"] for r in got} == {k: 4 if k < 2 else 1 for k in range(30)}


def _orders(spark, path, n=60):
    spark.range(n).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 6).alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
        F.lit("2024-01-01").cast("timestamp").alias("o_orderdate")).write.parquet(f"{path}/orders.parquet")


def _spied(monkeypatch, module, column, written):
    write = module.cut_lineage

    def spy(df):
        out = write(df)
        if column in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(module, "cut_lineage", spy)


def test_rows_that_come_from_a_table_are_not_copied_whole(spark, tmp_path, monkeypatch):
    _orders(spark, tmp_path)
    written = []
    _spied(monkeypatch, merge, "description_html", written)
    _spied(monkeypatch, job_queries, "description_html", written)
    assert job_queries.merge_sequential(spark, str(tmp_path)).count() == 6
    assert sum(written) <= 12


def test_facts_are_written_once_and_no_changes_are_looked_for(spark, monkeypatch):
    rng = random.Random(5)
    rows = [make_posting(rng, i, ids=5, urls=5, titles=5) for i in range(80)]
    for r in rows:
        r["title"], r["company"] = "Role", "Acme"
    written = []
    _spied(monkeypatch, merge, "signatures", written)
    monkeypatch.setattr(merge, "_changes", lambda *a: 1 / 0)
    done = merge.merge_postings(to_df(spark, rows), materialise=False)
    assert 0 < done.postings.count() < 80
    # The control columns, the rows with their first guess, and the same judged.
    assert written.count(80) == 3


def test_plain_addresses_and_repeated_items_are_left_as_the_long_way_leaves_them(spark, monkeypatch):
    odd = ["https://c.example/1", "https://c.example/a/b-c_d~", "https://c.example/", "https://c.example", "https://c.example/a//", "https://C.example/a",
           "HTTPS://c.example/a", "https://c.example/a;b=1", "https://c.example/a;b/c", "https://c.example/a?jobid=1", "https://c.example/a#x", " https://c.example/a ",
           "https://c.example/a b", "https://c.example/a\n", "https://u@c.example:80/a", "https://c.example//a", "//c.example/a", "mailto:a/b", "c.example/a", "", None,
           "https://c.exämple/a", "https://c.example/ä", "https:///a", "https://c.example/a%20b&c=d"]
    df = spark.createDataFrame([(u,) for u in odd], "u string")
    quick = [r[0] for r in df.select(urls.canonical_url(F.col("u"))).collect()]
    matched = df.filter(F.col("u").rlike(urls._CANONICAL)).count()
    monkeypatch.setattr(urls, "_CANONICAL", "(?!)")
    assert quick == [r[0] for r in df.select(urls.canonical_url(F.col("u"))).collect()] and matched == 4
    lists = spark.sql("SELECT array('A', ' a', null, 'b  c', 'A', '', 'B c', ' ') AS s")
    assert lists.select(distinct_lower(F.col("s"))).first()[0] == ["a", "b c"]
