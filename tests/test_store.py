"""The posting table: batches against the row-by-row model, replays, pruned look-ups, full commits, pages."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from sequential_model import replay, score
from test_merge import make_posting, plain, to_df

from hirelake.operators.ordering import page_postings, store_order
from hirelake.session import scratch_path
from hirelake.sources import store


def batch_of(rng, start, n, **sizes):
    rows = [make_posting(rng, start + i, **sizes) for i in range(n)]
    for i, r in enumerate(rows):  # no ties in stored order
        r["scraped_at"] += timedelta(seconds=start + i)
        r["quality_score"] = score(r)
    return rows


def apart(rows):
    """The same rows, no two of which share a signature."""
    for r in rows:
        n = r["id"]
        r["source_job_id"], r["title"] = f"J{n}", f"Role {n}"
        r["job_url"] = r["apply_url"] = r["canonical_url"] = f"https://x.example/{n}"
        r["quality_score"] = score(r)
    return rows


def stored(rows):
    return sorted(rows, key=lambda r: (r["posted_at"], r["quality_score"], r["scraped_at"]), reverse=True)


def counts(report):
    return {r["source"]: {k: r[k] for k in ("collected", "inserted", "updated", "deduplicated")} for r in report.collect()}


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_batches_equal_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_ROWS", 7)  # many ranges and buckets, and full commits on the way
    rng, root = random.Random(2), scratch_path(spark, "table")
    model, start = [], 0
    for name, n in (("a", 60), ("b", 3), ("c", 25)):
        rows = batch_of(rng, start, n, ids=40, urls=40, titles=30)
        start += n
        model, want = replay(stored(model), rows)
        assert counts(store.merge_into(spark, root, name, to_df(spark, rows, start))) == want
        assert plain(rows_of(store.read_postings(spark, root))) == plain(model)
    table = store.read_postings(spark, root)
    assert table.select("arrival").distinct().count() == table.count()
    names = [n for n in store.snapshots(spark, root) if not n.endswith(store.FULL)]
    assert names == ["a", "b", "c"] and any(n.endswith(store.FULL) for n in store.snapshots(spark, root))


def test_a_batch_run_again_replaces_its_own_commit(spark):
    rng, root = random.Random(3), scratch_path(spark, "table")
    first, second = apart(batch_of(rng, 0, 30)), apart(batch_of(rng, 24, 12))  # six of them known
    store.merge_into(spark, root, "1", to_df(spark, first))
    report = counts(store.merge_into(spark, root, "2", to_df(spark, second)))
    table = plain(rows_of(store.read_postings(spark, root)))
    assert counts(store.merge_into(spark, root, "2", to_df(spark, second))) == report
    assert plain(rows_of(store.read_postings(spark, root))) == table and store.snapshots(spark, root) == ["1", "2"]
    assert plain(rows_of(store.read_postings(spark, root, "1"))) == plain(replay([], first)[0])


def read_by(df):
    """Files and rows that the scans of a collected frame have read."""
    df.collect()
    files = rows = 0
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        if metrics.contains("numFiles"):
            files += metrics.apply("numFiles").value()
            rows += metrics.apply("numOutputRows").value()
    return files, rows


def test_a_small_batch_reads_as_much_of_a_table_ten_times_larger(spark, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_ROWS", 40)
    rng, seen = random.Random(4), {}
    small = apart(batch_of(rng, 10_000, 2))
    for n in (200, 2000):
        root = scratch_path(spark, "table")
        rows = apart(batch_of(rng, 0, n))
        rows[0] = {**small[0], "id": "known"}
        store.write_postings(to_df(spark, rows), root, "0")
        found = store.lookup(spark, root, store.history(spark, root), to_df(spark, small))
        assert [r["id"] for r in found.select("id").collect()] == ["known"]
        seen[n] = read_by(found)
    assert seen[2000][1] <= 2 * max(seen[200][1], store.BUCKET_ROWS)
    assert seen[2000][0] <= seen[200][0] + 3


def test_pages_read_their_ranges_only(spark, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_ROWS", 20)
    root = scratch_path(spark, "table")
    rows = apart(batch_of(random.Random(5), 0, 150))
    store.write_postings(to_df(spark, rows), root, "0")
    for offset, limit in ((0, 10), (35, 10), (140, 50), (500, 5)):
        got = store.page_of_table(spark, root, offset, limit)
        want = page_postings(store.read_postings(spark, root), offset, limit)
        assert [r["id"] for r in got.collect()] == [r["id"] for r in want.collect()]
    files, read = read_by(store.page_of_table(spark, root, 35, 10))
    # Two ranges of three sources; the sort reads them once more to find its bounds.
    assert read <= 2 * 40 and files <= 2 * 6
    store.merge_into(spark, root, "1", to_df(spark, apart(batch_of(random.Random(6), 900, 2))))
    with pytest.raises(ValueError):
        store.page_of_table(spark, root)
    store.compact(spark, root, "2")
    assert [r["id"] for r in store.page_of_table(spark, root, 3, 4).collect()] == [
        r["id"] for r in store_order(store.read_postings(spark, root)).offset(3).limit(4).collect()]


def test_old_commits_go_and_the_table_stays(spark):
    rng, root = random.Random(7), scratch_path(spark, "table")
    for i in range(2):
        store.merge_into(spark, root, f"{i}", to_df(spark, apart(batch_of(rng, 10 * i, 15))))
    before = plain(rows_of(store.read_postings(spark, root)))
    assert store.expire(spark, root) == []
    store.compact(spark, root, "1" + store.FULL)
    assert store.expire(spark, root) == ["0", "1"]
    assert store.snapshots(spark, root) == ["1" + store.FULL]
    assert plain(rows_of(store.read_postings(spark, root))) == before


def test_empty_batches_and_tables(spark):
    root = scratch_path(spark, "table")
    assert store.read_postings(spark, root) is None and store.history(spark, root) == []
    none = to_df(spark, [])
    assert store.merge_into(spark, root, "0", none).count() == 0
    assert store.read_postings(spark, root).count() == 0
    rows = apart(batch_of(random.Random(8), 0, 4))
    store.merge_into(spark, root, "1", to_df(spark, rows))
    store.merge_into(spark, root, "2", none)
    assert plain(rows_of(store.read_postings(spark, root))) == plain(replay([], rows)[0])


def test_stream_in_micro_batches_equals_the_batches(spark, tmp_path):
    from hirelake.streaming.ingest import ingest_stream
    from test_jobs import as_of, raw

    rows = [{"source": ("lever", "remoteok")[i % 2], "title": f"Engineer {i % 7}", "company": "Acme", "location": "Lagos",
             "description": f"text {i}", "job_url": f"https://x.ex/{i % 9}", "posted_text": f"2024-02-{i % 20 + 1:02d}"} for i in range(36)]
    df = raw(spark, rows)
    for part in range(3):
        df.filter(F.col("arrival").between(12 * part, 12 * part + 11)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    root = str(tmp_path / "table")
    ingest_stream(stream, root, str(tmp_path / "progress"), as_of()).awaitTermination()
    assert len([n for n in store.snapshots(spark, root) if not n.endswith(store.FULL)]) == 3
    from hirelake.operators.merge import merge_postings
    from hirelake.plans.ingest import prepare

    at_once = merge_postings(prepare(df, as_of())).postings
    show = lambda t: sorted((r["canonical_url"], sorted(r["aggregated_sources"]), r["posted_at"]) for r in t.collect())
    assert show(store.read_postings(spark, root)) == show(at_once)
