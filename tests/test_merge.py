import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from sequential_model import replay, score

from hirelake.operators import merge, running
from hirelake.schema import POSTING_SCHEMA

T0 = datetime(2024, 1, 1)


def make_posting(rng, n, ids=4, urls=4, titles=3):
    pick = rng.choice
    skills = rng.sample(["python", "sql", "aws", "git", "excel", "java", "go"], rng.randint(0, 4))
    r = {
        "id": f"id{n}", "source": pick(["lever", "fuzu", "ashby"]),
        "source_job_id": pick([None, *(f"J{i}" for i in range(ids))]),
        "title": f"Role {rng.randrange(titles)}", "company": pick(["Acme", "Unknown company", "Beta"]),
        "location": pick(["Kenya", "Berlin", "Unspecified"]), "location_city": pick([None, "Nairobi", "Accra"]),
        "location_region": pick([None, "R1", "R2"]), "location_country": pick([None, "Kenya", "Ghana"]),
        "workplace_type": pick(["unknown", "remote"]), "source_type": "scraped",
        "source_website": pick(["", "a.example"]), "job_type": pick(["unknown", "contract", "full-time"]),
        "experience_level": pick(["unknown", "senior"]), "description": pick(["", f"text {n}"]),
        "description_html": pick(["", f"<p>{n}</p>"]),
        "description_sections": [{"heading": f"H{n}", "items": ["x"]}] * rng.randint(0, 3),
        "skills": skills, "tags": skills, "salary_text": None, "salary_min": None, "salary_max": None,
        "salary_currency": None, "salary_interval": None,
        "posted_at": T0 + timedelta(days=rng.randrange(5)), "scraped_at": T0 + timedelta(days=rng.randrange(5)),
        "discovered_at": T0 + timedelta(days=rng.randrange(5)),
    }
    url = f"https://x.example/{rng.randrange(urls)}"
    r["job_url"] = r["apply_url"] = r["canonical_url"] = pick([url, url, url, ""])
    if rng.random() < 0.4:
        r["salary_text"], r["salary_min"], r["salary_max"] = "1 - 2", float(rng.randrange(3)), pick([None, 9.0])
    r["aggregated_sources"] = [r["source"]]
    r["quality_score"] = score(r)
    return r


def to_df(spark, rows, start=0):
    names = POSTING_SCHEMA.names
    data = [(*[r[n] for n in names], start + i) for i, r in enumerate(rows)]
    from pyspark.sql import types as T

    schema = T.StructType([*POSTING_SCHEMA.fields, T.StructField("arrival", T.LongType())])
    return spark.createDataFrame(data, schema)


def plain(rows):
    def freeze(v):
        if isinstance(v, dict):
            return tuple(sorted((k, freeze(x)) for k, x in v.items()))
        if isinstance(v, (list, tuple)):
            return tuple(freeze(x) for x in v)
        return v

    return sorted(repr(freeze({k: r[k] for k in POSTING_SCHEMA.names})) for r in rows)


def compare(spark, existing, incoming):
    want, report = replay(existing, incoming)
    old = to_df(spark, existing) if existing else None
    got = merge.merge_postings(to_df(spark, incoming, len(existing)), old)
    rows = [r.asDict(recursive=True) for r in got.postings.collect()]
    assert plain(rows) == plain(want)
    counts = {r["source"]: {k: r[k] for k in ("collected", "inserted", "updated", "deduplicated")}
              for r in got.report.collect()}
    assert counts == report


@pytest.mark.parametrize("seed,n,existing,wide", [
    (2, 40, 0, False), (4, 150, 20, True)])
def test_set_based_merge_equals_row_by_row(spark, seed, n, existing, wide, monkeypatch):
    # Tiny ranges, so that every key spans several of them.
    monkeypatch.setattr(running.running_before, "__defaults__", (2,))
    rng = random.Random(seed)
    sizes = {"ids": n // 2, "urls": n // 2, "titles": n // 4} if wide else {}
    rows = [make_posting(rng, i, **sizes) for i in range(n + existing)]
    compare(spark, rows[:existing], rows[existing:])


def test_hot_signature(spark):
    rng = random.Random(9)
    rows = [make_posting(rng, i, ids=40, urls=60, titles=50) for i in range(150)]
    for r in rows[::3]:
        r["source"], r["source_job_id"], r["aggregated_sources"] = "lever", "engineer", ["lever"]
    for r in rows:
        r["quality_score"] = score(r)
    compare(spark, [], rows)


def test_existing_rows_with_one_id_collapse_to_the_last(spark):
    rng = random.Random(5)
    old = [make_posting(rng, i, ids=30, urls=30, titles=30) for i in range(8)]
    old[5]["id"] = old[1]["id"]
    compare(spark, old, [make_posting(rng, 100 + i, ids=30, urls=30, titles=30) for i in range(20)])


def test_merging_the_same_batch_again_inserts_nothing(spark):
    rng = random.Random(11)
    batch = [make_posting(rng, i) for i in range(8)]
    for i, r in enumerate(batch):
        r["canonical_url"] = r["job_url"] = f"https://x.example/{i}"
        r["source_job_id"], r["title"] = f"J{i}", f"Role {i}"
    again = merge.merge_postings(to_df(spark, batch, 100), to_df(spark, batch))
    assert again.report.agg(F.sum("inserted")).first()[0] == 0


def test_running_before_matches_plain_windows(spark):
    df = spark.range(300).select(
        (F.col("id") % 3).alias("k"), F.col("id").alias("o"),
        F.when(F.col("id") % 4 == 0, F.col("id")).alias("v"))
    specs = {"a": ("first", F.col("v")), "b": ("last", F.col("v")), "c": ("sum", F.col("v")),
             "d": ("max", F.col("v")), "e": ("bit_or", F.col("v"))}
    small = running.running_before(df, "k", "o", specs, bucket_bits=3)
    large = running.running_before(df, "k", "o", specs, bucket_bits=30)
    assert small.exceptAll(large).count() == 0 and large.exceptAll(small).count() == 0


def test_components_and_canonical_merge_ignore_row_order(spark):
    rng = random.Random(21)
    rows = [make_posting(rng, i, ids=30, urls=30, titles=40) for i in range(60)]
    df = to_df(spark, rows)
    got = merge.merge_canonical(df)
    other = merge.merge_canonical(df.repartition(7).orderBy(F.desc("title")))
    assert got.exceptAll(other).count() == 0 and got.count() == other.count()
    # Union-find over the same signatures gives the number of groups.
    from sequential_model import signatures

    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    owner = {}
    for i, r in enumerate(rows):
        for s in signatures(r):
            j = owner.setdefault(s, i)
            parent[find(i)] = find(j)
    assert got.count() == len({find(i) for i in range(len(rows))})
