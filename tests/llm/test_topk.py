import math
import random
import re

import pytest
from pyspark.sql import functions as F

from hirelake.llm import topk_search


def brute(rows, asked, k):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in fine:
        if asked(q):
            best = {}
            for i, v in fine:
                if i != q and len(v) == len(a):
                    s = sum(x * y for x, y in zip(a, v))
                    best[i] = max(best.get(i, s), s)
            for rank, (s, i) in enumerate(sorted(((-s, i) for i, s in best.items()))[:k], 1):
                out.add((q, rank, i, -s))
    return out


@pytest.mark.parametrize("block,depth", [(4096, 32), (16, 2)])
def test_against_brute_force(spark, monkeypatch, block, depth):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk_search, "FIRST_DEPTH", depth)
    rnd = random.Random(block)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [0.5, 0.25, 0.0, 0.0, 0.1, -0.3]) for i in range(40)]  # ties
    rows += [(300, None), (None, [1.0] * 6), (310, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (320, [float("nan")] * 6),
             (330, [float("inf")] + [0.0] * 5), (340, [0.0] * 6), (350, [1.0, 2.0]), (360, [3.0, -1.0]), (370, []), (380, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = {tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 10 == 0).collect()}
    assert got == brute(rows, lambda i: i % 10 == 0, 5)


def test_huge_components_and_empty(spark):
    rows = [(0, [1e9, 3.0]), (1, [2e9, 1.0]), (2, [2e9, 2.0]), (3, [-1e9, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in topk_search.top_k(df, F.col("vec_id") == 0, 2).orderBy("rank").collect()]
    assert [v for _, v in got] == [1, 2]
    assert topk_search.top_k(df.limit(0), F.col("vec_id") == 0).collect() == []


def test_pairs_of_blocks_are_not_moved(spark, monkeypatch):
    """More pairs of blocks than blocks: nothing of them is broadcast, shuffled or sorted."""
    monkeypatch.setattr(topk_search, "BLOCK", 8)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk_search, "QUERY_BLOCKS", 3)
    monkeypatch.setattr(topk_search, "TOGETHER", 1)
    plans = []

    def kept(df, *rest, store=topk_search.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, *rest)

    monkeypatch.setattr(topk_search, "stored", kept)
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk_search.top_k(df, F.col("vec_id") % 4 == 0)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {tuple(r) for r in found.collect()} == brute(rows, lambda i: i % 4 == 0, 5)
    assert any("CartesianProduct" in p for p in plans)
    assert not any("vectors" in line and re.search("Exchange|Sort|Broadcast", line) for p in plans for line in p.splitlines())
