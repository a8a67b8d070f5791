import random
import re

from hirelake.llm import minhash_dedup as m
from hirelake.llm import queries


def brute(docs, least=0):
    """Components by comparing every pair that shares a shingle."""
    sets, home, root = {}, {}, {}
    for k, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
        sets[k] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        root[k] = k

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in sorted(sets):
        near = {}
        for s in sets[k]:
            for o in home.setdefault(s, []):
                near[o] = near.get(o, 0) + 1
            home[s].append(k)
        for o, c in near.items():
            if 100 * c >= 75 * (len(sets[k]) + len(sets[o]) - c):
                a, b = find(k), find(o)
                root[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in docs}


def compare(rows, docs):
    want = brute(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and len(rows) == len(docs)


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    compare(queries.QUERIES["op7_minhash_dedup"](spark, sf).collect(), docs)


def planted():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    docs = {0: None, 1: "", 2: " \n ", 3: "one two", 4: "ONE  two", 5: "two one", 6: "a b c d e", 7: "a b c d e"}
    base = [rnd.choice(words) for _ in range(120)]
    for k in range(100, 190):  # one group of near copies, each changed in one or two places
        w = list(base)
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        docs[k] = " ".join(w)
    w = [rnd.choice(words) for _ in range(100)]
    for k in range(200, 230):  # a chain whose ends are far apart
        w = w[3:] + [rnd.choice(words) for _ in range(3)]
        docs[k] = " ".join(w)
    shared = [rnd.choice(words) for _ in range(60)]
    for k in range(300, 360):  # a passage in otherwise different texts
        docs[k] = " ".join([rnd.choice(words) for _ in range(60)] + shared)
    return docs


def test_planted(spark, monkeypatch):
    docs = planted()
    df = spark.createDataFrame([(k, t, 1) for k, t in docs.items()], "doc_id long, text string, root int")
    compare(m.near_duplicates(df).collect(), docs)
    monkeypatch.setattr(m, "PAIRS_PER_ROW", 0)  # pivots first, whatever the size
    monkeypatch.setattr(m, "THICK", 0)
    monkeypatch.setattr(m, "PIVOT_ROUNDS", 2)
    compare(m.near_duplicates(df).collect(), docs)
    kept = m.keep_first(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, (_, c) in brute(docs).items() if k == c}


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in m.near_duplicates(df).collect())
    assert got[1:] == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert m.near_duplicates(df.limit(0)).collect() == []
    assert m.keep_first(df.limit(0)).collect() == []


def test_posterior_bound():
    fewest = m.fewest_matches()
    assert sorted(fewest) == [32, 64, 96, 128] and all(0.3 * n < k < 0.75 * n for n, k in fewest.items())


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rnd.randrange(50), 100 + rnd.randrange(50)) for _ in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in m.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}


def test_thick_buckets(spark, monkeypatch):
    """Edited copies of one text, many of them far from each other, some shortened: rare shingles name the pairs."""
    rnd = random.Random(9)
    base = [f"b{rnd.randrange(300)}" for _ in range(150)]
    docs = {}
    for k in range(400):
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(1000)}"
        docs[k] = " ".join(w[rnd.choice([0, 0, 0, 12, 25]):])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    monkeypatch.setattr(m, "PIVOT_ROUNDS", 0)
    compare(m.near_duplicates(df).collect(), docs)


def test_keep_first_judges_rows(spark):
    """Repeated ids do not carry each other away, and repeated rows and NULL ids keep one row of a group."""
    one, two, three, four = (" ".join(f"{name}{i}" for i in range(60)) for name in "abcd")
    rows = [(1, one), (2, one), (2, two), (3, three), (3, three), (None, four), (None, four), (None, three), (None, None), (4, "")]
    kept = m.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, one), (2, two), (3, three), (None, four), (None, None), (4, "")]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_joins_are_planned_by_rows_in_memory(spark):
    """Links compress to a few bytes a row; a broadcast of them, which the driver holds, takes many times that."""
    spark.conf.unset("spark.sql.sources.fileCompressionFactor")
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2}") for i in range(6)], "doc_id long, text string")
    assert sorted(r.component_id for r in m.near_duplicates(docs).collect()) == [0, 0, 2, 2, 4, 4]
    nodes = 50_000
    links = m.stored(spark.range(nodes).selectExpr("id AS node", "id DIV 4 * 4 AS root"))
    assert int(str(links._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 24 * nodes
