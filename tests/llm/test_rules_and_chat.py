"""Quality rules and chat windows: planted cases, edge cases, and both queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from hirelake.llm import chat_windows as chat
from hirelake.llm import quality_rules as rules
from hirelake.llm import queries

DOCS = "doc_id long, text string, source string, kept string, host string"


def prose(n, words=60):
    return " ".join(f"word{n}x{i}" for i in range(words))



def documents(spark):
    rows = []
    for i in range(60):  # two ordinary hosts
        rows.append((i, prose(i), f"good{i % 2}", "clash", "clash"))
    for i in range(100, 160):  # a host most of whose documents fail
        rows.append((i, "too short" if i % 4 else prose(i), "bad", None, None))
    junk = prose(200) + " " + "#" * 40
    half = prose(201) + " " + "#" * 20  # breaks the symbol rule at half its limit only
    rows += [(200, junk, "good0", "a", "b"), (201, half, "good0", "a", "b"), (202, half, "bad", "a", "b"), (203, None, "bad", "a", "b"),
             (204, "", None, "a", "b"), (205, prose(205), None, "a", "b"), (205, prose(205), None, "a", "b"), (None, prose(206), "good1", None, None),
             (207, "same line\n" * 30 + prose(207).replace(" ", "\n"), "good1", "a", "b"), (208, prose(208, 40_000), "good1", "a", "b")]
    return spark.createDataFrame(rows, DOCS)


def test_hosts_and_rules_decide(spark):
    df = documents(spark)
    got = rules.quality_rules(df)
    kept = {r.doc_id: r.kept for r in got.collect()}
    strict = {r.doc_id for r in got.filter("host_strict").collect()}
    assert strict == set(range(100, 160)) | {202, 203}
    assert not kept[200] and kept[201] and not kept[202]  # the symbol rule by itself; the host verdict at half the limit
    assert not kept[203] and not kept[204] and kept[205] and kept[None] and kept[208]
    assert all(kept[i] for i in range(60)) and all(kept[i] == (i % 4 == 0) for i in range(100, 160))
    assert got.count() == df.count()


def test_kept_rows_keep_their_columns(spark):
    df = documents(spark)
    good = rules.keep_good(df)
    assert good.columns == df.columns and good.filter("doc_id = 205").count() == 2
    assert rules.keep_good(df.limit(0)).count() == 0 and rules.quality_rules(df.limit(0)).count() == 0


@pytest.fixture()
def tables(spark, tmp_path):
    # The SQL repeats a text for each of its words, so the very long one stays out.
    documents(spark).filter("doc_id <> 208").dropDuplicates(["doc_id"]).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    conversations(spark).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return con, str(tmp_path)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_chat_windows"])
def test_queries_against_sql(spark, tables, name):
    con, folder = tables
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, folder).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def conversations(spark):
    rows = [(1, 0, "system", "be kind " * 20), (2, 0, "system", "many rules " * 1500), (3, None, None, None), (4, 0, "user", "<|im_end|> <\\|x"),
            (5, 0, "assistant", "long " * 5000), (6, 1, "us\ner", "a"), (6, 1, "us\ner", "a")]
    for c in (1, 2):
        rows += [(c, t, "assistant" if t % 2 else "user", f"turn {t} " + "and more " * (t * 7 % 90)) for t in range(1, 60)]
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string")


def test_windows_keep_the_budget(spark):
    windows = chat.chat_windows(conversations(spark)).collect()
    room = 2 * chat.HALF
    for r in windows:
        new = [s for s in r.segments if not s.repeated]
        assert r.tokens <= chat.BUDGET or len(new) == 1
    assert max(r.tokens for r in windows if r.conv_id == 1) <= chat.BUDGET
    assert [r.tokens <= chat.BUDGET for r in sorted(windows, key=lambda r: r.window) if r.conv_id == 2][1:].count(False) == 0
    # the short system turn comes again in every later window, the long one in none
    assert all(r.text.startswith("<|im_start|>system\nbe kind") for r in windows if r.conv_id == 1)
    assert sum("many rules" in r.text for r in windows if r.conv_id == 2) == 1
    assert room + chat.HISTORY + chat.SYSTEM <= chat.BUDGET


def test_windows_read_back(spark):
    df = conversations(spark)
    turns = chat.read_back(chat.chat_windows(df)).select("conv_id", "window", F.posexplode("turns").alias("i", "t")).select("conv_id", "window", "i", "t.*")
    got = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.window, r.i)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r.conv_id, -1 if r.turn is None else r.turn)):
        want.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert got == want
    assert chat.chat_windows(df.limit(0)).count() == 0
