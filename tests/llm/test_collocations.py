"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from hirelake.llm import collocations as col

SCHEMA = "doc_id long, text string, lang string"


def plain_counts(rows):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    return f, n


def plain_report(rows, least, top):
    f, n = plain_counts(rows)
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    by_lang = {}
    for (lang, words), a in candidates.items():
        k = len(words)
        score, cut = min((1000 * a * n[lang] // (f[lang, words[:j]] * f[lang, words[j:]]), j) for j in range(1, k))
        inside = any(a2 >= a and len(w2) > k and lang2 == lang and any(w2[i:i + k] == words for i in range(len(w2) - k + 1))
                     for (lang2, w2), a2 in candidates.items())
        if not inside:
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:cut]], f[lang, words[cut:]]))
    out = []
    for lang, found in by_lang.items():
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def documents(seed, n, vocabulary=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "é", "A-b", "<x>"]
    fixed = ["new york city hall park", "New York", "once upon a time", "new york city"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ?!"]))
        rows.append((i, "".join(parts), rng.choice(["en", "de", None])))
    return rows


def found(spark, rows, least, top=2000, schema=SCHEMA):
    return sorted(tuple(r) for r in col.collocations(spark.createDataFrame(rows, schema), least, top).collect())


@pytest.mark.parametrize("bits", [22, 4])
def test_report_equals_plain_counts(spark, bits):
    rows = documents(bits, 150)
    docs = spark.createDataFrame(rows, SCHEMA)
    counted = col.frequent_phrases(col.word_blocks(docs, 300), 10, bits)
    f, _ = plain_counts(rows)
    assert {(r["lang"], r["phrase"]): r["n"] for r in counted.collect()} == {(lang, " ".join(p)): a for (lang, p), a in f.items() if a >= 10}
    got = found(spark, rows, 10, 40)
    assert got == plain_report(rows, 10, 40)
    assert any(len(r[2].split()) == 5 for r in got)


def test_a_phrase_frequent_only_in_the_last_shard_is_counted_whole(spark):
    rows = [(i, "x y z" if i % 4 == 3 else "x y" if i < 8 else "q", "en") for i in range(64)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    counted = col.frequent_phrases(col.word_blocks(df, 1), 12)  # each document is a block, blocks take turns
    got = {(r["phrase"], r["n"]) for r in counted.collect()}
    f, _ = plain_counts(rows)
    assert got == {(" ".join(p), a) for (_, p), a in f.items() if a >= 12}


def test_open_phrases_follow_the_activation_map():
    codes = np.array([1, 2, 3, 0, 1, 2, 3, 0, 1, 2], dtype=np.int64)
    hashes = np.array([11, 22, 33], dtype=np.uint64)
    reached = {k: np.full(1 << col.SLOT_BITS, col.NEVER, np.uint8) for k in range(1, col.LONGEST)}
    only_words = col.open_phrases(codes, hashes, reached, 0)
    assert [(k, c.tolist()) for k, _, c, _ in only_words] == [(1, [3, 3, 2])]
    for h in hashes:
        reached[1][col._slot(col._extend(np.zeros(1, np.uint64), np.array([h], np.uint64)), 1 << col.SLOT_BITS)] = 1
    pairs = col.open_phrases(codes, hashes, reached, 1)
    assert [(k, first.tolist(), c.tolist()) for k, first, c, _ in pairs if k == 2] == [(2, [0, 1], [3, 2])]
    closed = col.open_phrases(codes, hashes, reached, 1 + col.SHARDS)
    assert closed == []


def test_edges(spark):
    assert found(spark, [], 2) == []
    rows = [(None, None, None), (1, "", "en"), (1, "a b. a b", "en"), (1, "a b. a b", "en"), (2, "a b " * 50000, "en"), (3, ".,;:!?\n", "de")]
    assert found(spark, rows, 2) == plain_report(rows, 2, 2000)
    wide = [(*r, 5, "clash") for r in rows]
    assert found(spark, wide, 2, schema=SCHEMA + ", n int, phrase string") == plain_report(rows, 2, 2000)


def test_scores_pass_64_bits(spark):
    frequent = spark.createDataFrame([("en", 1, "a", 10**12), ("en", 1, "b", 3 * 10**12), ("en", 2, "a b", 7 * 10**11)], "lang string, k int, phrase string, n long")
    totals = spark.createDataFrame([("en", 10**14 + 1)], "lang string, n long")
    [row] = col.score_phrases(frequent, totals).collect()
    assert row["score"] == 1000 * 7 * 10**11 * (10**14 + 1) // (10**12 * 3 * 10**12)
