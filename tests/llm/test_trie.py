"""Prefix trie against a dictionary of prefixes, with shards of a few nodes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from hirelake.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_sequences(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain_trie(sequences):
    nodes = {}
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaf = [p for p in below if not any(q[:len(p)] == p and len(q) == len(p) + 1 for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if len(sequences[c]) == len(path))))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaf), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def found(spark, rows, most=trie.SHARD_NODES, schema=SCHEMA):
    got = trie.prefix_trie(*trie.rebuild(spark.createDataFrame(rows, schema)), most)
    assert all(f.dataType.simpleString() in ("bigint", "string") for f in got.schema)
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0], r[1]))


def made(seed, n, texts, longest):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(0, longest) + (c % 20 == 0)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", " ".join(rng.choices(texts, k=rng.randint(0, 3)))))
    return rows


@pytest.mark.parametrize("most", [1, trie.SHARD_NODES])
def test_equals_plain_prefixes_whatever_the_shards(spark, most):
    rows = made(1, 120, ["a", "b c"], 6)
    assert found(spark, rows, most) == plain_trie(plain_sequences(rows))


def test_copies_ends_inside_paths_and_a_common_start(spark):
    rows = []
    for c in range(60):
        for t in range(c % 6 + 1):
            rows.append((c, t, "user", f"same {t}"))
    rows += [(100 + c, t, "user", "one two three") for c in range(30) for t in range(4)]
    for most in (3, 1000):
        assert found(spark, rows, most) == plain_trie(plain_sequences(rows))


def test_long_conversations(spark):
    rows = [(c, t, "user", f"w{t} x") for c in (40, 41, 59) for t in range(1500)] + [(59, 1500, "user", "more"), (7, 0, "user", "w0 x")]
    got = found(spark, rows, 50)
    sequences = plain_sequences(rows)
    nodes = {}
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(map(hash, seq[:d])), []).append(c)
    assert len(got) == len(nodes)
    root = got[0]
    words = lambda p, s: len(s[len(p) - 1][1].split()) if p else 0
    assert root[6] == sum((len(m) - 1) * words(p, sequences[m[0]]) for p, m in nodes.items())


def test_edges(spark):
    assert found(spark, []) == []
    rows = [(None, 0, "user", "no id"), (3, None, None, None), (3, None, "a", "x"), (3, None, "a", "x"), (-1, 5, "user", "negative"),
            (-20, 0, "user", "base of the negative"), (0, 2**40, "user", "é " * 100000), (0, -5, "user", "first\x00"), (19, 1, "r", "")]
    assert found(spark, rows) == plain_trie(plain_sequences(rows))
    wide = [(*r, "extra", 1) for r in rows]
    assert found(spark, wide, schema=SCHEMA + ", key string, depth int") == plain_trie(plain_sequences(rows))


def test_a_text_cannot_pass_for_two(spark):
    rows = [(0, 0, "a", "b:c"), (1, 0, "a:b", "c"), (2, 0, "ab", ":c"), (20, 0, "a", "b"), (20, 1, "a", "b"), (21, 0, "aa", "b")]
    assert found(spark, rows) == plain_trie(plain_sequences(rows))


def test_find_close():
    rng = random.Random(3)
    signs, depth = [], 0
    while len(signs) < 3000 or depth:
        up = depth == 0 or (len(signs) < 3000 and rng.random() < 0.55)
        signs.append(1 if up else -1)
        depth += signs[-1]
    excess = np.cumsum(signs)
    cuts = np.arange(0, len(excess), trie.BLOCK)
    least, most = np.minimum.reduceat(excess, cuts), np.maximum.reduceat(excess, cuts)
    stack = []
    for i, s in enumerate(signs):
        if s == 1:
            stack.append(i)
        else:
            assert trie.find_close(excess, least, most, stack.pop()) == i


def test_query(spark, sf):
    from hirelake.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_conversation_trie"](spark, sf).collect()), key=lambda r: (r[0], r[1]))
    assert got == plain_trie(plain_sequences(rows))
