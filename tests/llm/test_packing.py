import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from hirelake.llm import bpe, packing, queries


def optimum(lengths, capacity):
    """Fewest bins, by trying every set for the largest item."""
    if not lengths:
        return 0
    first, rest = lengths[0], lengths[1:]
    best = len(lengths)
    for n in range(min(len(rest), 4) + 1):
        for some in set(itertools.combinations(rest, n)):
            if first + sum(some) <= capacity:
                left = Counter(rest) - Counter(some)
                best = min(best, 1 + optimum(sorted(left.elements(), reverse=True), capacity))
    return best


def test_reduction_keeps_the_optimum():
    rnd = random.Random(5)
    reduced = 0
    for _ in range(120):
        capacity = rnd.choice([10, 14, 20])
        lengths = sorted((rnd.randint(2, capacity) for _ in range(rnd.randint(1, 8))), reverse=True)
        items = packing._Lengths(Counter(lengths))
        fixed = packing.reduce_lengths(items, capacity)
        reduced += sum(t for t, _ in fixed)
        rest = sorted(Counter(items.n).elements(), reverse=True)
        assert sum(t for t, _ in fixed) + optimum(rest, capacity) == optimum(lengths, capacity), lengths
    assert reduced > 100


def test_plan_holds_every_item():
    rnd = random.Random(1)
    for _ in range(60):
        counts = {rnd.randint(1, 200): rnd.randint(1, 90) for _ in range(rnd.randint(1, 60))}
        patterns = packing.plan(counts, 200)
        assert all(t > 0 and sum(k * m for k, m in h.items()) <= 200 for t, h in patterns)
        held = Counter()
        for t, h in patterns:
            held.update({k: m * t for k, m in h.items()})
        assert held == Counter(counts)
    total = Counter(rnd.randint(1, 2048) for _ in range(50_000))
    bins = sum(t for t, _ in packing.plan(total))
    assert bins <= 1.005 * sum(k * n for k, n in total.items()) / 2048 + 1


def check(rows, docs, tok, capacity):
    """Every document whole, every sequence gapless and within the capacity."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(docs)
    for k, text in docs.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(by_doc[k], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(ids) // capacity)))
        for r in got:
            part = ids[r.piece * capacity:(r.piece + 1) * capacity]
            assert (r.start, r.length, r.ids_crc32) == (r.piece * capacity, len(part), zlib.crc32(part.tobytes()))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


def test_query(spark, sf):
    tok = Tokenizer.from_file(bpe.default_vocabulary())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op3_best_fit_packing"](spark, sf).collect()
    used = check(rows, docs, tok, 2048)
    assert used <= sum(r.length for r in rows) / 2048 * 1.02 + 1


def test_edges(spark):
    tok = Tokenizer.from_file(bpe.default_vocabulary())
    texts = {0: None, 1: "", 2: "word " * 5000, 3: "a b", 4: "a b", 5: "x " * 2047, 6: "x " * 2048}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("length", bpe.F.lit("clash"))
    check(packing.pack_documents(docs).collect(), texts, tok, 2048)
    placed = packing.pack_documents(docs, keep_ids=True)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)
    assert packing.pack_documents(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(3000,)], "length long"))
