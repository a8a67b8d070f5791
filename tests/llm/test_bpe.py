import hashlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from hirelake.llm import bpe, queries


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(bpe.default_vocabulary())


TEXTS = [
    None, "", " \n\t", "Hello, WORLD! it's DON'T re've. a.b,c ..,", "été ÉTÉ naïve, Straße. ǅ İstanbul ΣΑΣ ς",
    "<|endoftext|> x<|startoftext|>y <|endoftext|>.", "é ñ, ́alone a b c ​", "日本語 テキスト 12345 ½ ²",
    "😀😀 word.word, ,. . word.. (word) [word], x\x00y \x0b\x0c z\u0085q r", "a" * 5000, "word " * 3000, "×÷ ×÷, ß. ŉ,",
]


def test_matches_the_library(spark, tok):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id, here."), (3, "same id again")]
    rows = [r if len(r) == 3 else (*r, "clash") for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, bytes(r.ids), r.decoded)
                  for r in bpe.encode_documents(docs, decode=True).collect()))
    want = []
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i is None, i or 0, np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_small_blocks_and_empty(spark, tok, monkeypatch):
    docs = spark.createDataFrame([(i, f"Word{i % 7}, and x{i}.") for i in range(200)], "doc_id int, text string")
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 64)
    got = {r.doc_id: list(np.frombuffer(r.ids, "<u4")) for r in bpe.encode_documents(docs).collect()}
    assert got == {i: tok.encode(f"Word{i % 7}, and x{i}.", add_special_tokens=False).ids for i in range(200)}
    assert bpe.encode_documents(docs.limit(0), decode=True).collect() == []
    nothing = spark.createDataFrame([], T.StructType(docs.schema.fields))
    assert bpe.encode_documents(nothing).count() == 0


def test_query(spark, sf, tok):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op5_bpe_codec"](spark, sf).collect():
        ids = tok.encode(docs.pop(r.doc_id), add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not docs


def test_each_distinct_word_of_the_corpus_is_encoded_once(spark, tok, monkeypatch):
    """Whatever the number of input tasks, a word list goes to the bucket of its words."""
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 7} gamma") for i in range(200)], "doc_id long, text string").repartition(8)
    before = {t.name for t in spark.catalog.listTables()}
    bpe.encode_documents(docs).collect()
    assert {t.name for t in spark.catalog.listTables()} == before
    import pyarrow as pa

    seen = []

    class Words:
        value = bpe._read(bpe.default_vocabulary())

    at = iter(range(3))
    monkeypatch.setattr(bpe, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: next(at))))
    blocks = [b for part in range(3) for b in bpe._to_blocks(pa.int64(), 4)(iter([pa.RecordBatch.from_pydict(
        {"id": pa.array([part]), "text": ["alpha beta gamma. alpha"]})]))]
    rows = sorted((r for b in blocks for r in b.to_pylist() if r["bucket"] >= 0), key=lambda r: r["bucket"])
    lists = pa.RecordBatch.from_pydict({k: [r[k] for r in rows] for k in ("block", "bucket", "data")})
    real = bpe._tokenizer

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode(self, text, **kw):
            seen.extend(text.split(" "))
            return self.inner.encode(text, **kw)

        def encode_batch_fast(self, texts, **kw):
            seen.extend(texts)
            return self.inner.encode_batch_fast(texts, **kw)

    monkeypatch.setattr(bpe, "_tokenizer", lambda text: Counted(real(text)))
    out = list(bpe._encode_words(Words)(iter([lists])))
    assert sum(b.num_rows for b in out) == len(rows)
    assert sorted(seen) == sorted(set(seen)) and {"alpha", "beta", "gamma"} <= set(seen)
