"""Encoding and decoding with a public BPE vocabulary through a table of distinct words.

Texts are split at ASCII white space, which the tokenizer drops and across which none of its steps
reaches.  Texts become blocks: a block holds the words of some documents as numbers that point into
the block's own word list.  Blocks are written once, bucketed, and stay.  The word lists of all blocks
are dealt by the hash of the word, so each distinct word of the corpus is met in one bucket and encoded
once there; the ids are joined back to the blocks by word number.  A bucket whose table passes
``TABLE_WORDS`` words starts a new one, so that the memory of a task stays bounded at any size.
Decoding joins ids to the vocabulary's pieces, a table bounded by the vocabulary.

Python is used because the encoder is a library; the shuffles carry word lists and their ids only,
never texts.

Defined results: NULL or blank text has no ids and decodes to the empty string.  Repeated rows and
ids are separate documents, NULL ids included.  A very long text makes its block as long as it is.
No rows: no rows.  Only the id and text columns are read, whatever else there is.
"""

import os
import re
import uuid
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import byte_lengths, give_back, pack_ints, portions, small_batches, spans, unpack_ints

BLOCK_BYTES = 8 << 20
BUCKETS = 256  # at least; as many as the shuffle has partitions, so that all of them have words
TABLE_WORDS = 1 << 20
#: Letters of one word of the tokenizer, then a run of marks, which is a word of its own.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!#$%&*,.:;?]*)")

CHUNK_WORDS = 1 << 18

_BLOCK = "block long, bucket int, doc_ids array<{id}>, counts array<int>, data binary, codes binary"


def default_vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _read(path):
    with open(path, encoding="utf-8") as f:
        return f.read()


def _tokenizer(text):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(text)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _to_blocks(id_type, buckets):
    """Documents to blocks: one row of word numbers, and a row of words for each hash bucket."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import zstandard

        part, n = TaskContext.get().partitionId(), 0
        schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("doc_ids", pa.list_(id_type)),
                            ("counts", pa.list_(pa.int32())), ("data", pa.binary()), ("codes", pa.binary())])
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for rows in portions(batches, lambda b: byte_lengths(b.column("text")), BLOCK_BYTES):
            texts = pc.cast(pc.fill_null(rows.column("text").combine_chunks(), ""), pa.large_string())
            split = pc.ascii_split_whitespace(texts)
            split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
            flat, offsets = split.flatten(), split.offsets.to_numpy()
            keep = pc.greater(pc.binary_length(flat), 0)
            upto = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
            counts = np.diff(upto[offsets - offsets[0]]).astype(np.int32)
            coded = flat.filter(keep).dictionary_encode()
            by_name = pc.sort_indices(coded.dictionary).to_numpy()
            found = coded.dictionary.take(pa.array(by_name)).cast(pa.large_binary()).to_pylist()
            home = np.fromiter(map(zlib.crc32, found), dtype=np.uint32, count=len(found)) % buckets
            by_home = np.argsort(home, kind="stable")
            order, found = by_name[by_home], [found[i] for i in by_home.tolist()]
            ends = np.searchsorted(home[by_home], np.arange(buckets + 1))
            block = (part << 24) + n
            n += 1
            out = [(block, -1, rows.column("id").to_pylist(), counts,
                    pack_ints(coded.indices.to_numpy()), pack_ints(order))]
            for b in range(buckets):
                if mine := found[ends[b]:ends[b + 1]]:
                    out.append((block, b, None, None, squeeze(b" ".join(mine)), None))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], type=f.type) for k, f in enumerate(schema)], schema=schema)
            del rows, texts, split, flat, keep, coded, found, order, by_name, home, by_home, out
            give_back()

    return run


def _encode_words(vocabulary, most=TABLE_WORDS):
    """Word rows, sorted by bucket, to rows of ids; every distinct word of a bucket once."""
    def run(batches):
        import pyarrow as pa
        import zstandard

        tok, known, at = _tokenizer(vocabulary.value), {}, None
        expand = zstandard.ZstdDecompressor().decompress
        plain = _PLAIN.fullmatch

        def learn(some):
            """Ids of unknown words: plain ones together as one text, the others one by one."""
            letters = [w for w in some if (m := plain(w)) and not m[2]]
            for i in range(0, len(letters), 512):
                part = letters[i:i + 512]
                got = tok.encode(" ".join(part), add_special_tokens=False)
                ids, of = np.array(got.ids, dtype="<u4"), np.array(got.word_ids)
                if of[-1] == len(part) - 1:  # each was one word of the tokenizer
                    cut = np.searchsorted(of, np.arange(len(part) + 1))
                    known.update((w, ids[cut[j]:cut[j + 1]].tobytes()) for j, w in enumerate(part))
            rest = list(some - known.keys())
            for w, got in zip(rest, tok.encode_batch_fast(rest, add_special_tokens=False)):
                known[w] = np.array(got.ids, dtype="<u4").tobytes()

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["bucket"] != at or len(known) > most:
                    at, known = row["bucket"], {}
                words = expand(row["data"]).decode().split(" ")
                fresh = {}
                for w in words:
                    if w not in known:
                        m = plain(w)
                        core = m[1] if m else w
                        fresh[w] = (core.lower() if m and core.isascii() else core, m[2] if m else "")
                learn({k for pair in fresh.values() for k in pair if k and k not in known})
                known.update((w, known[a] + known[b] if b else known[a]) for w, (a, b) in fresh.items())
                ids = [known[w] for w in words]
                lens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) >> 2
                data = pack_ints(np.concatenate([[len(lens)], lens, np.frombuffer(b"".join(ids), dtype="<u4")]))
                out.append((row["block"], row["bucket"], data))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))],
                names=["block", "bucket", "data"])
            give_back()
        del known
        give_back()

    return run


def _put_back(id_type, pieces):
    """Blocks with the ids of their words to one row of ids per document."""
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", id_type), ("ids", pa.binary())] + [("decoded", pa.string())] * (pieces is not None))
        shown = pa.array([p + " " for p in pieces.value], pa.large_string()) if pieces is not None else None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                of_bucket = [unpack_ints(x["data"]) for x in sorted(row["words"] or [], key=lambda x: x["bucket"])]
                order, codes = unpack_ints(row["codes"]), unpack_ints(row["data"])
                got = [(int(x[0]), x) for x in of_bucket]
                lens = np.zeros(len(order), np.int64)
                starts = np.zeros(len(order), np.int64)
                lens[order] = np.concatenate([x[1:n + 1] for n, x in got]) if got else 0
                starts[order] = np.cumsum(lens[order]) - lens[order]
                pool = np.concatenate([x[n + 1:] for n, x in got]) if got else np.zeros(0, "<u4")
                counts = np.array(row["counts"], dtype=np.int64)
                upto = np.concatenate([[0], np.cumsum(counts)])
                a = 0
                while a < len(counts):  # some documents at a time
                    b = max(a + 1, min(int(np.searchsorted(upto, upto[a] + CHUNK_WORDS, side="right")) - 1, a + 1024))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][a:b], id_type), *_documents(codes[upto[a]:upto[b]], counts[a:b], lens, starts, pool, shown)],
                        schema=schema)
                    a = b
                del row, of_bucket, order, codes, got, lens, starts, pool
                give_back()

    return run


def _documents(codes, counts, lens, starts, pool, shown):
    """Ids, and decoded text if ``shown`` is given, of documents whose words stand in ``codes``."""
    import pyarrow as pa

    each = lens[codes]
    ids = pool[spans(starts[codes], each)].astype("<u4")
    ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
    raw = ids.tobytes()
    out = [pa.array([raw[4 * a:4 * b] for a, b in zip(ends, ends[1:])], pa.binary())]
    if shown is not None:
        text = shown.take(pa.array(ids.astype(np.int64)))
        at = np.frombuffer(text.buffers()[1], dtype=np.int64, count=len(text) + 1) if len(text) else np.zeros(1, int)
        data = text.buffers()[2] if len(text) else b""
        out.append(pa.array([bytes(data[at[a]:at[b] - 1]).decode() if b > a else "" for a, b in zip(ends, ends[1:])], pa.string()))
    return out


def _bucketed(df, key):
    """Write the rows once as a table bucketed by ``key``: a later join on it need not move them again.

    The catalog only carries the buckets to the reader; the entry goes at once, the files stay.
    """
    spark = df.sparkSession
    name, path = f"blocks_{uuid.uuid4().hex}", scratch_path(spark, "blocks")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).option("path", path).option("compression", "none").format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def encode_documents(docs, vocabulary=None, decode=False):
    """``doc_id`` and ``text`` to ``doc_id``, ``ids`` (little-endian unsigned 32-bit numbers).

    ``decode`` adds ``decoded``, the text of the pieces of the ids.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = small_batches(docs.sparkSession)
    content = _read(vocabulary or default_vocabulary())
    shipped = spark.sparkContext.broadcast(content)
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    schema = T._parse_datatype_string(_BLOCK.format(id=kind.simpleString()))
    buckets = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = _bucketed(docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(_to_blocks(arrow, buckets), schema), "block")
    lists = blocks.filter("bucket >= 0").select("block", "bucket", "data")
    coded = lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _encode_words(shipped), "block long, bucket int, data binary")
    coded = coded.groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("words"))
    both = blocks.filter("bucket < 0").join(coded, "block", "left").select("doc_ids", "counts", "data", "codes", "words")
    pieces = None
    if decode:
        tok = _tokenizer(content)
        pieces = spark.sparkContext.broadcast([tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())])
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.BinaryType())]
                       + ([T.StructField("decoded", T.StringType())] if decode else []))
    return both.mapInArrow(_put_back(arrow, pieces), out)
