"""Quality classifier: votes of the nearest labelled documents.

A document is a bag of terms: pairs of neighbouring character classes (which show its writing:
plain prose, capitals, bars, strings of signs), hashed words, and how often words, neighbours and
lines repeat.  Truncated SVD of the labelled sample gives latent vectors.  The vectors of the sample
are broadcast; every document is projected and multiplied with all of them, block by block, and the
labels of its nearest neighbours are weighted by cosine.

The sample is bounded: the ``SAMPLE`` labelled rows with the smallest hash of their id.  Its ids are
chosen first, so only their feature vectors (``SAMPLE`` times a fixed number of terms) reach the
driver.  Texts are read whole.

Defined results: NULL text counts as empty, and every text has a score, the empty one by its length
terms.  NULL labels and labels without document are not learned from; with no label at all every score
is 0.5.  Repeated rows and ids are scored each.  No rows: no rows.  Extra columns are not read, or
come back unchanged from ``keep_good``.
"""

import zlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_lengths, fold, give_back, portions, small_batches

SAMPLE = 4096
RANK = 48
NEIGHBOURS = 15
SHARPNESS = 12
THRESHOLD = 0.3
FOLDS = 5
BATCH_BYTES = 1 << 20
WORD_TERMS = 256
WORD_WEIGHT = 0.3
LENGTH_TERMS = 16

#: Class of each byte: letters by case, digits, white space, other text bytes, and single signs.
_SIGNS = b".,!?|*#$%&<>-_/:;()\"'"
_CLASSES = 6 + len(_SIGNS)


def _byte_classes():
    out = np.full(256, 5, dtype=np.int64)
    out[ord("a"):ord("z") + 1] = 0
    out[ord("A"):ord("Z") + 1] = 1
    out[ord("0"):ord("9") + 1] = 2
    out[[9, 10, 11, 12, 13, 32]] = 3
    out[128:] = 0  # bytes of letters beyond ASCII, mostly
    for i, c in enumerate(_SIGNS):
        out[c] = 6 + i
    return out


def _repeats(doc, code, n_docs, n_codes):
    """Per document: number of items, of distinct items, and of items equal to the one before."""
    total = np.bincount(doc, minlength=n_docs)
    distinct = np.bincount(np.unique(doc * n_codes + code) // max(n_codes, 1), minlength=n_docs)
    same = np.bincount(doc[1:][(code[1:] == code[:-1]) & (doc[1:] == doc[:-1])], minlength=n_docs)
    return total, distinct, same


def features(texts):
    """Term matrix of an Arrow string array."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    n = len(texts)
    lengths = byte_lengths(texts)
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    begin = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset] if n else 0
    raw = raw[begin:begin + lengths.sum()]
    doc = np.repeat(np.arange(n), lengths)
    classes = _byte_classes()[raw]
    inside = doc[1:] == doc[:-1]
    pairs = (doc[1:] * _CLASSES * _CLASSES + classes[:-1] * _CLASSES + classes[1:])[inside]
    style = np.bincount(pairs, minlength=n * _CLASSES * _CLASSES).reshape(n, -1).astype(np.float32)

    def items(split, fold_case=False):
        flat, offsets = split.flatten(), split.offsets.to_numpy()
        owner = np.repeat(np.arange(n), np.diff(offsets))
        keep = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        coded = flat.filter(pa.array(keep)).dictionary_encode()
        return owner[keep], coded.indices.to_numpy().astype(np.int64), coded.dictionary

    owner, code, found = items(pc.ascii_split_whitespace(texts))
    total, distinct, same = _repeats(owner, code, n, len(found))
    home = np.array([zlib.crc32(w.lower().encode()) % WORD_TERMS for w in found.to_pylist()], dtype=np.int64)
    words = np.bincount(owner * WORD_TERMS + home[code], minlength=n * WORD_TERMS).reshape(n, -1).astype(np.float32) \
        if len(code) else np.zeros((n, WORD_TERMS), np.float32)
    lines, line_code, found_lines = items(pc.split_pattern(texts, "\n"))
    n_lines, distinct_lines, _ = _repeats(lines, line_code, n, len(found_lines))

    def shares(counts):
        return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))

    # Distinct words of a text shrink with its length; the share is taken against that of plain prose.
    expected = np.maximum(total, 1) ** -0.15
    repeat = np.stack([
        1 - np.minimum(distinct / np.maximum(total, 1) / expected, 1), same / np.maximum(total, 1),
        1 - distinct_lines / np.maximum(n_lines, 1), (total == 0).astype(float)], axis=1)
    size = np.minimum(np.log2(total + 1), LENGTH_TERMS - 1)
    length = np.maximum(1 - np.abs(size[:, None] - np.arange(LENGTH_TERMS)), 0)
    return np.concatenate([shares(style), WORD_WEIGHT * shares(words), repeat, 0.3 * length], axis=1).astype(np.float32)


def _feature_rows(batches):
    import pyarrow as pa

    for rows in portions(batches, lambda b: byte_lengths(b.column("text")), BATCH_BYTES):
        x = features(rows.column("text").combine_chunks())
        yield pa.RecordBatch.from_arrays(
            [rows.column("quality").combine_chunks().cast(pa.float64()), pa.array([v.tobytes() for v in x], pa.binary())],
            names=["quality", "x"])


def fit(docs, labels, sample=SAMPLE):
    """Latent vectors of the labelled sample: (weights, basis, vectors, labels), or None without labels."""
    spark = small_batches(docs.sparkSession)
    chosen = labels.select(F.col("doc_id"), F.col("quality").cast("double").alias("quality")).filter(
        F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0))
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = spark.createDataFrame(chosen.collect(), chosen.schema)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality")
    got = known.mapInArrow(_feature_rows, "quality double, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (bytes(r["x"]), r["quality"]))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])[:sample]
    y = np.array([r["quality"] for r in got], dtype=np.float32)[:sample]
    seen = (x > 0).sum(axis=0)
    weights = np.where(seen > 0, 1 + 0.2 * np.log((1 + len(x)) / (1 + seen)), 0).astype(np.float32)
    _, _, vt = np.linalg.svd(x * weights, full_matrices=False)
    basis = np.ascontiguousarray(vt[:RANK].T.astype(np.float32))
    return weights, basis, _unit((x * weights) @ basis), y


def _unit(v):
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def votes(z, vectors, y):
    """Weighted share of good labels among the nearest vectors of each row of ``z``."""
    cosine = z @ vectors.T
    k = min(NEIGHBOURS, len(y))
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-3) ** SHARPNESS
    return (weight * y[near]).sum(axis=1) / weight.sum(axis=1)


def _score(model):
    def run(batches):
        import pyarrow as pa

        for rows in portions(batches, lambda b: byte_lengths(b.column("text")), BATCH_BYTES):
            texts = rows.column("text").combine_chunks()
            if model is None:
                score = np.full(len(texts), 0.5)
            else:
                weights, basis, vectors, y = model.value
                score = np.concatenate([
                    votes(_unit((features(texts.slice(i, 1024)) * weights) @ basis), vectors, y)
                    for i in range(0, len(texts), 1024)])
            out = [rows.column("row").combine_chunks(), pa.array(np.clip(score, 0, 1).astype(np.float64))]
            yield pa.RecordBatch.from_arrays(out, names=["row", "score"])
            del rows, texts, out
            give_back()

    return run


def quality_votes(docs, model, carry=("doc_id",)):
    """The carried columns of every row with ``score`` and ``predicted``."""
    spark = small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*carry).alias("row"), F.col("text"))
    shipped = spark.sparkContext.broadcast(model) if model is not None else None
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    scored = rows.mapInArrow(_score(shipped), schema)
    return scored.select("row.*", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs, labels, labelled):
    """The rows of ``docs`` predicted good, with exactly their columns; labels refer to ``labelled``."""
    whole = quality_votes(docs, fit(labelled, labels), [F.struct("*").alias("_row")])
    return whole.filter("predicted = 1").select("_row.*")
