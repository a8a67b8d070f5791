"""Collocations by dynamic itemset counting.

Texts are cut into pieces and words once and written as blocks of word numbers, dealt over ``SHARDS``
shards.  The shards are scanned one after the other, round and round.  All words are counted from the
first scan on; a longer phrase is counted from the scan at whose start both its parts, the phrase
without its last and without its first word, have been met ``LEAST`` times.  So words, pairs and longer
phrases are counted in the same scans.  A phrase that has seen every shard once has its whole count and
is not counted any more; scanning ends when no phrase is left open.

When a phrase has reached ``LEAST``, the next scan is noted in the slot of its hash; scans get the slots
(``2**SLOT_BITS`` bytes for each length, whatever the size of the corpus).  Phrases that share a slot
may be counted early, or without need, but always through one whole cycle, so counts stay exact.

Within a block phrases are told apart by exact numbers, and each block gives one row for each of its
open phrases; frequent phrases therefore do not gather in a task.  Counts met so far are a written
table that holds open and frequent phrases only; nothing but slots and sums by language reaches the
driver.

Defined results: NULL text counts as empty, NULL language as ``und``.  Repeated rows and ids count
each.  Ties in a ranking are ordered by phrase in bytes.  A very long text is a block of its own.  No
rows: no rows.  Extra columns are not read.
"""

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import byte_lengths, discard, pack_ints, portions, small_batches, stored, unpack_ints

LEAST = 100  # occurrences of a candidate
LONGEST = 5  # words of a candidate
TOP = 2000  # rows of a language's report
COVERED = 100  # per cent of a phrase's occurrences that a longer candidate holds, to drop it
SHARDS = 4
SLOT_BITS = 22
BLOCK_BYTES = 8 << 20
NEVER = 255
BREAKS = r"[.,;:!?\x0A-\x0D]+"
_BLOCK = "shard int, lang string, n long, words binary, codes binary"
_COUNT = "lang string, k int, phrase string, start int, n long"


def _to_blocks(size):
    """Documents to blocks of one language: its words, and their numbers in order, 0 for a break."""
    return lambda batches: _blocks(batches, size)


def _blocks(batches, size):
    import pyarrow as pa
    import pyarrow.compute as pc
    import zstandard

    turn = TaskContext.get().partitionId()
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for rows in portions(batches, lambda b: byte_lengths(b.column("text")), size):
        for lang in sorted(pc.unique(rows.column("lang")).to_pylist()):
            texts = rows.filter(pc.equal(rows.column("lang"), lang)).column("text").combine_chunks()
            texts = pc.ascii_lower(pc.cast(texts, pa.large_string()))
            end, nothing = (pa.scalar(x, pa.large_string()) for x in (" . ", ""))
            texts = pc.binary_join_element_wise(pc.replace_substring_regex(texts, BREAKS, " . "), end, nothing)
            split = pc.ascii_split_whitespace(texts).flatten()
            coded = split.filter(pc.greater(pc.binary_length(split), 0)).dictionary_encode()
            dot = pc.index(coded.dictionary, pa.scalar(".", coded.dictionary.type)).as_py()
            number = np.arange(1, len(coded.dictionary) + 1, dtype=np.int64)
            number[dot + 1:] -= 1
            number[dot] = 0
            codes = number[coded.indices.to_numpy()]
            words = [w for i, w in enumerate(coded.dictionary.cast(pa.large_binary()).to_pylist()) if i != dot]
            if words:
                yield pa.RecordBatch.from_pydict(
                    {"shard": pa.array([turn % SHARDS], pa.int32()), "lang": [lang], "n": [int((codes > 0).sum())],
                     "words": [squeeze(b" ".join(words))], "codes": [pack_ints(codes)]})
        turn += 1
        pa.default_memory_pool().release_unused()


def word_blocks(docs, size=BLOCK_BYTES):
    """Blocks of all texts, written; one folder for each shard."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(rows.mapInArrow(_to_blocks(size), _BLOCK), "shard")


def _word_hashes(lang, words):
    seed = zlib.crc32(lang.encode())
    return np.fromiter((zlib.crc32(w, seed) for w in words), dtype=np.uint64, count=len(words))


def _extend(hashes, words):
    """Hashes of phrases that go on with one more word."""
    with np.errstate(over="ignore"):
        return hashes * np.uint64(0x9E3779B97F4A7C15) + words + np.uint64(1)


def _slot(hashes, slots):
    """Slot of each hash among ``slots``, a power of two."""
    with np.errstate(over="ignore"):
        return (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(65 - int(slots).bit_length())


def open_phrases(codes, hashes, reached, step):
    """(length, first position, count, start) of the phrases of a block that ``step`` has to count.

    ``reached`` has for each length the step from which a slot's phrases count as frequent.
    """
    found = []
    since = np.where(codes > 0, 0, NEVER).astype(np.uint8)
    whole = np.zeros(len(codes), dtype=np.uint64)
    n_words = len(hashes) + 1
    own = np.concatenate([np.zeros(1, np.uint64), hashes])[codes]
    for k in range(1, LONGEST + 1):
        at = np.flatnonzero(since <= step)
        if not len(at):
            break
        live = at[since[at].astype(np.int64) > step - SHARDS]
        if len(live):
            number = codes[live]
            for j in range(1, k):
                if j > 1:  # small numbers again, so that the next product stays exact
                    _, number = np.unique(number, return_inverse=True)
                number = number * n_words + codes[live + j]
            _, first, count = np.unique(number, return_index=True, return_counts=True)
            found.append((k, live[first], count, since[live[first]]))
        if k == LONGEST:
            break
        whole[at] = _extend(whole[at], own[at + k - 1])
        frequent = np.full(len(codes), NEVER, dtype=np.uint8)
        # A slot may be set before a phrase that shares it is counted itself.
        frequent[at] = np.maximum(reached[k][_slot(whole[at], len(reached[k]))], since[at])
        since = np.append(np.maximum(frequent[:-1], frequent[1:]), np.uint8(NEVER))
    return found


def _count_step(shipped, step):
    """Blocks of a shard to one row for each block and phrase."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        reached = {k: np.frombuffer(expand(v), dtype=np.uint8) for k, v in shipped.value.items()}
        for batch in batches:
            for row in batch.to_pylist():
                words = expand(row["words"]).split(b" ")
                codes = unpack_ints(row["codes"]).astype(np.int64)
                shown = pa.array(words, pa.binary()).cast(pa.large_string())
                for k, first, count, since in open_phrases(codes, _word_hashes(row["lang"], words), reached, step):
                    parts = [shown.take(pa.array(codes[first + j] - 1)) for j in range(k)]
                    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string())
                    n = len(first)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["lang"]], pa.string()).take(pa.array(np.zeros(n, np.int64))),
                         pa.array(np.full(n, k, np.int32)), phrase, pa.array(since.astype(np.int32)),
                         pa.array(count.astype(np.int64))], names=["lang", "k", "phrase", "start", "n"])
                del words, codes, shown
                pa.default_memory_pool().release_unused()

    return run


def _slots_of(slots):
    """Phrases to their length and slot."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            length, slot = [], []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                whole = np.zeros(1, dtype=np.uint64)
                words = _word_hashes(lang, phrase.encode().split(b" "))
                for i in range(len(words)):
                    whole = _extend(whole, words[i:i + 1])
                length.append(len(words))
                slot.append(int(_slot(whole, slots)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(length, pa.int32()), pa.array(slot, pa.int64())], names=["k", "slot"])

    return run


def frequent_phrases(blocks, least=LEAST, slot_bits=SLOT_BITS):
    """All phrases of up to ``LONGEST`` words with at least ``least`` occurrences: lang, k, phrase, n."""
    import zstandard

    spark = blocks.sparkSession
    reached = {k: np.full(1 << slot_bits, NEVER, dtype=np.uint8) for k in range(1, LONGEST)}
    tally, last, step = None, 0, 0
    while step < last + SHARDS:
        packed = {k: zstandard.ZstdCompressor(level=1).compress(v.tobytes()) for k, v in reached.items()}
        shipped = spark.sparkContext.broadcast(packed)
        scanned = blocks.filter(F.col("shard") == step % SHARDS).select("lang", "words", "codes").mapInArrow(
            _count_step(shipped, step), _COUNT).withColumn("frequent", F.lit(None).cast("int"))
        rows = scanned if tally is None else tally.unionByName(scanned)
        rows = rows.groupBy("lang", "k", "phrase", "start").agg(F.sum("n").alias("n"), F.min("frequent").alias("frequent"))
        step += 1
        now = stored(rows.withColumn("frequent", F.coalesce("frequent", F.when(F.col("n") >= least, step))))
        if tally is not None:
            discard(tally)
        fresh = now.filter((F.col("frequent") == step) & (F.col("k") < LONGEST)).select("lang", "phrase")
        fresh = fresh.mapInArrow(_slots_of(1 << slot_bits), "k int, slot long").distinct().toPandas()
        for k, slots in fresh.groupby("k")["slot"]:
            held = reached[k]
            held[slots.to_numpy()] = np.minimum(held[slots.to_numpy()], step)
            last = step
        # A phrase that has been through all shards without getting there is done with.
        tally = now.filter((F.col("start") > step - SHARDS) | (F.col("n") >= least))
    return tally.filter(F.col("n") >= least).select("lang", "k", "phrase", "n")


def score_phrases(frequent, totals):
    """Candidates with the cut of the lowest score: lang, phrase, a, l, r, n, score."""
    words = F.split("phrase", " ")
    cuts = frequent.filter("k >= 2").select("lang", "phrase", F.col("n").alias("a"), "k", F.posexplode(
        F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(
            F.array_join(F.slice(words, F.lit(1), i), " ").alias("first"),
            F.array_join(F.slice(words, i + 1, F.col("k") - i), " ").alias("rest")))).alias("cut", "p"))
    for side, count in (("first", "l"), ("rest", "r")):
        parts = frequent.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("n").alias(count))
        cuts = cuts.join(parts, (F.col("lang") == F.col("_lang")) & (F.col(f"p.{side}") == F.col("_part"))).drop("_lang", "_part")
    cuts = cuts.join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(1000 * _a * _n) DIV (_l * _r)")
    cuts = cuts.withColumns({"_a": big("a"), "_n": F.col("n").cast("decimal(15,0)"), "_l": big("l"), "_r": big("r")})
    best = cuts.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("n").alias("n"), F.first("k").alias("k"),
        F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "k", "a", "best.l", "best.r", "n", "best.score")


def without_covered(candidates, covered=COVERED):
    """Drops candidates that lie inside a longer one with (nearly) all their occurrences."""
    words = F.split("phrase", " ")
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    longer = candidates.filter("k > 2").select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(longer, ["lang", "phrase"], "left").filter(
        F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True))).drop("longer")


def collocations(docs, least=LEAST, top=TOP, covered=COVERED):
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    blocks = word_blocks(docs)
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    candidates = score_phrases(frequent_phrases(blocks, least), totals)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = without_covered(candidates, covered).withColumn("rank", F.row_number().over(best).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {LONGEST + 1}) AS r(k))
  GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.phrase, c.a, x.a AS l, y.a AS r, t.n, j,
    (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN t ON t.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, {LONGEST}) AS r(m) WHERE m < k) GROUP BY ALL),
q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < {COVERED} * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM q WHERE rank <= {TOP}
"""
