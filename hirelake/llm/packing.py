"""Best-fit packing after dominance reduction.

Only lengths decide a packing, and a length is at most the capacity, so the plan is made from the
histogram of lengths: ``capacity`` numbers, whatever the number of documents.  On the histogram,
sets of up to three items that provably dominate every other set holding their largest item are
fixed first, many equal sets at a time; what remains is packed best-fit decreasing, again by length.
Spark numbers the items of each length (per task, then with the counts of the tasks before) and
looks every item up in the plan's rank ranges.

Defined results: items longer than the capacity are an error (``pieces`` cuts documents first);
length 0 is an error; NULL texts are empty documents of one separator.  Repeated rows and ids are
separate items.  No rows: no rows.  Extra columns are kept by ``pack`` and not read by
``pack_documents``.
"""

import bisect
from collections import Counter

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encode_documents
from .common import stored

CAPACITY = 2048
SEPARATOR = 0


class _Lengths:
    """Remaining items by length, with the lengths in order."""

    def __init__(self, counts):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.keys = sorted(self.n)

    def take(self, wanted, times):
        for k, m in wanted.items():
            self.n[k] -= m * times
            if not self.n[k]:
                del self.n[k]
                self.keys.pop(bisect.bisect_left(self.keys, k))

    def largest(self, room, used):
        """Longest item of at most ``room`` besides the multiset ``used``; 0 if there is none."""
        i = bisect.bisect_right(self.keys, room)
        while i and self.n[self.keys[i - 1]] <= used.get(self.keys[i - 1], 0):
            i -= 1
        return self.keys[i - 1] if i else 0

    def smallest(self, how_many, used, above=0):
        """The ``how_many`` shortest items longer than ``above`` besides ``used``."""
        out, i = [], bisect.bisect_right(self.keys, above)
        while i < len(self.keys) and len(out) < how_many:
            out += [self.keys[i]] * min(how_many - len(out), self.n[self.keys[i]] - used.get(self.keys[i], 0))
            i += 1
        return out


def _best_pair(items, room, used):
    """Largest sum of two items within ``room``."""
    best = (0, 0, 0)
    i, j = 0, len(items.keys) - 1
    free = lambda k: items.n[k] - used.get(k, 0)
    keys = [k for k in items.keys if free(k) > 0]
    i, j = 0, len(keys) - 1
    while i <= j:
        total = keys[i] + keys[j]
        if total > room or (i == j and free(keys[i]) < 2):
            j -= 1
            continue
        best = max(best, (total, keys[j], keys[i]))
        i += 1
    return best


def dominating_set(items, j, capacity):
    """A set with one item of length ``j`` that is at least as good as any other set with it.

    One set dominates another if the items of the other can be grouped so that every group fits into
    the place of one of its own items.  None if no such set of up to three items is proven.
    """
    used, room = {j: 1}, capacity - j
    short = items.smallest(3, used)
    fit = sum(1 for total in np.cumsum(short) if total <= room)
    if not fit:
        return Counter([j])
    first = items.largest(room, used)
    if fit == 1 or first == room:
        return Counter([j, first])
    if fit > 2:
        return None
    pair, _, _ = _best_pair(items, room, used)
    if first >= pair:
        return Counter([j, first])
    second = items.largest(room - first, Counter([j, first]))
    if second:
        between = [x for x in items.smallest(2, Counter([j, first]), above=second) if x < first]
        if len(between) < 2 or sum(between) > room:
            return Counter([j, first, second])
    return None


def reduce_lengths(items, capacity):
    """Fix dominating sets as long as there are any; returns [(times, lengths)]."""
    fixed, moved = [], True
    while moved:
        moved = False
        for j in reversed(list(items.keys)):
            while j in items.n:
                found = dominating_set(items, j, capacity)
                if found is None:
                    break
                times = min(items.n[k] // m for k, m in found.items())
                items.take(found, times)
                fixed.append((times, found))
                moved = True
    return fixed


def best_fit(items, capacity):
    """Best-fit decreasing for whatever is left; returns [(times, lengths)]."""
    rooms, open_bins = [], {}  # room -> [(times, lengths)]

    def put(room, times, held):
        if room not in open_bins:
            bisect.insort(rooms, room)
            open_bins[room] = []
        open_bins[room].append((times, held))

    for j in sorted(items.n, reverse=True):
        left = items.n[j]
        while left:
            at = bisect.bisect_left(rooms, j)
            if at < len(rooms):
                room = rooms[at]
                times, held = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            else:
                room, times, held = capacity, left, Counter()
            each = min(room // j, left)
            whole = min(times, left // each)
            if held or whole:
                put(room - each * j, whole, held + Counter({j: each}))
            if held and times > whole:
                put(room, times - whole, held)
            left -= whole * each
    return [b for some in open_bins.values() for b in some]


def plan(counts, capacity=CAPACITY):
    """Lengths with their numbers to [(times, lengths of one sequence)]."""
    items = _Lengths(counts)
    fixed = reduce_lengths(items, capacity)
    return fixed + best_fit(items, capacity)


def _ranges(patterns):
    """Rank ranges of every length: (length, lo, hi, first sequence, items a sequence, offset)."""
    sequence, next_rank, rows = 0, Counter(), []
    for times, held in patterns:
        offset = 0
        for length, m in sorted(held.items(), reverse=True):
            lo = next_rank[length]
            rows.append((length, lo, lo + times * m, sequence, m, offset))
            next_rank[length] += times * m
            offset += length * m
        sequence += times
    return rows


def _number(batches):
    """Adds the task and the number of the row among those of its length in the task."""
    import pyarrow as pa

    part, seen = TaskContext.get().partitionId(), Counter()
    for batch in batches:
        rank = np.zeros(batch.num_rows, dtype=np.int64)
        lengths = batch.column("length").to_numpy(zero_copy_only=False)
        order = np.argsort(lengths, kind="stable")
        values, starts, counts = np.unique(lengths[order], return_index=True, return_counts=True)
        for v, s, c in zip(values.tolist(), starts, counts):
            rank[order[s:s + c]] = np.arange(seen[v], seen[v] + c)
            seen[v] += int(c)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(batch.num_rows, part, dtype=np.int32)), pa.array(rank)],
            names=[*batch.schema.names, "_part", "_rank"])


def pack(items, capacity=CAPACITY):
    """Rows with a long column ``length`` get ``sequence_id`` and ``offset``.

    The plan on the driver holds lengths and counts only; its rank ranges are broadcast, their
    number is bounded by the capacity and not by the rows.
    """
    spark = items.sparkSession
    schema = T.StructType(items.schema.fields + [T.StructField("_part", T.IntegerType()), T.StructField("_rank", T.LongType())])
    numbered = stored(items.mapInArrow(_number, schema))
    by_part = stored(numbered.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if any(k is None or not 0 < k <= capacity for k in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")
    bases = by_part.select("length", "_part", before.alias("_base"))
    ranges = spark.createDataFrame(
        _ranges(plan(counts, capacity)), "_length long, _lo long, _hi long, _first long, _each int, _at int")
    # One row for each length and task: it grows with the tasks, so it is never broadcast.
    ranked = numbered.join(bases.hint("merge"), ["length", "_part"]).withColumn("_g", F.col("_base") + F.col("_rank"))
    placed = ranked.join(F.broadcast(ranges), (F.col("length") == F.col("_length"))
                         & (F.col("_g") >= F.col("_lo")) & (F.col("_g") < F.col("_hi")))
    k = F.col("_g") - F.col("_lo")
    return placed.select(
        *[F.col(f"`{c}`") for c in items.columns], (F.col("_first") + F.expr("(_g - _lo) DIV _each")).alias("sequence_id"),
        (F.col("_at") + (k % F.col("_each")) * F.col("length")).alias("offset"))


def _cut(capacity, keep_ids):
    """Ids of documents to pieces of at most the capacity, the separator included."""
    def run(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            names = batch.column("doc_id")
            at, piece, start, length, crc, data = [], [], [], [], [], []
            for i, ids in enumerate(batch.column("ids").to_pylist()):
                ids += SEPARATOR.to_bytes(4, "little")
                n = len(ids) >> 2
                for p, s in enumerate(range(0, n, capacity)):
                    part = ids[4 * s:4 * (s + capacity)]
                    at.append(i)
                    piece.append(p)
                    start.append(s)
                    length.append(len(part) >> 2)
                    crc.append(zlib.crc32(part))
                    data.append(part)
            out = [names.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                   pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                out + [pa.array(data, pa.binary())] * keep_ids,
                names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return run


def pieces(docs, capacity=CAPACITY, vocabulary=None, keep_ids=True):
    """Token pieces of documents, each document closed by the separator; ``ids`` if asked for."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ] + [T.StructField("ids", T.BinaryType())] * keep_ids)
    return encode_documents(docs, vocabulary).mapInArrow(_cut(capacity, keep_ids), schema)


def pack_documents(docs, capacity=CAPACITY, vocabulary=None, keep_ids=False):
    """One row per piece of a document with its place; every sequence is filled without gaps."""
    return pack(pieces(docs, capacity, vocabulary, keep_ids), capacity)


def sequences(placed):
    """The token sequences themselves, from ``pack_documents(..., keep_ids=True)``."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    whole = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))
