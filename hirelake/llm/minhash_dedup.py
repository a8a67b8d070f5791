"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

1. Each text becomes the set of its 5-word shingles (64-bit hashes), the set a digest, band keys and a
   short signature.  Texts with the same set form a class; one of them stands for it.
2. Representatives that share a band key are candidates.  While the buckets hold more pairs than rows and
   that helps, each bucket names one pivot, only pairs with the pivot are verified, and what proves linked
   is merged, so a group of near copies never becomes all of its pairs.  Pairs inside one component need no
   test any more; the pairs that are left, between different components, are all verified.  Where a bucket
   still holds many, as texts around one common passage do, only those are pairs that share one of their
   rarest shingles; no pair at the threshold can lack that.
3. The signatures of a pair are compared batch by batch.  With a uniform prior the similarity has a
   beta posterior; a pair is dropped once its chance to reach the threshold is below ``MISS``.
4. Survivors are confirmed on their full sets: 100 * intersection >= 75 * union.
5. Connected components by hooking and contraction, all in Spark; no links reach the driver.

With 48 bands of 6 rows, two texts just at the threshold share no band with probability 8e-5, texts at
similarity 0.8 with 5e-7.

Defined results: NULL text or no words: empty set, linked with nothing, kept.  Fewer than five words:
the whole sequence is the one shingle.  NULL ids are never linked, and kept.  Rows that repeat an id share
the class of their own text; with equal texts they share one fate.  ``keep_first`` judges row by row
and keeps one row of a group, NULL and repeated ids included.  No rows: no rows.  Columns besides id
and text are not read, or come back unchanged from ``keep_first``.
"""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import byte_lengths, give_back, join_side, let_go, planned_by_rows, portions, small_batches, stored

WORDS = 5
PERCENT = 75
BANDS, ROWS = 48, 6
CHECKED, STEP = 128, 32
MISS = 1e-6
BATCH_BYTES = 4 << 20
PAIRS_PER_ROW = 1
#: Pairs per row from which a bucket is thick: its pairs are named by rare shingles instead.
THICK = 4
PIVOT_ROUNDS = 6

_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h):
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts):
    """Sorted distinct shingle hashes of each text of an Arrow string array."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.ascii_lower(pc.cast(pc.fill_null(texts, ""), pa.large_string()))
    split = pc.ascii_split_whitespace(texts)
    flat, offsets = split.flatten(), split.offsets.to_numpy()
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    keep = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(keep).dictionary_encode()
    at = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])[offsets]
    digest = hashlib.blake2b
    of_word = np.array([int.from_bytes(digest(w.encode(), digest_size=8).digest(), "little") for w in coded.dictionary.to_pylist()],
                       dtype=np.uint64)
    w = of_word[coded.indices.to_numpy()] if len(of_word) else np.zeros(0, np.uint64)
    h = np.zeros(max(len(w) - WORDS + 1, 0), dtype=np.uint64)
    for i in range(WORDS):
        h = _mixed(h * _MIX + w[i:i + len(h)])
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= WORDS:
            out.append(np.unique(h[a:b - WORDS + 1]))
        elif b > a:
            one = np.full(1, b - a, dtype=np.uint64)
            for x in w[a:b]:
                one = _mixed(one * _MIX + x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles):
    """Minimum of every hash function over a set."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        low = np.minimum(low, (x[i:i + 2048, None] * _MULTIPLY + _ADD).min(axis=0))
    return low


def band_keys(low):
    """One 64-bit key per band; the number of the band is part of it."""
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for row in low.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = _mixed(key * _MIX + row)
    return key.view(np.int64)


def _features(id_type):
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", id_type), ("n", pa.int64()), ("digest", pa.binary()),
                            ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
        for rows in portions(batches, lambda b: byte_lengths(b.column("text")), BATCH_BYTES):
            sets = shingle_sets(rows.column("text").combine_chunks())
            lows = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id").combine_chunks(), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([None if x is None else band_keys(x) for x in lows], schema.field("bands").type),
                pa.array([None if x is None else x[:CHECKED].astype("<u2").tobytes() for x in lows], pa.binary())], schema=schema)
            del rows, sets, lows
            give_back()

    return run


def _sets(id_type):
    def run(batches):
        import pyarrow as pa

        for rows in portions(batches, lambda b: byte_lengths(b.column("text")), BATCH_BYTES):
            sets = shingle_sets(rows.column("text").combine_chunks())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").combine_chunks(), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary()), rows.column("_wanted").combine_chunks()],
                names=["rep", "digest", "shingles", "_wanted"])

    return run


def fewest_matches(miss=MISS, percent=PERCENT):
    """For every number of compared hashes: matches below which a pair is dropped.

    The posterior after m of n matches is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    t, out = percent / 100, {}
    for n in range(STEP, CHECKED + 1, STEP):
        m = 0
        while sum(math.comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(m + 1)) < miss:
            m += 1
        out[n] = m
    return out


def _prune(batches):
    """Candidate pairs with both signatures to the pairs that may still reach the threshold."""
    import pyarrow as pa

    fewest = fewest_matches()
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, CHECKED) for c in ("sig_a", "sig_b"))
        alive = np.arange(len(a))
        matches = np.zeros(len(a), dtype=np.int64)
        for n in range(STEP, CHECKED + 1, STEP):
            matches[alive] += (a[alive, n - STEP:n] == b[alive, n - STEP:n]).sum(axis=1)
            alive = alive[matches[alive] >= fewest[n]]
        yield batch.select(["a", "b"]).take(pa.array(alive))


def _confirm(batches):
    import pyarrow as pa

    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= PERCENT * (len(x) + len(y) - common):
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _listed(batches):
    """Sets as bytes to lists of numbers, with their sizes."""
    import pyarrow as pa

    for rows in portions(batches, lambda b: byte_lengths(b.column("shingles")), BATCH_BYTES):
        data = [np.frombuffer(x, np.int64) for x in rows.column("shingles").to_pylist()]
        n = np.array([len(x) for x in data], dtype=np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(data)))
        yield pa.RecordBatch.from_arrays([rows.column("rep").combine_chunks(), pa.array(n), lists], names=["rep", "n", "shingles"])
        del rows, data, lists
        give_back()


def _with_both(pairs, side, value, out):
    """Adds ``value`` of both ends of every pair."""
    for end in ("a", "b"):
        pairs = pairs.join(side.select(F.col("rep").alias(end), F.col(value).alias(f"{out}_{end}")), end)
    return pairs


class _Verifier:
    """Verifies candidate pairs: signatures first, full sets for those that survive."""

    def __init__(self, docs, reps, kind):
        self.docs, self.reps, self.kind = docs, reps, kind
        self.pair = T.StructType([T.StructField(c, kind) for c in ("a", "b")])

    def links(self, pairs):
        alive = stored(_with_both(pairs, self.reps, "sig", "sig").mapInArrow(_prune, self.pair))
        sets = self.sets_of(alive.select(F.col("a").alias("rep")).union(alive.select(F.col("b").alias("rep"))).distinct())
        return stored(_with_both(alive, sets, "shingles", "set").mapInArrow(_confirm, self.pair))

    def sets_of(self, ends):
        """The shingle sets of some representatives."""
        from pyspark.sql.pandas.types import to_arrow_type

        ends = stored(ends.join(self.reps.select("rep", "digest"), "rep").withColumnsRenamed({"rep": "doc_id", "digest": "_wanted"}))
        n = ends.count()
        schema = T.StructType([T.StructField("rep", self.kind), T.StructField("digest", T.BinaryType()),
                               T.StructField("shingles", T.BinaryType()), T.StructField("_wanted", T.BinaryType())])
        wanted = join_side(self.docs, ends, "doc_id", n, ["doc_id"], "inner")
        # A repeated id can have several texts; the set is the one the representative was made of.
        sets = stored(wanted.mapInArrow(_sets(to_arrow_type(self.kind)), schema).filter("digest = _wanted").select("rep", "shingles"))
        if sets.count() > n:
            sets = sets.dropDuplicates(["rep"])
        return sets

    def rare_pairs(self, rows):
        """(rep, other) of bucket rows of different components that share one of their rarest shingles.

        Two sets at the threshold t share at least 2t/(1+t) of the smaller set and t of the larger one, so in
        any one order of all shingles the first that both have stands so early in each that the rest can
        still make up that share.  The order is by number of sets, which puts those first that no other set
        has; they are counted, not carried.  A pair is made where its first common shingle leaves enough of
        both sets.
        """
        members = stored(rows.select("rep", "root").distinct())
        schema = T.StructType([T.StructField("rep", self.kind), T.StructField("n", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
        each = self.sets_of(members.select("rep")).mapInArrow(_listed, schema).select("rep", "n", F.explode("shingles").alias("shingle"))
        common = stored(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1"))
        met = join_side(each, common, "shingle", common.count(), ["rep"], "inner").groupBy("rep").agg(
            F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("met"))
        met = stored(met.join(members, "rep").withColumn("c", F.size("met").cast("long")))

        def first(share, of):
            """Shingles up to which a set still holds ``share / of`` of its size."""
            return F.posexplode(F.expr(f"slice(met.shingle, 1, cast(greatest(0, c - ({share} * n + {of - 1}) DIV {of} + 1) AS int))")).alias("at", "shingle")

        small = met.select("rep", "root", "n", "c", first(2 * PERCENT, 100 + PERCENT))
        large = met.select(*[F.col(c).alias(f"{c}_2") for c in ("rep", "root", "n", "c")], first(PERCENT, 100)).withColumnRenamed("at", "at_2")
        enough = (100 + PERCENT) * F.least(F.col("c") - F.col("at"), F.col("c_2") - F.col("at_2")) >= PERCENT * (F.col("n") + F.col("n_2"))
        return small.join(large, "shingle").filter(
            enough & F.expr("root <> root_2 AND (n < n_2 OR n = n_2 AND rep < rep_2)")).select("rep", F.col("rep_2").alias("other"))


def components(links, rounds=64):
    """(node, root) for every node of the links; the root is the smallest node of its component.

    Every node hooks on its smallest neighbour, the trees are flattened by pointer jumping and
    contracted, until no link is left; each round at least halves the nodes that have links.
    """
    edges, nodes = links.filter("a <> b"), None
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
        if parent.isEmpty():
            break
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = stored(parent.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            parent = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
        if nodes is None:
            nodes = parent
        else:
            nodes = stored(nodes.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(parent.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end)
        edges = stored(ends.filter("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
    return nodes if nodes is not None else parent.select("node", "root")


def _buckets(reps):
    """(key, rep) of the band keys that at least two representatives have."""
    every = reps.select("rep", F.explode("bands").alias("key"))
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    return stored(every.join(shared, "key"))


def _open_rows(rows, roots):
    """Bucket rows with their component, for buckets that still hold more than one."""
    rows = rows.select("key", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    return rows.join(mixed, "key")


def near_links(docs, reps, kind):
    """Components of the representatives: (node, root) for those that have links."""
    check = _Verifier(docs, reps, kind)
    rows = _buckets(reps).withColumn("root", F.col("rep"))
    links, roots, tested, before = None, None, None, math.inf
    for turn in range(PIVOT_ROUNDS + 1):
        if turn:
            rows = stored(_open_rows(rows, roots))
        sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("key").agg(
            F.sum("c").alias("m"), ((F.sum("c") ** 2 - F.sum(F.col("c") ** 2)) / 2).alias("pairs"))
        total = sizes.agg(F.sum("m").alias("rows"), F.sum("pairs").alias("pairs")).first()
        if not total["rows"]:
            break
        every = turn == PIVOT_ROUNDS or total["pairs"] <= PAIRS_PER_ROW * total["rows"] or total["pairs"] > before / 4
        before = total["pairs"]
        if every and total["pairs"] > PAIRS_PER_ROW * total["rows"]:
            thick = stored(sizes.filter(F.col("pairs") > THICK * F.col("m")).select("key"))
            thin = rows.join(thick, "key", "left_anti")
            other = thin.select("key", F.col("rep").alias("other"), F.col("root").alias("other_root"))
            pairs = thin.join(other, "key").filter("rep < other AND root <> other_root").select("rep", "other").unionByName(
                check.rare_pairs(rows.join(thick, "key", "left_semi")))
        elif every:
            other = rows.select("key", F.col("rep").alias("other"), F.col("root").alias("other_root"))
            pairs = rows.join(other, "key").filter("rep < other AND root <> other_root")
        else:
            pivot = rows.groupBy("key").agg(F.min_by(F.struct("rep", "root"), F.xxhash64("rep", F.lit(turn))).alias("p"))
            pairs = rows.join(pivot.select("key", F.col("p.rep").alias("other"), F.col("p.root").alias("other_root")), "key").filter(
                "root <> other_root")
        pairs = pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        found = check.links(pairs)
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        roots = stored(components(links))
        let_go(docs.sparkSession)
        if every:
            break
    return roots


def near_duplicates(docs):
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    planned_by_rows(small_batches(docs.sparkSession))
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()),
                           T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])
    made = stored(rows.mapInArrow(_features(to_arrow_type(kind)), schema))
    classes = stored(made.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    first = made.select("digest", F.col("doc_id").alias("rep"), "bands", "sig").join(
        classes.select("digest", "rep"), ["digest", "rep"]).dropDuplicates(["digest"])
    reps = stored(first)
    roots = near_links(rows, reps, kind)
    changed = classes
    if roots is None:
        changed = changed.withColumn("root", F.col("rep"))
    else:
        changed = changed.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    changed = stored(changed.filter("copies > 1 OR root <> rep").select("digest", F.col("root").alias("class_root")))
    out = join_side(made.select("doc_id", "n", "digest"), changed, "digest", changed.count(), ["doc_id"])
    component = F.coalesce("class_root", "doc_id")
    let_go(docs.sparkSession)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs):
    """One row of each group of ``docs``, that of the smallest id, with exactly their columns.

    Rows are told apart by a number of their own, so repeated and NULL ids are judged row by row; of
    equal ids the first row as written stays, and a NULL id stays only where the group has no other.
    """
    keyed = cut_lineage(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_rid")))
    groups = near_duplicates(keyed.select(F.col("_rid").alias("doc_id"), F.col("_row.text").alias("text")))
    ids = keyed.select("_rid", F.col("_row.doc_id").alias("id"))
    ids = stored(groups.select(F.col("doc_id").alias("_rid"), "component_id").join(ids, "_rid"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_rid"))
    firsts = stored(ids.groupBy("component_id").agg(least.alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "component_id", F.col("least._rid").alias("first")))
    gone = stored(join_side(ids, firsts, "component_id", firsts.count(), ["_rid"], "inner").filter("_rid <> first").select("_rid"))
    marked = join_side(keyed, gone.withColumn("_gone", F.lit(True)), "_rid", gone.count(), ["_rid"])
    return marked.filter("_gone IS NULL").select("_row.*")
