"""Prefix trie of conversations in balanced parentheses, shard by shard.

A node is a distinct sequence of first turns.  Its key is a digest of depth and of running sums of the
turns' digests (each made of place, role and text), so that a very long conversation is summed by
ranges and not walked.  Members, children and ends of a node are counts by key.

Only forks enter the parentheses: the root and the nodes at which a conversation ends or paths part.
All other nodes hand their members on to a single child; they belong to the chain of the next fork
below.  A conversation passes at most about ``sqrt(2 * rows)`` forks, as each but the last has another
conversation of its own that is as long as the fork is deep.

Every leaf is a row with its path of forks.  Rows are dealt in ranges of their paths and cut into shards
of ``SHARD_NODES`` nodes.  A shard is written as balanced parentheses; the excess is kept with its least
and greatest value by block.  ``find_close`` skips blocks to the end of a subtree, the rank of pairs
``()`` counts its leaves, a cumulative array gives what it saves.  The paths of the first and the last
row of a shard, its spines, may go on in other shards: they keep the sums of what hangs off them and form
the rows of the next, far smaller round, in which equal spines merge.  The last round is one shard.

Defined results: NULL role or text counts as empty, a NULL turn comes first; equal turns of a
conversation are ordered by role and text, and repeated rows are turns each.  Rows without ``conv_id``
belong to no conversation.  No conversations: no rows.  Extra columns are not read.  A conversation may
hold any part of all rows; only the digest of a node's ends is one stream, of a row for every 4096 ids,
since SHA-256 has no mergeable state.
"""

import hashlib

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.running import running_before
from ..session import cut_lineage
from .common import WORD

SHARD_NODES = 1 << 17
SHARD_ROWS = 4  # a shard has at least as many rows, so that every round has at most half the rows
BLOCK = 256
RANGE_BITS = 10
FAMILY, SHARED = 20, 4  # conversations of a family share fewer than SHARED first turns
END_BITS = 12
_SUMS = ("s0", "s1", "s2", "s3")
_OUT = "kind int, key binary, leaves long, saved long, path array<struct<key: binary, saved: long, leaves: long>>"
SOLVED, HANGING, SPINE = 0, 1, 2


def ordered_turns(conversations):
    """conv_id, pos, role, text; places are counted by ranges of turn numbers, then of the ranges before."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.shiftright(F.col("turn").cast("long"), RANGE_BITS), F.lit(-(2**62))).alias("range"))
    inside = Window.partitionBy("conv_id", "range").orderBy(F.asc_nulls_first("turn"), "role", "text")
    across = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "range", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    return rows.withColumn("at", F.row_number().over(inside)).join(before, ["conv_id", "range"]).select(
        "conv_id", (F.col("before") + F.col("at") - 1).alias("pos"), "role", "text")


def rebuild(conversations):
    """Turns (conv_id, pos, role, text, length) and conversations (conv_id, length) after sharing.

    A conversation takes its first turns, up to three by a hash of its id, from the first of its family.
    """
    turns = cut_lineage(ordered_turns(conversations))
    conv = F.col("conv_id")
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "base": conv - conv % FAMILY, "h": F.crc32(conv.cast("string").cast("binary")) % SHARED})
    heads = turns.filter(F.col("pos") < SHARED - 1).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("head"))
    known = own.join(heads, "base", "left").withColumn(
        "head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("h").cast("int")))
    known = known.withColumn("m", F.size("head").cast("long")).withColumn(
        "length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    shared = known.select("conv_id", "length", F.explode("head").alias("t")).select(
        "conv_id", "t.pos", "t.role", "t.text", "length")
    rest = turns.join(known.select("conv_id", "h", "m", "length"), "conv_id").filter(F.col("pos") >= F.col("h")).select(
        "conv_id", (F.col("m") + F.col("pos") - F.col("h")).alias("pos"), "role", "text", "length")
    return shared.unionByName(rest), known.select("conv_id", "length")


def _key(depth, sums):
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


_ROOT = hashlib.md5(b"0,0,0,0,0").digest()


def prefixes(turns):
    """One row for each turn: its node, the node above, its words, and whether the conversation ends."""
    made = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), F.length("role").cast("string"),
                              F.concat("role", "text")).cast("binary"), 256)
    own = turns.select("conv_id", "pos", "length", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), *[
        F.conv(F.substr(made, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long").alias(f"d{i}") for i in range(4)])
    run = running_before(own, "conv_id", "pos", {s: ("sum", F.col(f"d{i}")) for i, s in enumerate(_SUMS)})
    before = [F.coalesce(s, F.lit(0)) for s in _SUMS]
    return run.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "words", (F.col("pos") + 1 == F.col("length")).alias("ends"),
        _key(F.col("pos") + 1, [b + F.col(f"d{i}") for i, b in enumerate(before)]).alias("key"),
        _key(F.col("pos"), before).alias("above"))


def _end_digests(batches):
    """Id lists of nodes, sorted by node and range, to one digest for each node."""
    import pyarrow as pa

    key, state = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key:
                if key is not None:
                    yield row()
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if key is not None:
        yield row()


def end_digests(ends):
    """``key`` and ``conv_id`` of ends to the digest of a node's ids in order."""
    ids = ends.groupBy("key", F.shiftright("conv_id", END_BITS).alias("range")).agg(F.array_join(
        F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return ids.repartition("key").sortWithinPartitions("key", "range").select("key", "ids").mapInArrow(
        _end_digests, "key binary, ends_sha256 string")


def find_close(excess, least, most, i):
    """The parenthesis that closes the one at ``i``: the first later one at which the excess is lower."""
    low = excess[i] - 1
    end = (i // BLOCK + 1) * BLOCK
    inside = np.flatnonzero(excess[i + 1:end] == low)
    if len(inside):
        return i + 1 + int(inside[0])
    b = end // BLOCK
    b += int(np.argmax((least[b:] <= low) & (low <= most[b:])))
    return b * BLOCK + int(np.argmax(excess[b * BLOCK:(b + 1) * BLOCK] == low))


class Shard:
    """Balanced parentheses of rows in order of their paths."""

    def __init__(self):
        self.signs, self.nodes, self.path = [], [], []  # nodes: (key, saved, leaves) in order of opening
        self.rows = 0

    def add(self, path):
        """A row's path, (key, saved, leaves) from the root on."""
        same = 0
        while same < min(len(path), len(self.path)) and path[same][0] == self.path[same][0]:
            same += 1
        if not self.signs:
            self.first = path
        self.signs += [-1] * (len(self.path) - same) + [1] * (len(path) - same)
        self.nodes += path[same:]
        self.path = path
        self.rows += 1

    def sums(self, pairs, whole):
        """Rows for the solved nodes, what hangs off the spines, and the spines themselves.

        With ``pairs`` a leaf is a pair ``()``, else leaves come with the nodes.  A ``whole`` shard is the
        only one and has no spines.
        """
        signs = np.array(self.signs + [-1] * len(self.path), dtype=np.int8)
        excess = np.cumsum(signs, dtype=np.int64)
        cuts = np.arange(0, len(excess), BLOCK)
        least, most = np.minimum.reduceat(excess, cuts), np.maximum.reduceat(excess, cuts)
        opens = np.flatnonzero(signs == 1)
        leaf = np.append((signs[:-1] == 1) & (signs[1:] == -1), False)[opens].astype(np.int64)
        keys = [n[0] for n in self.nodes]
        own_saved = np.array([n[1] for n in self.nodes], dtype=np.int64)
        own_leaves = leaf if pairs else np.array([n[2] for n in self.nodes], dtype=np.int64)
        at = {k: i for i, k in enumerate(keys)}
        spines = [] if whole else [[at[n[0]] for n in p] for p in (self.first, self.path)]
        on_spine = np.zeros(len(keys), dtype=bool)
        for spine in spines:
            on_spine[spine] = True
        ranks = []
        for own in (own_leaves, own_saved):
            cumulative = np.zeros(len(signs) + 1, dtype=np.int64)
            cumulative[opens + 1] = np.where(on_spine, 0, own)
            ranks.append(np.cumsum(cumulative))
        closes = np.array([find_close(excess, least, most, i) for i in opens.tolist()], dtype=np.int64)
        leaves, saved = (r[closes] - r[opens] for r in ranks)
        out = [(SOLVED, keys[i], int(leaves[i]), int(saved[i]), None) for i in np.flatnonzero(~on_spine).tolist()]
        hanging = {}
        for spine in spines:
            for i, below in zip(spine, [*spine[1:], None]):
                hanging.setdefault(i, set()).add(below)
        for i, below in hanging.items():
            below = [j for j in below if j is not None]
            out.append((HANGING, keys[i], int(leaves[i] - leaves[below].sum()), int(saved[i] - saved[below].sum()), None))
        for spine in spines[:1] if spines and spines[0] == spines[1] else spines:
            out.append((SPINE, None, None, None, [
                {"key": keys[i], "saved": int(own_saved[i]), "leaves": int(own_leaves[i])} for i in spine]))
        return out


def _shards(pairs, single, most):
    """Rows in order of their paths to the sums of their nodes."""
    def run(batches):
        import pyarrow as pa

        node = pa.struct([("key", pa.binary()), ("saved", pa.int64()), ("leaves", pa.int64())])
        types = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(node))

        def batch_of(rows):
            for i in range(0, len(rows), 1 << 14):
                part = rows[i:i + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate(types)],
                                                 names=["kind", "key", "leaves", "saved", "path"])

        shard, cut = Shard(), False
        for batch in batches:
            for path in batch.column("path").to_pylist():
                if len(shard.nodes) >= most and shard.rows >= SHARD_ROWS:
                    yield from batch_of(shard.sums(pairs, False))
                    shard, cut = Shard(), True
                shard.add([(n["key"], n["saved"], n["leaves"]) for n in path])
        if shard.signs:
            yield from batch_of(shard.sums(pairs, single and not cut))

    return run


def subtree_sums(paths, most=SHARD_NODES):
    """Leaves and savings of every fork's subtree from the paths of all leaves: key, leaves, saved."""
    solved, pairs = [], True
    order = F.array_join(F.transform("path", lambda n: F.hex(n["key"])), "")
    while True:
        paths = cut_lineage(paths)
        rows, nodes = paths.agg(F.count(F.lit(1)), F.sum(F.size("path"))).first()
        n = max(1, min((nodes or 0) // most, rows // (2 * SHARD_ROWS), int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        dealt = paths.withColumn("order", order)
        dealt = dealt.repartitionByRange(n, "order") if n > 1 else dealt.coalesce(1)
        out = cut_lineage(dealt.sortWithinPartitions("order").select("path").mapInArrow(_shards(pairs, n == 1, most), _OUT))
        solved.append(out.filter(F.col("kind") == SOLVED).select("key", "leaves", "saved"))
        spines = out.filter(F.col("kind") == SPINE).select("path")
        if spines.isEmpty():
            break
        hanging = out.filter(F.col("kind") == HANGING).groupBy("key").agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        each = spines.withColumn("order", order).dropDuplicates(["order"]).select("order", F.posexplode("path").alias("i", "n"))
        each = each.select("order", "i", "n.*").join(hanging, "key")
        paths = each.groupBy("order").agg(F.sort_array(F.collect_list(F.struct(
            "i", "key", (F.col("saved") + F.col("more_saved")).alias("saved"),
            (F.col("leaves") + F.col("more_leaves")).alias("leaves")))).alias("path")).select(
            F.transform("path", lambda n: F.struct(n["key"].alias("key"), n["saved"].alias("saved"), n["leaves"].alias("leaves"))).alias("path"))
        pairs = False
    total = solved[0]
    for more in solved[1:]:
        total = total.unionByName(more)
    return total


def prefix_trie(turns, conversations, most=SHARD_NODES):
    """All nodes of the trie of ``turns`` (conv_id, pos, role, text, length) of ``conversations`` (conv_id, length)."""
    rows = cut_lineage(prefixes(turns))
    long = lambda c: F.lit(c).cast("long")
    nodes = rows.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("above").alias("above"),
        F.first("words").alias("words"), F.count(F.lit(1)).alias("n_convs"), F.count_if("ends").alias("n_ends"))
    root = conversations.agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.count_if(F.col("length") == 0).alias("n_ends")).filter("n_convs > 0")
    root = root.withColumns({"key": F.lit(_ROOT), "depth": long(0), "above": F.lit(None).cast("binary"), "words": long(0)})
    nodes = cut_lineage(nodes.unionByName(root))
    children = nodes.filter("above IS NOT NULL").groupBy(F.col("above").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", long(0)))
    fork = (F.col("n_children") != 1) | (F.col("n_ends") > 0) | (F.col("depth") == 0)
    nodes = nodes.withColumns({"fork": fork, "own": (F.col("n_convs") - 1) * F.col("words"), "up": -F.col("depth")})
    # A node's chain belongs to its smallest member, as the node below in it has the same members.
    nodes = cut_lineage(running_before(nodes, "conv_id", "up", {
        "next": ("last", F.when(F.col("fork"), F.col("key"))), "below": ("sum", F.col("own"))}).withColumns({
            "to": F.when(F.col("fork"), F.col("key")).otherwise(F.col("next")), "below": F.coalesce("below", long(0))}))
    chains = nodes.groupBy(F.col("to").alias("key")).agg(
        F.sum("own").alias("chain"), F.max(F.when(F.col("fork"), F.col("below"))).alias("fork_below"))
    forks = cut_lineage(chains)
    leaves = nodes.filter("n_children = 0").select("conv_id")
    node = lambda key, saved: F.struct(key.alias("key"), saved.alias("saved"), long(0).alias("leaves"))
    passed = rows.select("conv_id", "depth", "key").join(leaves, "conv_id").join(forks.select("key", "chain"), "key")
    paths = leaves.select("conv_id", long(0).alias("depth"), F.lit(_ROOT).alias("key"), long(0).alias("chain")).unionByName(
        passed.select("conv_id", "depth", "key", "chain"))
    paths = paths.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "chain"))).alias("path")).select(
        F.transform("path", lambda n: node(n["key"], n["chain"])).alias("path"))
    sums = forks.join(subtree_sums(paths, most), "key").select(
        F.col("key").alias("to"), "leaves", (F.col("saved") - F.col("chain")).alias("under"), "fork_below")
    ends = rows.filter("ends").select("key", "conv_id").unionByName(
        conversations.filter("length = 0").select(F.lit(_ROOT).alias("key"), "conv_id"))
    parents = nodes.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(sums, "to").join(parents, "above", "left").join(end_digests(ends), "key", "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("own") + F.col("below") - F.col("fork_below") + F.col("under")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


_CRC = """xor(list_reduce([ascii(x)::UBIGINT for x in string_split(c::VARCHAR, '')],
      lambda crc, b: list_reduce(range(8)::UBIGINT[], lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(crc, b)),
      4294967295::UBIGINT), 4294967295::UBIGINT)"""
SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, c - c % {FAMILY} AS base, ({_CRC} % {SHARED})::BIGINT AS h FROM (SELECT DISTINCT c FROM t)),
m AS (SELECT k.c, h, count(b.pos) AS m FROM k LEFT JOIN t b ON b.c = base AND b.pos < h GROUP BY k.c, h),
r AS (SELECT k.c, b.pos, role, text FROM k JOIN t b ON b.c = base AND b.pos < h
  UNION ALL SELECT t.c, m + t.pos - h, role, text FROM t JOIN m ON m.c = t.c WHERE t.pos >= h),
p AS (SELECT c, pos + 1 AS depth, len(regexp_extract_all(text, '{WORD}')) AS words, count(*) OVER (PARTITION BY c) = pos + 1 AS ends,
    list({{'r': role, 't': text}}) OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path FROM r
  UNION ALL SELECT c, 0, 0, c NOT IN (SELECT c FROM r), []::STRUCT(r VARCHAR, t VARCHAR)[] FROM k),
n AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY path, depth),
ch AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch ON ch.path = n.path),
s AS (SELECT path[1:d] AS path, sum((n_convs - 1) * words) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.path = f.path LEFT JOIN f u ON f.depth > 0 AND u.path = f.path[1:f.depth - 1]
"""
