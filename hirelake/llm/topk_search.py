"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Vectors are quantised and gathered into blocks; each block keeps one list per dimension, sorted by
that component and stored with it.  Queries walk the lists from the ends their signs favour, some
queries at a time; whatever one of them meets is scored for all of them by one matrix product.  A
query stops as soon as the best score that an unmet vector could have, the sum of the components at
the current depth, is below its k-th best.  The k-th best is carried from block to block, so later
blocks often stop early.  Equal bounds go on, because ties go to the smaller id.

Every vector block meets every query block in a nested loop over the two stored tables: pairs of
blocks go straight to the search and are neither shuffled, sorted, broadcast nor written.  No block
grows with the data; per query and task k rows remain.

Defined results: rows with NULL id, NULL vector, or a NULL or non-finite component take no part.
Vectors are compared with vectors of the same length only.  Rows that repeat an id are candidates
each, and an id is listed once with its best score; a query never meets its own id.  Scores beyond
a long are kept at its limits.  No rows: no rows.  Other columns are not read.
"""

from contextlib import contextmanager

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import small_batches, stored

K = 5
SCALE = 256
BLOCK = 4096
QUERY_BLOCK = 1024
#: Query blocks that a task holds next to its vector blocks.
QUERY_BLOCKS = 8
#: Pairs of blocks, about 3 MB each, in an Arrow batch.
PAIRS = 4
#: Queries of a block that walk its lists together.
TOGETHER = 128
FIRST_DEPTH = 32
_PLACE = np.uint16
_BLOCKS = "block long, dim int, n int, ids binary, vectors binary, lists binary"


def _gather(most, listed):
    """Vectors to blocks of at most ``most`` of one length; ``listed`` blocks get their sorted lists."""
    def run(batches):
        import pyarrow as pa

        part, made, held = TaskContext.get().partitionId(), 0, {}

        def out(dim):
            nonlocal made
            ids, rows = map(np.concatenate, zip(*held.pop(dim)))
            made += 1
            lists = np.argsort(rows, axis=0, kind="stable").astype(_PLACE).tobytes() if listed else None
            return pa.RecordBatch.from_pylist([{
                "block": (part << 24) + made, "dim": dim, "n": len(ids), "ids": ids.tobytes(), "vectors": rows.tobytes(), "lists": lists}],
                schema=pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()),
                                  ("ids", pa.binary()), ("vectors", pa.binary()), ("lists", pa.binary())]))

        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(sizes) - sizes
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                got = np.floor(flat[starts[rows][:, None] + np.arange(dim)] * SCALE)
                for i in range(0, len(rows), most):
                    held.setdefault(dim, []).append((ids[rows[i:i + most]], got[i:i + most]))
                    if sum(len(x) for x, _ in held[dim]) >= most:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return run


def _load(ids, vectors, dim):
    ids = np.frombuffer(ids, dtype=np.int64)
    return ids, np.frombuffer(vectors, dtype=np.float64).reshape(len(ids), dim)


def threshold_search(x, lists, q, bests, k, ids, own, distinct):
    """Walk the lists of one block for some queries together; ``bests`` holds (score, -id) of earlier blocks.

    What any of the queries meets is scored for all that still walk.
    """
    n, dims = len(x), np.arange(x.shape[1])
    walking = np.arange(len(q))
    seen = np.zeros(n, dtype=bool)
    at, depth = 0, FIRST_DEPTH
    while at < n and len(walking):
        upto = min(depth, n)
        asked = q[walking]
        up, down = (asked > 0).any(axis=0), (asked < 0).any(axis=0)
        fresh = np.zeros(n, dtype=bool)
        if up.any() or down.any():
            # The list holds ascending components: the last ones are best for a positive weight.
            fresh[lists[n - upto:n - at, up].ravel()] = True
            fresh[lists[at:upto, down].ravel()] = True
            fresh &= ~seen
        else:
            fresh, upto = ~seen, n
        seen |= fresh
        new = np.flatnonzero(fresh)
        if len(new):
            scores = asked @ (x.T if len(new) == n else x[new].T)
            least = np.array([bests[j][-1][0] if len(bests[j]) == k else -np.inf for j in walking], dtype=scores.dtype)
            some = scores >= least[:, None]
            for row in np.flatnonzero(some.any(axis=1)):
                j, which = walking[row], np.flatnonzero(some[row])
                got = scores[row, which]
                if distinct and len(got) > 4 * k:  # k of them besides the query's own are enough
                    cut = np.partition(got, len(got) - 2 * k)[len(got) - 2 * k]
                    which, got = which[got >= cut], got[got >= cut]
                found = {(s, -i) for s, i in zip(got.tolist(), ids[new[which]].tolist()) if i != own[j]}
                bests[j] = _one_per_id(sorted(found.union(bests[j]), reverse=True))[:k]
        at, depth = upto, 2 * depth
        if at < n:
            edge = np.maximum(asked, 0) @ x[lists[n - at - 1], dims] + np.minimum(asked, 0) @ x[lists[at], dims]
            walking = np.array([j for j, e in zip(walking.tolist(), edge.tolist()) if len(bests[j]) < k or e >= bests[j][-1][0]], dtype=np.int64)


def _one_per_id(best):
    ids, out = set(), []
    for s, i in best:
        if i not in ids:
            ids.add(i)
            out.append((s, i))
    return out


def _search(k):
    """The best of every query over the vector blocks of a task."""
    def run(batches):
        import pyarrow as pa

        limit = 2**63 - 1
        held = {}  # by query block: ids, and the best of each query so far
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                q_ids, q = _load(r["q_ids"], r["q_vectors"], r["dim"])
                ids, x = _load(r["ids"], r["vectors"], r["dim"])
                _, bests = held.setdefault(r["q_block"], (q_ids, [[] for _ in q_ids]))
                distinct = len(np.unique(ids)) == len(ids)
                lists = np.frombuffer(r["lists"], dtype=_PLACE).reshape(x.shape)
                most = max(np.abs(x).max(initial=0), 1) * max(np.abs(q).max(initial=0), 1) * max(r["dim"], 1)
                if most >= 2**53:  # beyond exact doubles: whole numbers of any size
                    x, q = (np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape) for m in (x, q))
                for at in range(0, len(q), TOGETHER):
                    some = slice(at, at + TOGETHER)
                    part = bests[some]
                    threshold_search(x, lists, q[some], part, k, ids, q_ids[some].tolist(), distinct)
                    bests[some] = part
        for q_ids, bests in held.values():
            got = [(int(q), -i, max(-limit - 1, min(limit, int(s)))) for q, b in zip(q_ids, bests) for s, i in b]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in got], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return run


@contextmanager
def _batches_of(spark, rows):
    """Arrow batches of ``rows`` rows for what is run meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def top_k(vectors, is_query, k=K):
    """The ``k`` highest integer inner products of every query among all other vectors.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on ``vec_id``.
    """
    spark = small_batches(vectors.sparkSession)
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = usable.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine))
    blocks = stored(usable.mapInArrow(_gather(BLOCK, True), _BLOCKS))
    asked = stored(usable.filter(is_query))
    # Few queries to a task would be many small blocks; their number is taken from the table, not from the cores.
    asked = asked.coalesce(max(1, -(-asked.count() // (QUERY_BLOCK * QUERY_BLOCKS))))
    queries = stored(asked.mapInArrow(_gather(QUERY_BLOCK, False), _BLOCKS)).select(
        F.col("block").alias("q_block"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    pairs = blocks.join(queries.hint("shuffle_replicate_nl"), F.col("dim") == F.col("q_dim")).select(
        "q_block", "q_ids", "q_vectors", "dim", "ids", "vectors", "lists")
    with _batches_of(spark, PAIRS):
        found = stored(pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long"))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
