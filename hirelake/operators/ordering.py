"""Order, paging, caps and first-of-kind selection."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import vocab
from ..session import cut_lineage

_c = F.col


def store_sort_keys():
    """Newest first, then the most complete, then the latest seen; arrival breaks ties."""
    return [_c("posted_at").desc(), _c("quality_score").desc(), _c("scraped_at").desc(), _c("arrival").asc()]


def store_order(postings):
    return postings.orderBy(*store_sort_keys())


def page_postings(postings, offset=0, limit=100, sort_keys=None):
    """One page of the stored order.  The total is ``postings.count()``, taken before paging."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    if not 1 <= limit <= 500:
        raise ValueError("limit must lie between 1 and 500")
    return postings.orderBy(*(sort_keys or store_sort_keys())).offset(offset).limit(limit)


def unique_first(df, key="id", order="arrival"):
    """First row per key (``dropDuplicates`` would keep an arbitrary one)."""
    return top_n_per_key(df, key, order, 1)


def top_n_per_key(df, key, order, n):
    """First ``n`` rows of each key in ``order``.

    Spark plans the rank filter with a group limit before the shuffle, so at most ``n`` rows per key
    leave a map task however many the key has.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_rank", rank).filter(_c("_rank") <= n).drop("_rank")


def cap_per_source(postings, n=vocab.MAX_PER_SOURCE):
    return top_n_per_key(postings, "source", "arrival", n)


def union_sources(frames):
    """All rows of several adapters; columns an adapter lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_rank(ordered, name):
    """Number an ordered DataFrame 1..n across partitions.

    Partition number and position are taken while the sorted rows are written out, so both uses
    below agree.  The offset of a partition is the count of the partitions before it (one row per
    partition, however large the data).
    """
    tagged = cut_lineage(ordered.withColumns({
        "_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}))
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    position = _c("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.join(F.broadcast(offsets), "_pid").withColumn(
        name, _c("_off") + position + 1).drop("_pid", "_mid", "_off")
