"""Running aggregates that never put a whole key into one task."""

from pyspark.sql import Window
from pyspark.sql import functions as F

BUCKET_BITS = 18
#: Keys are counted by hash, so that a count has few rows however many keys there are.
HASHES = 1 << 16


def _hash(key):
    return F.pmod(F.xxhash64(key), F.lit(HASHES)).cast("int")


def crowded(df, key, bucket_bits=None):
    """Hashes of ``key`` under which ``df`` has more rows than one range of ``running_before`` holds.

    At most one for every ``2**bucket_bits`` rows.
    """
    bits = running_before.__defaults__[0] if bucket_bits is None else bucket_bits
    counts = df.groupBy(_hash(key).alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
    return [r[0] for r in counts.filter(F.col("_n") > (1 << bits)).select("_hash").collect()]


def running_before(df, key, order, specs, bucket_bits=BUCKET_BITS, *, hot=None):
    """Aggregates over the rows of the same ``key`` that come strictly before a row.

    ``specs`` maps an output name to ``(kind, column)``; kinds: first, last (ignoring NULLs), min,
    max, sum, bit_or.  ``order`` is a LONG column, unique within a key.

    Each key is cut into ranges of ``2**bucket_bits`` order values.  Ranges are reduced to one row
    each, the reduced rows are scanned per key, and the carry is added to a window inside every
    range.  A key with a third of all rows is therefore spread over many tasks.  With ``hot``, the hashes
    that ``crowded`` names, other keys stay in one piece: small keys need no second pass.
    """
    part = F.shiftright(F.col(order), bucket_bits)
    if hot is not None:
        part = F.when(_hash(key).isin(hot), part).otherwise(0) if hot else F.lit(0)
    keyed = df.withColumn("_b", part.cast("bigint")).withColumns(
        {f"_in_{n}": col for n, (_, col) in specs.items()})

    def reduce_range(n, kind):
        v = F.col(f"_in_{n}")
        if kind == "first":
            return F.min_by(v, F.when(v.isNotNull(), F.col(order)))
        if kind == "last":
            return F.max_by(v, F.when(v.isNotNull(), F.col(order)))
        return {"min": F.min, "max": F.max, "sum": F.sum, "bit_or": F.bit_or}[kind](v)

    def scan(kind, v, win):
        if kind == "first":
            return F.first(v, ignorenulls=True).over(win)
        if kind == "last":
            return F.last(v, ignorenulls=True).over(win)
        return {"min": F.min, "max": F.max, "sum": F.sum, "bit_or": F.bit_or}[kind](v).over(win)

    def combine(kind, carry, local):
        if kind == "first":
            return F.coalesce(carry, local)
        if kind == "last":
            return F.coalesce(local, carry)
        if kind == "min":
            return F.least(carry, local)
        if kind == "max":
            return F.greatest(carry, local)
        zero = F.lit(0).cast("bigint")
        carry, local = F.coalesce(carry, zero), F.coalesce(local, zero)
        return carry + local if kind == "sum" else carry.bitwiseOR(local)

    if hot == []:
        whole = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        zero = F.lit(0).cast("bigint")
        alone = lambda kind, v: F.coalesce(v, zero) if kind in ("sum", "bit_or") else v
        seen = keyed.withColumns({f"_local_{n}": scan(kind, F.col(f"_in_{n}"), whole) for n, (kind, _) in specs.items()})
        return seen.select(*df.columns, *[alone(kind, F.col(f"_local_{n}")).alias(n) for n, (kind, _) in specs.items()])

    cut = keyed if hot is None else keyed.filter(_hash(key).isin(hot))
    ranges = cut.groupBy(key, "_b").agg(*[
        reduce_range(n, kind).alias(f"_in_{n}") for n, (kind, _) in specs.items()])
    across = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first_range = F.min("_b").over(Window.partitionBy(key))
    carried = ranges.select(
        key, "_b", first_range.alias("_b0"),
        *[scan(kind, F.col(f"_in_{n}"), across).alias(f"_carry_{n}") for n, (kind, _) in specs.items()],
    ).filter(F.col("_b") > F.col("_b0")).drop("_b0")

    inside = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumns({
        f"_local_{n}": scan(kind, F.col(f"_in_{n}"), inside) for n, (kind, _) in specs.items()})
    joined = local.join(carried, [key, "_b"], "left")
    return joined.select(*df.columns, *[
        combine(kind, F.col(f"_carry_{n}"), F.col(f"_local_{n}")).alias(n)
        for n, (kind, _) in specs.items()])
