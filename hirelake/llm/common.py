"""Small helpers that the corpus operators share."""

import ctypes
import gc

import numpy as np
import zstandard
from pyspark.sql import functions as F

from ..session import scratch_path

#: Characters between words, as Java and Python patterns.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a side may be broadcast; its count is always taken first.
BROADCAST_ROWS = 100_000
SALTS = 16
#: Bytes that the rows of an interim table take in memory for a byte of their tightly compressed file.
UNPACKED = 10


def give_back():
    """Return the freed memory of a Python worker to the machine, that of Arrow and of the C library.

    Workers live through many stages; what an earlier one has freed would else stay with them.
    """
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark):
    """Arrow batches of few rows, so that very long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def planned_by_rows(spark):
    """Sizes for choosing joins are those of the rows in memory, not of their compressed files.

    Tables of links take a few bytes a row in a file and many times that in a broadcast, which the
    driver has to hold; by the files' sizes it would be sent tables of millions of rows.
    """
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(UNPACKED))
    return spark


def let_go(spark):
    """Have the driver drop the broadcasts and shuffles of finished steps.

    It drops them only when its memory is collected, which many small steps may not cause for long;
    a full collection also returns free memory to the machine.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words(text):
    """Words of a text column; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def fold(key, n):
    """crc32 of the key written as text, modulo ``n``; NULL keys count as fold -1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(-1))


def join_side(left, right, key, rows, salt_by, how="left"):
    """Join ``right`` (unique on ``key``) to ``left``, whose keys may be very uneven.

    Up to ``BROADCAST_ROWS`` rows the right side is broadcast; a larger one is repeated once per
    salt and the left rows choose a salt by ``salt_by``, so that no key stays in one task.
    """
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    salted = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*([key] if isinstance(key, str) else key), "_salt"], how).drop("_salt")


def stored(df, *partition_by):
    """Write the rows to the shared folder, compressed tightly, and read them back."""
    path = scratch_path(df.sparkSession, "rows")
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df):
    """Delete the interim table that ``df`` reads, once nothing else reads it."""
    spark = df.sparkSession
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pack_ints(values):
    """Compressed bytes of an integer array; small numbers take little room."""
    planes = np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack_ints(data):
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def spans(starts, lengths):
    """Positions of many ranges, one after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)


def portions(batches, size_of, most):
    """Regroup Arrow batches into tables of about ``most`` bytes, cutting between rows only."""
    import pyarrow as pa

    held, weight = [], 0
    for batch in batches:
        sizes = np.cumsum(size_of(batch) + 16)
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            end = max(int(np.searchsorted(sizes, before + most - weight, side="right")), at + (not held))
            if end > at:
                held.append(batch.slice(at, end - at))
                weight += int(sizes[end - 1]) - before
            at = end
            if at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, weight = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def byte_lengths(column):
    """Length in bytes of every value, 0 for NULL."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
