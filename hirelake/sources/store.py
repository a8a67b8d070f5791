"""Posting table: full snapshots and the changes since, under one folder.

A commit is either full (``snapshot=<name>``: all postings, by source and by ranges of stored order) or
a change (``delta=<name>``: the records that a batch has inserted or altered).  With each goes an index
of signatures to records, the full one in buckets whose number follows the size of the table.  A merge
reads the buckets that its batch's signatures fall into, then the ranges that hold the records found,
and writes a change; what it costs follows the batch, not the table.  The commit's own row is written
last, so readers never see half a commit, and writing a name again replaces only that commit, which
makes replays harmless.

A record keeps its ``arrival`` for life, or until the next full snapshot numbers all records in stored
order.  Index entries are hints: a record that has lost a signature is found and does not match.
"""

from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring
from ..operators import merge
from ..operators.ordering import store_sort_keys, with_rank
from ..schema import POSTING_SCHEMA
from ..session import cut_lineage

_c = F.col
#: Records of a range and of an index bucket.
BUCKET_ROWS = 200_000
#: A full snapshot is due when the changes hold this share of its records, or after so many commits.
DUE_SHARE, DUE_COMMITS = 0.25, 24
FULL = "+full"
_SCHEMA = T.StructType([*POSTING_SCHEMA.fields, T.StructField("arrival", T.LongType())])
_INDEX = T.StructType([T.StructField("sig", T.StringType()), T.StructField("arrival", T.LongType())])
_COMMIT = "full boolean, buckets int, last long, rows long"


@dataclass(frozen=True)
class Commit:
    """A complete commit: ``last`` is the highest arrival so far, ``rows`` what the commit holds."""

    name: str
    full: bool
    buckets: int
    last: int
    rows: int


def _fs(spark, path):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def snapshots(spark, root):
    """Names of the complete commits, oldest first."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    names = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("commit=") and fs.exists(marker):
            names.append(name[len("commit="):])
    return sorted(names)


def history(spark, root, before=None, name=None):
    """The last full commit and the changes after it, oldest first; up to ``name`` or before ``before``."""
    chain = []
    for n in reversed([n for n in snapshots(spark, root) if (before is None or n < before) and (name is None or n <= name)]):
        r = spark.read.schema(_COMMIT).parquet(f"{root}/commit={n}").first()
        chain.append(Commit(n, r["full"], r["buckets"], r["last"], r["rows"]))
        if r["full"]:
            break
    return chain[::-1]


def _bucket(sig, n):
    return F.pmod(F.xxhash64(sig), F.lit(n)).cast("int")


def _signatures(postings):
    # The outer form, so that no filter on the list is inferred and pushed into its expression.
    pairs = postings.select("arrival", F.explode_outer(scoring.job_signatures()).alias("sig"))
    return pairs.filter(_c("sig").isNotNull()).distinct()


def _commit(spark, root, commit):
    row = spark.createDataFrame([(commit.full, commit.buckets, commit.last, commit.rows)], _COMMIT)
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/commit={commit.name}")


def write_postings(postings, root, name):
    """Write all postings in stored order as the full commit ``name``.

    ``arrival`` becomes the position in stored order, which breaks ties in later counts and pages.
    Files are split by source and by range of positions: a source filter reads only its own, a page only
    the ranges that hold its positions.
    """
    spark = postings.sparkSession
    ranked = with_rank(postings.orderBy(*store_sort_keys()), "_rank")
    out = ranked.select(*POSTING_SCHEMA.names, _c("_rank").alias("arrival"))
    rows = out.count()
    ranged = out.withColumn("range", F.expr(f"CAST((arrival - 1) DIV {BUCKET_ROWS} AS INT)"))
    ranged.repartition("source", "range").sortWithinPartitions("source", "range", "arrival").write.mode(
        "overwrite").partitionBy("source", "range").parquet(f"{root}/snapshot={name}")
    pairs = _signatures(out)
    buckets = max(1, -(-3 * rows // BUCKET_ROWS))
    pairs.withColumn("bucket", _bucket("sig", buckets)).repartition("bucket").sortWithinPartitions("bucket", "sig").write.mode(
        "overwrite").partitionBy("bucket").parquet(f"{root}/index={name}")
    _commit(spark, root, Commit(name, True, buckets, rows, rows))


def _full(spark, root, commit):
    schema = T.StructType([*_SCHEMA.fields, T.StructField("range", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{root}/snapshot={commit.name}")


def _changes(spark, root, commits):
    """The newest state of every record that ``commits`` have written."""
    parts = [spark.read.schema(_SCHEMA).parquet(f"{root}/delta={c.name}").select(
        *_SCHEMA.names, F.lit(i).alias("_at")) for i, c in enumerate(commits)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    newest = Window.partitionBy("arrival").orderBy(_c("_at").desc())
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "_at")


def read_postings(spark, root, name=None):
    """The table as of the newest commit (or the named one); None when there is none yet."""
    commits = history(spark, root, name=name)
    if not commits:
        return None
    base = _full(spark, root, commits[0]).select(*_SCHEMA.names)
    if len(commits) == 1:
        return base
    changed = _changes(spark, root, commits[1:])
    return base.join(changed.select("arrival"), "arrival", "left_anti").select(*_SCHEMA.names).unionByName(changed)


def lookup(spark, root, commits, incoming):
    """The records that hold, or have held, a signature of ``incoming``.

    Numbers of buckets and ranges come to the driver to prune the scans; there is one for every
    ``BUCKET_ROWS`` records.
    """
    base, later = commits[0], commits[1:]
    wanted = cut_lineage(_signatures(incoming).select("sig").distinct().withColumn("bucket", _bucket("sig", base.buckets)))
    touched = [r[0] for r in wanted.select("bucket").distinct().collect()]
    schema = T.StructType([*_INDEX.fields, T.StructField("bucket", T.IntegerType())])
    index = spark.read.schema(schema).parquet(f"{root}/index={base.name}").filter(_c("bucket").isin(touched)).select("sig", "arrival")
    for c in later:
        index = index.unionByName(spark.read.schema(_INDEX).parquet(f"{root}/index={c.name}"))
    found = cut_lineage(index.join(wanted.select("sig"), "sig", "left_semi").select("arrival").distinct())
    ranges = [r[0] for r in found.select(F.expr(f"CAST((arrival - 1) DIV {BUCKET_ROWS} AS INT)")).distinct().collect()]
    rows = _full(spark, root, base).filter(_c("range").isin(ranges)).select(*_SCHEMA.names).join(found, "arrival", "left_semi")
    if later:
        changed = _changes(spark, root, later)
        rows = rows.join(changed.select("arrival"), "arrival", "left_anti").unionByName(
            changed.join(found, "arrival", "left_semi"))
    return rows.select(*_SCHEMA.names)


def merge_into(spark, root, name, incoming):
    """Merge postings with a LONG ``arrival`` into the table as commit ``name``; returns the report.

    Commits of this name or later do not count, so a batch that is run again starts from the same table
    and replaces its own commit.
    """
    commits = history(spark, root, before=name)
    incoming = cut_lineage(incoming.select(*_SCHEMA.names))
    if not commits:
        done = merge.merge_postings(incoming, materialise=False)
        write_postings(done.postings, root, name)
        return cut_lineage(done.report)
    last = commits[-1].last
    held = lookup(spark, root, commits, incoming)
    # Of several records with a signature the last in stored order counts.
    ranked = with_rank(held.orderBy(*store_sort_keys()).withColumnRenamed("arrival", "_key"), "arrival")
    ranked = cut_lineage(ranked.withColumn("arrival", _c("arrival") - (1 << 40)))
    low = incoming.agg(F.min("arrival")).first()[0]
    moved = incoming.withColumn("arrival", _c("arrival") + (last + 1 - low if low is not None else 0))
    done = merge.merge_postings(moved, ranked.drop("_key"), materialise=False)
    touched = done.postings.join(ranked.select("arrival", "_key"), "arrival", "left").withColumn(
        "arrival", F.coalesce("_key", "arrival")).select(*_SCHEMA.names)
    path = f"{root}/delta={name}"
    touched.write.mode("overwrite").partitionBy("source").parquet(path)
    written = spark.read.schema(_SCHEMA).parquet(path)
    _signatures(written).write.mode("overwrite").parquet(f"{root}/index={name}")
    rows, top = written.agg(F.count(F.lit(1)), F.max("arrival")).first()
    report = cut_lineage(done.report)
    _commit(spark, root, Commit(name, False, 0, max(last, top or 0), rows))
    since = sum(c.rows for c in commits[1:]) + rows
    if len(commits) >= DUE_COMMITS or since > max(BUCKET_ROWS, DUE_SHARE * commits[0].rows):
        compact(spark, root, name + FULL)
    return report


def compact(spark, root, name):
    """Write the table as it stands as a full commit; later reads need nothing older."""
    write_postings(read_postings(spark, root), root, name)


def expire(spark, root, keep=1):
    """Delete what reading the ``keep`` newest full commits and all later changes does not need."""
    names = snapshots(spark, root)
    fulls = [n for n in names if history(spark, root, name=n)[-1].full]
    if len(fulls) <= keep:
        return []
    old = [n for n in names if n < fulls[-keep]]
    for n in old:
        for part in ("commit", "delta", "snapshot", "index"):  # the commit first: no reader meets half of it
            fs, path = _fs(spark, f"{root}/{part}={n}")
            if fs.exists(path):
                fs.delete(path, True)
    return old


def page_of_table(spark, root, offset=0, limit=100):
    """One page in stored order of a table without changes since its full commit.

    Positions are known, so only the ranges that hold the page are read.  With changes the order is not
    known before all are seen: then ``ordering.page_postings`` on the whole table, or ``compact`` first.
    """
    if offset < 0:
        raise ValueError("offset must not be negative")
    if not 1 <= limit <= 500:
        raise ValueError("limit must lie between 1 and 500")
    commits = history(spark, root)
    if len(commits) != 1:
        raise ValueError("the table has changes since its last full commit")
    ranges = list(range(offset // BUCKET_ROWS, (offset + limit - 1) // BUCKET_ROWS + 1))
    at = _c("arrival")
    return _full(spark, root, commits[0]).filter(_c("range").isin(ranges) & (at > offset) & (at <= offset + limit)).select(
        *_SCHEMA.names).orderBy("arrival")


def read_postings_json(spark, path):
    """Postings kept as one JSON array or as JSON lines; ``arrival`` follows files by name and rows in them."""
    df = spark.read.schema(POSTING_SCHEMA).option("multiLine", True).json(path)
    placed = df.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.monotonically_increasing_id()})
    return with_rank(placed.orderBy("_file", "_row"), "arrival").drop("_file", "_row")
