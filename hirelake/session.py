"""Session defaults and shared scratch space."""

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Interim tables of this process, for ``clear_scratch``.
_SCRATCH = []


def build_session(app_name="hirelake", master=None, **conf):
    """Session with the settings the engine relies on; cluster settings win when present."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Call-site capture doubles the time it takes to build large expressions.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark):
    """Shared folder for checkpoints and interim tables.

    The cluster names it in ``spark.checkpoint.dir``.  Where that setting is missing a temporary
    folder serves a local session, as in tests; on a cluster the executors could not read it, so
    that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="hirelake-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark, label):
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def clear_scratch(spark):
    """Delete the interim tables that this process has written.

    Only for a session whose results have been stored: a DataFrame that still reads an interim
    table fails afterwards.
    """
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df):
    """Write the rows to the shared folder and read them back.

    Survives executor loss, computes the plan once (a checkpoint computes it twice) and lets
    later steps read only the columns they need.
    """
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_boundary(df):
    """Keep later filters above this point.

    The optimizer rewrites a filter in terms of the columns below it; over the staged text columns
    of this engine that would repeat costly expressions many times over.  A row count observed on
    the way (free, and visible in the query metrics) stops that, while unused columns are still
    pruned through it.
    """
    return df.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))
