"""Registry of the queries that the verification driver runs."""

QUERIES = {}
ORACLES = {}


def query(name, oracle=None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and, where SQL can say the same, its SQL."""
    def add(fn):
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df):
    """Even out a scan with fewer splits than cores before per-row heavy work.

    A small file has one split and would keep one core busy; inputs with enough splits pass
    unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
