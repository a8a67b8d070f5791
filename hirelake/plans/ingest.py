"""The ingest job: landed texts to an updated posting table with a report."""

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..operators.normalise import noise_filter, normalise
from ..operators.ordering import cap_per_source, unique_first, with_rank
from ..session import cut_lineage
from ..sources import boards, registry, store

_c = F.col
_COUNTS = ("collected", "inserted", "updated", "deduplicated", "errors")


def prepare(raw, as_of, per_source=None):
    """Raw rows to the postings of one run: noise out, normalised, first per id on boards.

    ``per_source`` keeps only the first postings of each source; every posting stays without it.
    """
    # Both branches below read it, so it is normalised once.
    postings = cut_lineage(normalise(noise_filter(raw), as_of))
    on_board = _c("source").isin(*boards.BOARDS)
    deduped = unique_first(postings.filter(on_board), ["source", "id"])
    postings = postings.filter(~on_board).unionByName(deduped)
    return postings if per_source is None else cap_per_source(postings, per_source)


def in_run_order(postings, sources=None):
    """Number postings by source order, then feed order, as the merge takes them."""
    known = sources or vocab.SOURCES
    order = F.lit(len(known))  # others after the known ones, by name
    for i, s in enumerate(known):
        order = F.when(_c("source") == s, i).otherwise(order)
    return with_rank(postings.orderBy(order, "source", "arrival").drop("arrival"), "arrival")


def run_ingest(spark, landed, root, name, as_of, sources=None, detail_pages=None, per_source=None):
    """Merge one run into the table at ``root`` as commit ``name``.

    The report (source, collected, inserted, updated, deduplicated, errors), the error texts (source,
    message) and the run's total with its start and finish are written beside the table and read from
    there, now and later (``run_report``).
    """
    started = datetime.now(timezone.utc)
    raw, errors = registry.collect_raw(landed, as_of, sources, detail_pages)
    errors.write.mode("overwrite").parquet(f"{root}/run={name}/errors")
    incoming = in_run_order(prepare(raw, as_of, per_source), sources)
    counts = store.merge_into(spark, root, name, incoming)
    faults = _errors(spark, root, name).groupBy("source").agg(F.count(F.lit(1)).alias("errors"))
    counts.join(faults, "source", "full").select(
        "source", *[F.coalesce(n, F.lit(0)).alias(n) for n in _COUNTS]).write.mode("overwrite").parquet(f"{root}/run={name}/sources")
    report = spark.read.parquet(f"{root}/run={name}/sources")
    total = report.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(f"total_{n}") for n in _COUNTS])
    finished = datetime.now(timezone.utc)
    total.select("*", F.lit(started).alias("started_at"), F.lit(finished).alias("finished_at")).write.mode("overwrite").parquet(
        f"{root}/run={name}/total")
    return report


def _errors(spark, root, name):
    return spark.read.schema("source string, message string").parquet(f"{root}/run={name}/errors")


@dataclass(frozen=True)
class RunReport:
    """A run as it was written: counters by source, error texts, one row of totals."""

    sources: DataFrame
    errors: DataFrame
    total: DataFrame


def run_report(spark, root, name):
    """The report of run ``name``."""
    return RunReport(spark.read.parquet(f"{root}/run={name}/sources"), _errors(spark, root, name),
                     spark.read.parquet(f"{root}/run={name}/total"))
