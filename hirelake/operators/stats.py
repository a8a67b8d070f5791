"""Ranked counts over postings."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_c = F.col

# metric, column, how many labels are reported (None: all), whether "unknown" is left out
_METRICS = (
    ("sources", "source", None, False),
    ("top_titles", "title", 5, False),
    ("top_skills", "skills", 8, False),
    ("top_companies", "company", 5, False),
    ("top_experience_levels", "experience_level", 5, True),
    ("top_workplace_types", "workplace_type", 5, True),
)
METRICS = tuple(m[0] for m in _METRICS)


def totals(postings):
    return postings.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(_c("workplace_type") == "remote").alias("remote_jobs"),
    )


def _labels(metric, column, drop_unknown):
    values = _c(column) if column == "skills" else F.array(column)
    if drop_unknown:
        values = F.filter(values, lambda v: v != "unknown")
    return F.transform(values, lambda v: F.struct(F.lit(metric).alias("metric"), v.alias("label")))


def ranked_counts(postings, metrics=METRICS, first_seen="arrival"):
    """Long table (metric, rank, label, count); equal counts rank by first appearance.

    One scan: every posting is unfolded to its labels, counted with map-side combining, and the
    rank filter keeps only the wanted labels per metric.
    """
    chosen = [m for m in _METRICS if m[0] in metrics]
    limits = F.lit(None).cast("int")
    for metric, _, k, _ in chosen:
        if k:
            limits = F.when(_c("metric") == metric, k).otherwise(limits)
    unfolded = postings.select(
        _c(first_seen).alias("_seen"),
        F.explode(F.concat(*[_labels(m, col, drop) for m, col, _, drop in chosen])).alias("_l"))
    counted = unfolded.groupBy(_c("_l.metric").alias("metric"), _c("_l.label").alias("label")).agg(
        F.count(F.lit(1)).alias("count"), F.min("_seen").alias("_seen"))
    order = Window.partitionBy("metric").orderBy(_c("count").desc(), _c("_seen"), _c("label"))
    ranked = counted.withColumn("rank", F.row_number().over(order))
    bounded = [m for m in chosen if m[2]]
    if len(bounded) == len(chosen):
        # A constant bound lets Spark cut each map task down to the top rows before the shuffle.
        ranked = ranked.filter(_c("rank") <= max(m[2] for m in bounded))
    return ranked.filter(limits.isNull() | (_c("rank") <= limits)).select("metric", "rank", "label", "count")


def _counted(postings, first_seen):
    """(metric, label, count, first seen) of all totals and labels from one scan.

    The totals are labels of their own; two rows without weight keep them when there are no postings.
    """
    total = lambda metric: F.struct(F.lit(metric).alias("metric"), F.lit("all").alias("label"))
    remote = F.when(_c("workplace_type") == "remote", F.array(total("remote_jobs"))).otherwise(
        F.array().cast("array<struct<metric: string, label: string>>"))
    labels = [_labels(m, col, drop) for m, col, _, drop in _METRICS]
    unfolded = postings.select(
        _c(first_seen).alias("_seen"), F.explode(F.concat(F.array(total("total_jobs")), remote, *labels)).alias("_l"),
        F.lit(1).cast("bigint").alias("_one"))
    none = postings.sparkSession.range(1).select(
        F.lit(None).cast(unfolded.schema["_seen"].dataType).alias("_seen"),
        F.explode(F.array(total("total_jobs"), total("remote_jobs"))).alias("_l"), F.lit(0).cast("bigint").alias("_one"))
    return unfolded.unionByName(none).groupBy(_c("_l.metric").alias("metric"), _c("_l.label").alias("label")).agg(
        F.sum("_one").alias("count"), F.min("_seen").alias("_seen"))


def _ranked(counted):
    order = Window.partitionBy("metric").orderBy(_c("count").desc(), _c("_seen"), _c("label"))
    return counted.withColumn("rank", F.row_number().over(order))


def posting_stats(postings, first_seen="arrival"):
    """Totals and all ranked counts as one long table, from one scan.

    The counts are written once: the few bounded ranks let Spark cut each task down to them, the others
    need all labels of their metric.
    """
    counted = cut_lineage(_counted(postings, first_seen))
    limits = {m: k for m, _, k, _ in _METRICS if k}
    bound = F.lit(None).cast("int")
    for metric, k in limits.items():
        bound = F.when(_c("metric") == metric, k).otherwise(bound)
    few = _c("metric").isin(*limits)
    top = _ranked(counted.filter(few)).filter(_c("rank") <= max(limits.values())).filter(_c("rank") <= bound)
    return _ranked(counted.filter(~few)).unionByName(top).select("metric", "rank", "label", "count")


def kpi_cards(postings, first_seen="arrival"):
    """Headline cards (card, value): total, remote, leading source, leading skill; one scan."""
    wanted = _counted(postings, first_seen).filter(_c("metric").isin("total_jobs", "remote_jobs", "sources", "top_skills"))
    top = _ranked(wanted).filter(_c("rank") <= 1).agg(*[
        F.max(F.when(_c("metric") == m, _c(v))).alias(m) for m, v in (
            ("total_jobs", "count"), ("remote_jobs", "count"), ("sources", "label"), ("top_skills", "label"))])
    cards = (("tracked_jobs", _c("total_jobs").cast("string")), ("remote_roles", _c("remote_jobs").cast("string")),
             ("top_source", F.coalesce("sources", F.lit("n/a"))), ("hot_skill", F.coalesce("top_skills", F.lit("awaiting data"))))
    return top.select(F.explode(F.array(*[F.struct(F.lit(n).alias("card"), v.alias("value")) for n, v in cards])).alias("c")).select("c.*")
