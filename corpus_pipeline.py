"""Pipeline over documents: quality rules, quality classifier, near-duplicates, packing."""

from hirelake.llm import minhash_dedup, packing, quality_rules, quality_vote
from hirelake.session import cut_lineage


def rules(spark, docs, sf_dir):
    """Documents that pass the host-level quality rules."""
    return quality_rules.keep_good(docs)


def classify(spark, docs, sf_dir):
    """Documents that the nearest labelled neighbours call good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_vote.keep_good(docs, labels, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates."""
    return minhash_dedup.keep_first(docs)


def pack(spark, docs, sf_dir):
    """Token sequences filled with whole documents."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", rules), ("quality_classifier", classify), ("near_dedup", dedup), ("packing", pack)]

#: The stages hold models and signatures that SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
