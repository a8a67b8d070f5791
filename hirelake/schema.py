"""Schemas of the two tables every operator exchanges."""

from pyspark.sql import types as T

SECTION_TYPE = T.StructType([
    T.StructField("heading", T.StringType()),
    T.StructField("items", T.ArrayType(T.StringType())),
])
SECTIONS_DDL = "array<struct<heading:string,items:array<string>>>"

_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType()),
    "sections": T.ArrayType(SECTION_TYPE),
}


def _struct(*fields):
    """``name`` for text columns, ``name:type`` for the others."""
    pairs = [(f.split(":") + ["string"])[:2] for f in " ".join(fields).split()]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


POSTING_SCHEMA = _struct(
    "id source_job_id title company location location_city location_region location_country",
    "workplace_type source source_type source_website aggregated_sources:strings job_type",
    "experience_level description description_html description_sections:sections skills:strings",
    "tags:strings job_url apply_url canonical_url posted_at:timestamp scraped_at:timestamp",
    "discovered_at:timestamp salary_text salary_min:double salary_max:double salary_currency",
    "salary_interval quality_score:int",
)

# What an adapter hands over: one row per posting, missing keys are NULL.  Values that feeds
# deliver with different types (dates, salaries) have one column per type.
RAW_SCHEMA = _struct(
    "source arrival:long title company location description description_text description_html",
    "job_url apply_url url job_type experience_level salary_text salary_num:double skills:strings",
    "tags:strings posted_text posted_epoch:double posted_ts:timestamp scraped_at:timestamp",
    "discovered_at:timestamp source_job_id source_type source_website aggregated_sources:strings",
)


def conform(df, schema):
    """Project ``df`` onto ``schema``: cast what exists, NULL what is missing, drop the rest."""
    from pyspark.sql import functions as F

    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def quarantine(df):
    """Split postings into (valid, rejected) by the enumeration domains."""
    from pyspark.sql import functions as F

    from . import vocab

    ok = (
        F.col("source").isin(*vocab.SOURCES)
        & F.col("workplace_type").isin(*vocab.WORKPLACE_TYPES)
        & F.col("experience_level").isin(*vocab.EXPERIENCE_LEVELS)
    )
    ok = F.coalesce(ok, F.lit(False))
    return df.filter(ok), df.filter(~ok)
