"""Queries over stored postings: filters, order, caps, statistics, export."""

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import filters, ordering, stats
from ..sources import csv_export
from .registry import query
from .views import v_post, with_views

_c = F.col

# DuckDB side of the skills column.
_SK = "list_filter(string_split(skills_text, '|'), lambda s: s <> '')"


def _filter(name, where, **conditions):
    sql = with_views(f"SELECT arrival, title, company, source FROM v_post WHERE {where}")

    @query(name, sql)
    def run(spark, sf_dir):
        return filters.filter_postings(v_post(spark, sf_dir), **conditions).select(
            "arrival", "title", "company", "source")


def _kw(word):
    return (f"(contains(lower(title), '{word}') OR contains(lower(company), '{word}') OR "
            f"contains(lower(description), '{word}') OR len(list_filter({_SK}, lambda s: contains(s, '{word}'))) > 0)")


_filter("filter_keyword", _kw("100% remote_"), keyword="100% Remote_")
_filter("filter_location", "contains(lower(location), 'kenya')", location="KENYA")
_filter("filter_source", "source = 'greenhouse'", source="greenhouse")
_filter("filter_company", "contains(lower(company), 'co 1')", company="Co 1")
_filter("filter_job_type", "contains(lower(job_type), 'time')", job_type="Time")
_filter("filter_workplace", "workplace_type = 'hybrid'", workplace_type="hybrid")
_filter("filter_experience", "experience_level = 'senior'", experience_level="senior")
_filter("filter_skill", f"len(list_filter({_SK}, lambda s: contains(s, 'sql'))) > 0", skill="SQL")
_filter("filter_combined",
        f"{_kw('data')} AND contains(lower(location), 'nairobi') AND source = 'remoteok' AND "
        f"contains(lower(job_type), 'time') AND workplace_type = 'remote'",
        keyword="Data", location="nairobi", source="remoteok", job_type="time", workplace_type="remote",
        company="", skill=None)

_ORDER = "posted_at DESC, quality_score DESC, scraped_at DESC, arrival"


@query("store_order", with_views(
    f"SELECT arrival, quality_score, row_number() OVER (ORDER BY {_ORDER}) AS store_rank FROM v_post"))
def store_order(spark, sf_dir):
    keys = v_post(spark, sf_dir).select("arrival", "posted_at", "quality_score", "scraped_at")
    return ordering.with_rank(ordering.store_order(keys), "store_rank").select(
        "arrival", "quality_score", "store_rank")


@query("page_postings", with_views(
    f"SELECT arrival, title, (SELECT count(*) FROM v_post WHERE contains(lower(job_type), 'time')) AS total "
    f"FROM v_post WHERE contains(lower(job_type), 'time') ORDER BY {_ORDER} LIMIT 50 OFFSET 20"))
def page_postings(spark, sf_dir):
    hits = filters.filter_postings(v_post(spark, sf_dir), job_type="time")
    total = hits.agg(F.count(F.lit(1))).scalar()
    return ordering.page_postings(hits, offset=20, limit=50).select("arrival", "title", total.alias("total"))


@query("unique_first", with_views(
    "SELECT arrival, source_job_id FROM v_post QUALIFY row_number() OVER (PARTITION BY source_job_id ORDER BY arrival) = 1"))
def unique_first(spark, sf_dir):
    return ordering.unique_first(v_post(spark, sf_dir), "source_job_id").select("arrival", "source_job_id")


@query("cap_per_source", with_views(
    "SELECT arrival, source FROM v_post QUALIFY row_number() OVER (PARTITION BY source ORDER BY arrival) <= 25"))
def cap_per_source(spark, sf_dir):
    return ordering.cap_per_source(v_post(spark, sf_dir)).select("arrival", "source")


@query("union_sources", with_views(
    "SELECT arrival, title, company FROM v_post WHERE source = 'remoteok' "
    "UNION ALL SELECT arrival, title, NULL AS company FROM v_post WHERE source = 'lever'"))
def union_sources(spark, sf_dir):
    post = v_post(spark, sf_dir)
    first = post.filter("source = 'remoteok'").select("arrival", "title", "company")
    second = post.filter("source = 'lever'").select("arrival", "title")
    return ordering.union_sources([first, second])


@query("stats_totals", with_views(
    "SELECT count(*) AS total_jobs, count(*) FILTER (workplace_type = 'remote') AS remote_jobs FROM v_post"))
def stats_totals(spark, sf_dir):
    return stats.totals(v_post(spark, sf_dir))


def _top_sql(metric, source, k=None, where="true"):
    limit = f"WHERE rank <= {k}" if k else ""
    return (f"SELECT metric, rank, label, count FROM (SELECT '{metric}' AS metric, label, count, "
            f"CAST(row_number() OVER (ORDER BY count DESC, seen, label) AS INT) AS rank FROM ("
            f"SELECT label, count(*) AS count, min(arrival) AS seen FROM ({source}) WHERE {where} GROUP BY label)) {limit}")


_TOPS = {
    "sources": ("SELECT source AS label, arrival FROM v_post", None, "true"),
    "top_titles": ("SELECT title AS label, arrival FROM v_post", 5, "true"),
    "top_skills": (f"SELECT unnest({_SK}) AS label, arrival FROM v_post", 8, "true"),
    "top_companies": ("SELECT company AS label, arrival FROM v_post", 5, "true"),
    "top_experience_levels": ("SELECT experience_level AS label, arrival FROM v_post", 5, "label <> 'unknown'"),
    "top_workplace_types": ("SELECT workplace_type AS label, arrival FROM v_post", 5, "label <> 'unknown'"),
}
_KEYS = {
    "stats_sources": "sources", "stats_top_titles": "top_titles", "stats_top_skills": "top_skills",
    "stats_top_companies": "top_companies", "stats_top_experience": "top_experience_levels",
    "stats_top_workplace": "top_workplace_types",
}


def _top(name, metric):
    @query(name, with_views(_top_sql(metric, *_TOPS[metric])))
    def run(spark, sf_dir):
        return stats.ranked_counts(v_post(spark, sf_dir), [metric])


for _name, _metric in _KEYS.items():
    _top(_name, _metric)

_TOTALS = (
    "SELECT 'total_jobs' AS metric, CAST(1 AS INT) AS rank, 'all' AS label, count(*) AS count FROM v_post UNION ALL "
    "SELECT 'remote_jobs', 1, 'all', count(*) FILTER (workplace_type = 'remote') FROM v_post")


@query("stats_all", with_views(" UNION ALL ".join(
    ["SELECT metric, rank, label, count FROM (" + _TOTALS + ")"]
    + ["SELECT * FROM (" + _top_sql(m, *spec) + ")" for m, spec in _TOPS.items()])))
def stats_all(spark, sf_dir):
    return stats.posting_stats(v_post(spark, sf_dir))


@query("stats_kpis", with_views(
    "SELECT 'tracked_jobs' AS card, CAST(count(*) AS STRING) AS value FROM v_post UNION ALL "
    "SELECT 'remote_roles', CAST(count(*) FILTER (workplace_type = 'remote') AS STRING) FROM v_post UNION ALL "
    f"SELECT 'top_source', label FROM ({_top_sql('sources', *_TOPS['sources'])}) WHERE rank = 1 UNION ALL "
    f"SELECT 'hot_skill', label FROM ({_top_sql('top_skills', *_TOPS['top_skills'])}) WHERE rank = 1"))
def stats_kpis(spark, sf_dir):
    return stats.kpi_cards(v_post(spark, sf_dir))


def _q(expr):
    return "'\"' || replace(coalesce(" + expr + ", ''), '\"', '\"\"') || '\"'"


_CSV_SQL = " || ',' || ".join(
    ["id"] + [_q(n) for n in ("source_job_id", "title", "company", "location", "location_city", "location_country")]
    + ["workplace_type", "source", _q("source_website"), _q("job_type"), "experience_level", _q("salary_text"),
       _q("job_url"), _q("job_url"), "strftime(posted_at, '%Y-%m-%dT%H:%M:%S') || '+00:00'",
       "strftime(scraped_at, '%Y-%m-%dT%H:%M:%S') || '+00:00'", _q(f"array_to_string({_SK}, '|')")])


@query("export_csv_lines", with_views(
    f"SELECT arrival AS line_no, {_CSV_SQL} AS line FROM v_post UNION ALL SELECT -1, "
    "'id,source_job_id,title,company,location,location_city,location_country,workplace_type,source,source_website,"
    "job_type,experience_level,salary_text,job_url,apply_url,posted_at,scraped_at,skills'"))
def export_csv_lines(spark, sf_dir):
    return csv_export.csv_lines(v_post(spark, sf_dir))


_SIZE = f"len({_SK})"


@query("completeness", with_views(
    "SELECT arrival, CAST(1 + (company <> 'Unknown company')::INT + (lower(location) NOT IN ('unspecified','africa','kenya'))::INT "
    "+ (description <> '')::INT + 1 + 1 + (job_type <> 'unknown')::INT + (experience_level <> 'unknown')::INT "
    "+ (salary_text IS NOT NULL OR coalesce(salary_min, 0) <> 0)::INT "
    f"+ ({_SIZE} > 0)::INT + (source_website <> '')::INT + 1 + 1 + least({_SIZE}, 5) + least(arrival % 7, 4) AS INT) AS score FROM v_post"))
def completeness(spark, sf_dir):
    section = F.struct(F.lit("Overview").alias("heading"), F.array(F.lit("x")).alias("items"))
    df = v_post(spark, sf_dir).withColumns({
        "description_sections": F.array_repeat(section, (_c("arrival") % 7).cast("int")),
        "salary_max": F.lit(None).cast("double")})
    return df.select("arrival", scoring.completeness().alias("score"))


@query("signatures", with_views(
    "SELECT arrival, 'source-id:' || source || ':' || source_job_id || '#url:' || job_url || '#content:' || "
    r"trim(regexp_replace(lower(title), '\s+', ' ', 'g')) || '|' || lower(company) || '|' || coalesce(lower(location_city), '') || '|' || "
    "coalesce(lower(location_country), '') || '|' || job_type AS signatures FROM v_post"))
def signatures(spark, sf_dir):
    return v_post(spark, sf_dir).select(
        "arrival", F.array_join(scoring.job_signatures(), "#").alias("signatures"))
