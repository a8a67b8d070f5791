"""Postings, payloads and URLs derived from the given tables.

The SQL is valid in Spark and in DuckDB, so a query and its oracle start from the same rows.
"""

from pyspark.sql import functions as F

from .registry import spread, table

# A third of all postings come from one source, as hot keys do in real feeds.
POST = """
SELECT doc_id AS arrival,
  'id' || CAST(doc_id AS STRING) AS id,
  'j' || CAST(doc_id % 400 AS STRING) AS source_job_id,
  CASE doc_id % 7 WHEN 0 THEN 'Senior Data Engineer' WHEN 1 THEN 'Support 100% Remote_Agent'
    WHEN 2 THEN 'Sales "Lead", East' ELSE replace(substr(text, 1, 40), chr(10), ' ') END AS title,
  CASE WHEN doc_id % 11 = 0 THEN 'Unknown company' ELSE 'Co ' || CAST(doc_id % 37 AS STRING) END AS company,
  CASE doc_id % 6 WHEN 0 THEN 'Nairobi, Kenya' WHEN 1 THEN 'Remote' WHEN 2 THEN 'London'
    WHEN 3 THEN 'Kampala / Uganda' WHEN 4 THEN 'Africa' ELSE 'Unspecified' END AS location,
  CASE doc_id % 6 WHEN 0 THEN 'Nairobi' WHEN 2 THEN 'London' WHEN 3 THEN 'Kampala' END AS location_city,
  CASE doc_id % 6 WHEN 0 THEN 'Kenya' WHEN 2 THEN 'United Kingdom' WHEN 3 THEN 'Uganda' END AS location_country,
  CASE doc_id % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' ELSE 'unknown' END AS workplace_type,
  CASE WHEN doc_id % 3 = 0 THEN 'remoteok' WHEN doc_id % 10 = 1 THEN 'weworkremotely'
    WHEN doc_id % 10 = 2 THEN 'greenhouse' WHEN doc_id % 10 < 6 THEN 'lever' ELSE 'fuzu' END AS source,
  CASE doc_id % 5 WHEN 0 THEN 'full-time' WHEN 1 THEN 'part-time' WHEN 2 THEN 'contract'
    WHEN 3 THEN 'internship' ELSE 'unknown' END AS job_type,
  CASE doc_id % 6 WHEN 0 THEN 'senior' WHEN 1 THEN 'junior' WHEN 2 THEN 'lead' WHEN 3 THEN 'mid'
    WHEN 4 THEN 'entry' ELSE 'unknown' END AS experience_level,
  text AS description,
  CASE WHEN doc_id % 8 = 0 THEN '' ELSE 'site' || CAST(doc_id % 9 AS STRING) || '.example' END AS source_website,
  CASE doc_id % 6 WHEN 0 THEN 'python|sql|aws' WHEN 1 THEN 'react|node.js' WHEN 2 THEN 'sql|excel'
    WHEN 3 THEN 'python|docker|linux|git|sql|kotlin' WHEN 4 THEN 'project management' ELSE '' END AS skills_text,
  'https://jobs.example.org/' || lang || '/' || CAST(doc_id % 800 AS STRING) AS job_url,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * (doc_id % 500) AS posted_at,
  TIMESTAMP '2024-06-01 00:00:00' + INTERVAL '1' MINUTE * (doc_id % 97) AS scraped_at,
  CASE WHEN doc_id % 4 = 0 THEN '100 - 200' END AS salary_text,
  CASE WHEN doc_id % 4 = 1 THEN 0.0 WHEN doc_id % 4 = 2 THEN 55.5 END AS salary_min,
  CAST(doc_id % 23 AS INT) AS quality_score
FROM documents
"""

# Raw payloads: prose with the phrases the scalars look for, spread by row number.
RAW = """
SELECT doc_id AS arrival, text, lang,
  CASE doc_id % 9 WHEN 0 THEN 'Senior Python Engineer' WHEN 1 THEN 'Sales Intern' WHEN 2 THEN 'Ops'
    WHEN 3 THEN 'Junior Analyst (Part Time)' WHEN 4 THEN 'Freelance Designer' WHEN 5 THEN 'Head of Billing'
    WHEN 6 THEN 'Job alert: new roles' WHEN 7 THEN 'Acme: Field Agent' ELSE 'Distributed systems architect' END AS title,
  CASE doc_id % 5 WHEN 0 THEN 'Acme Labs' WHEN 1 THEN '' WHEN 2 THEN 'Unknown company' WHEN 3 THEN 'company'
    ELSE 'O''Neil & Sons' END AS company,
  CASE doc_id % 3 WHEN 0 THEN 'Full Time role with 6 years experience using python and aws. '
    WHEN 1 THEN 'We need experience with spark sql and more, contract. ' ELSE 'You have 2+ years in sales. ' END
    || CASE WHEN doc_id % 4 = 0 THEN 'Hybrid work. ' WHEN doc_id % 4 = 1 THEN 'Please upload your CV. ' ELSE '' END
    || text AS description,
  CASE WHEN doc_id % 3 = 0 THEN 'remoteok' WHEN doc_id % 3 = 1 THEN 'weworkremotely' ELSE 'lever' END AS source,
  CASE doc_id % 4 WHEN 0 THEN 'https://www.acme-labs.co.ke/jobs/' WHEN 1 THEN 'HTTP://Jobs.Example.COM:8080/a/'
    WHEN 2 THEN 'https://boards.example.io/x;s=1/' ELSE 'https://user@host-two.example/p/' END
    || CAST(doc_id % 300 AS STRING) || CASE doc_id % 5 WHEN 0 THEN '?gh_jid=' || CAST(doc_id AS STRING) || '&utm_source=t'
    WHEN 1 THEN '/?utm_source=x#top' WHEN 2 THEN '?b=1&JobId=A%20' || CAST(doc_id AS STRING) || '&vacancy=&jid=7'
    WHEN 3 THEN '-senior-engineer/' ELSE '' END AS url
FROM documents
"""

# Page addresses with identifiers and tracking parameters.
URL = """
SELECT page_id AS arrival, url, CASE page_id % 4
  WHEN 0 THEN replace(url, '#top', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'gh_jid=' || CAST(page_id AS STRING)
  WHEN 1 THEN url WHEN 2 THEN replace(replace(url, 'https', 'HTTPS'), 'example', 'Example')
  ELSE 'https://careers.example.org/jobs/role-' || CAST(page_id AS STRING) || 'abcdef/?jobid=' || CAST(page_id % 50 AS STRING) || '&opening=x+y' END AS link
FROM pages
"""


def _sql(spark, sf_dir, text, source, shape=lambda df: df):
    return spark.sql(text.replace(f"FROM {source}", "FROM {src}"), src=shape(table(spark, sf_dir, source)))


def v_post(spark, sf_dir):
    """Documents posing as stored postings."""
    df = _sql(spark, sf_dir, POST, "documents")
    skills = F.filter(F.split("skills_text", r"\|"), lambda s: s != "")
    return df.withColumns({"skills": skills, "tags": skills, "apply_url": F.col("job_url"),
                           "canonical_url": F.col("job_url")})


def v_raw(spark, sf_dir):
    return _sql(spark, sf_dir, RAW, "documents", spread)


def v_url(spark, sf_dir):
    return _sql(spark, sf_dir, URL, "pages", spread)


def with_views(sql, **views):
    """Oracle SQL with the derived views it names in front."""
    known = {"v_post": POST, "v_raw": RAW, "v_url": URL, **views}
    used = [f"{n} AS ({body})" for n, body in known.items() if n in sql]
    return ("WITH " + ", ".join(used) + " " if used else "") + sql
