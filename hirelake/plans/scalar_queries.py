"""Queries over single text, URL, date, salary and location scalars."""

from pyspark.sql import functions as F

from .. import vocab
from ..functions import classify, dates, detail, location, salary, scoring, sections, skills, text, urls
from ..operators import normalise as norm
from .registry import query, spread
from .registry import table as _table
from .views import v_raw, v_url, with_views

_c = F.col


def table(spark, sf_dir, name):
    return spread(_table(spark, sf_dir, name))


# DuckDB: Unicode white space class of the text functions.
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def _ws(expr):
    return f"trim(regexp_replace(coalesce({expr}, ''), '{_WS}+', ' ', 'g'))"


_MESSY = (
    "CASE doc_id % 4 WHEN 0 THEN chr(160) || text || chr(9) WHEN 1 THEN replace(text, ' ', '  ') "
    "WHEN 2 THEN NULL ELSE chr(10) || text || chr(8195) || 'x' || chr(31) END")


@query("normalize_ws", f"SELECT doc_id, {_ws('m')} AS clean FROM (SELECT doc_id, {_MESSY} AS m FROM documents)")
def normalize_ws(spark, sf_dir):
    u = lambda s: F.lit(s)
    messy = (F.when(_c("doc_id") % 4 == 0, F.concat(u("\xa0"), "text", u("\t")))
             .when(_c("doc_id") % 4 == 1, F.replace("text", u(" "), u("  ")))
             .when(_c("doc_id") % 4 == 3, F.concat(u("\n"), "text", u(" x\x1f"))))
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_ws(messy).alias("clean"))


@query("normalize_tags", f"""
SELECT doc_id, array_to_string(list_filter(list_distinct_ordered, lambda t: t <> ''), '|') AS tags FROM (
  SELECT doc_id, list_reduce(list_prepend(CAST([] AS STRING[]), list_transform(t, lambda x: [x])),
    lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_ordered
  FROM (SELECT doc_id, list_transform(string_split(replace(replace(text, '.', ','), chr(10), ','), ','),
    lambda x: lower({_ws('x')})) AS t FROM documents))""")
def normalize_tags(spark, sf_dir):
    parts = F.split(F.translate("text", ".\n", ",,"), ",")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(text.normalize_tags(parts), "|").alias("tags"))


_WRAPPED = (
    "'<div class=\"a>b\"><p>' || replace(replace(text, '&', '&amp;'), chr(10), '</p><!-- note --><p>') || "
    "'</p><script>var x = \"<b>\";</script><style>p:x</style><svg><path/></svg>&#8226;tail&nbsp;&eacute;&#x41;&copy b</div>'")


def _wrapped_docs(spark, sf_dir):
    return spark.sql(f"SELECT doc_id, text, {_WRAPPED} AS html FROM {{src}}".replace("chr(10)", "'\\n'"),
                     src=table(spark, sf_dir, "documents"))


@query("clean_html", rf"""
SELECT doc_id, trim(regexp_replace(regexp_replace({_ws("replace(text, chr(10), ' ')")} || '• tail éA© b', '[ ]*[•·][ ]*', ' • ', 'g'), ' +', ' ', 'g')) AS clean
FROM documents""")
def clean_html(spark, sf_dir):
    return _wrapped_docs(spark, sf_dir).select("doc_id", text.clean_html(_c("html")).alias("clean"))


@query("html_text_lines", r"""
SELECT page_id, CAST(len(h1) AS INT) AS headings, len(body) > 0 AS has_body, h1[1] AS title FROM (
  SELECT page_id, regexp_extract_all(html, '<h1>([^<&]*)', 1) AS h1,
    trim(regexp_replace(html, '(?s)<[^>]*>', '', 'g')) AS body FROM pages WHERE regexp_matches(html, '<h1>[^<&]*</h1>'))
WHERE trim(h1[1]) = h1[1] AND h1[1] <> ''""")
def html_text_lines(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").filter(_c("html").rlike("<h1>[^<&]*</h1>"))
    h1 = F.regexp_extract("html", "<h1>([^<&]*)", 1)
    lines = F.split(text.html_text(_c("html")), "\n")
    # The heading must come out as a line of its own.
    found = F.filter(lines, lambda x: x == h1)
    return pages.filter((F.trim(h1) == h1) & (h1 != "")).select(
        "page_id", F.size(F.regexp_extract_all("html", F.lit("<h1>([^<&]*)"), F.lit(1))).alias("headings"),
        (F.size(lines) > 0).alias("has_body"), F.try_element_at(found, F.lit(1)).alias("title"))


@query("slice_between", r"""
SELECT doc_id, coalesce(array_to_string(body[2:], ' '), '') AS body FROM (
  SELECT doc_id, CASE WHEN stop IS NULL THEN ls ELSE ls[:stop] END AS body FROM (
    SELECT doc_id, ls, list_min(list_filter(list_transform(ls, lambda x, i: CASE WHEN i > 1 AND starts_with(x, 'E') THEN i - 1 END),
      lambda p: p IS NOT NULL)) AS stop FROM (
      SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents)))""")
def slice_between(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("lines", text.text_lines(_c("text")))
    # The first line plays the start marker, a line that begins with E the end marker.
    marked = F.transform("lines", lambda x, i: F.when(i == 0, F.lit("\x01start")).otherwise(x))
    return docs.select("doc_id", text.slice_between(marked, ["\x01start"], ["E"]).alias("body"))


@query("py_title", r"""
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(s, '[a-zA-ZÀ-ÿ]+|[^a-zA-ZÀ-ÿ]+'),
  lambda r: upper(r[1]) || lower(r[2:])), '') AS titled
FROM (SELECT p_partkey, p_name || '''s ' || lower(p_brand) || ' o''neil-x ' || p_type || ' 3rd éCOLE' AS s FROM part)""")
def py_title(spark, sf_dir):
    s = F.concat("p_name", F.lit("'s "), F.lower("p_brand"), F.lit(" o'neil-x "), "p_type", F.lit(" 3rd éCOLE"))
    return table(spark, sf_dir, "part").select("p_partkey", text.py_title(s).alias("titled"))


_URL_PARTS = r"""
SELECT arrival, link, lower(regexp_extract(link, '^([A-Za-z]+)://', 1)) AS scheme, regexp_extract(link, '^[A-Za-z]+://([^/?#]*)', 1) AS host,
  regexp_replace(regexp_extract(link, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path,
  regexp_extract(link, '\?([^#]*)', 1) AS query FROM v_url"""
_ID_LIST = ", ".join(f"'{k}'" for k in vocab.ID_QUERY_KEYS)


@query("canonical_url", with_views(f"""
SELECT arrival, scheme || '://' || lower(host) || CASE WHEN rtrim(path, '/') = '' THEN path ELSE rtrim(path, '/') END
  || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS canonical FROM (
  SELECT *, array_to_string(list_transform(list_filter(string_split(query, '&'), lambda p: regexp_matches(p, '=.')
    AND lower(string_split(p, '=')[1]) IN ({_ID_LIST})), lambda p: p), '&') AS kept FROM ({_URL_PARTS}))"""))
def canonical_url(spark, sf_dir):
    return v_url(spark, sf_dir).select("arrival", urls.canonical_url(_c("link")).alias("canonical"))


@query("source_job_id", with_views(rf"""
SELECT arrival, coalesce(nullif(regexp_extract(query, '(?:^|&)gh_jid=([^&]*)', 1), ''), nullif(regexp_extract(query, '(?:^|&)jobid=([^&]*)', 1), ''),
  nullif(regexp_extract(lower(last), '([a-z0-9]{{6,}})$', 1), ''), nullif(last, '')) AS job_id
FROM (SELECT arrival, query, coalesce(list_filter(string_split(path, '/'), lambda s: s <> '')[-1], '') AS last FROM ({_URL_PARTS}))"""))
def source_job_id(spark, sf_dir):
    return v_url(spark, sf_dir).select("arrival", urls.source_job_id(_c("link")).alias("job_id"))


@query("fingerprint", with_views(f"""
SELECT arrival, sha256(lower({_ws('title')}) || '|' || lower({_ws('company')}) || '|' || lower(source) || '|' ||
  CASE WHEN arrival % 2 = 0 THEN '' ELSE CAST(arrival AS STRING) END || '|' || lower(url)) AS id FROM v_raw"""))
def fingerprint(spark, sf_dir):
    jid = F.when(_c("arrival") % 2 == 1, _c("arrival").cast("string"))
    return v_raw(spark, sf_dir).select("arrival", scoring.fingerprint(
        _c("title"), _c("company"), _c("source"), jid, _c("url")).alias("id"))


_TITLED = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query("company_name", with_views(f"""
SELECT arrival, CASE WHEN lower(company) IN ('', 'company', 'unknown company') THEN {_TITLED.format("replace(label, '-', ' ')")} ELSE company END AS name,
  {_TITLED.format("replace(replace(label, '-', ' '), '_', ' ')")} AS domain FROM (
  SELECT arrival, company, string_split(replace(lower(regexp_extract(url, '://(?:[^/@]*@)?([^/:?#]*)', 1)), 'www.', ''), '.')[1] AS label FROM v_raw)"""))
def company_name(spark, sf_dir):
    return v_raw(spark, sf_dir).select(
        "arrival", urls.company_name(_c("company"), _c("url")).alias("name"), urls.domain_company(_c("url")).alias("domain"))


# The same moment written in many ways; the oracle knows the moment.
_DATE_FORMS = """
SELECT o_orderkey, o_orderdate AS ts, strftime(o_orderdate, '%Y-%m-%d') AS d0, CAST(o_orderkey % 12 AS INT) AS form FROM orders"""


@query("parse_datetime", """
SELECT o_orderkey, strftime(CASE form WHEN 7 THEN ts + INTERVAL 3 HOUR WHEN 8 THEN TIMESTAMP '2024-07-01' - INTERVAL 1 DAY * (o_orderkey % 20)
  WHEN 9 THEN TIMESTAMP '2024-07-01' - INTERVAL 7 DAY * (o_orderkey % 20) WHEN 10 THEN TIMESTAMP '2024-07-01'
  WHEN 11 THEN date_trunc('day', ts) + INTERVAL 37800 SECOND ELSE date_trunc('day', ts) END, '%Y-%m-%d %H:%M:%S') AS parsed
FROM (SELECT o_orderkey, CAST(o_orderkey % 12 AS INT) AS form, date_trunc('day', o_orderdate) AS ts FROM orders)""")
def parse_datetime(spark, sf_dir):
    ts = F.date_trunc("day", "o_orderdate")
    f = lambda p: F.date_format(ts, p)
    n = (_c("o_orderkey") % 20).cast("string")
    forms = [
        f("yyyy-MM-dd"), f("yyyy-MM-dd HH:mm:ss"), f("yyyy-MM-dd'T'HH:mm:ss'Z'"), f("d MMMM yyyy"),
        f("d MMM yyyy"), f("MMMM d, yyyy"), F.concat(F.lit("<b>"), f("MMM d, yyyy"), F.lit("</b>")),
        f("yyyy-MM-dd'T'HH:mm:ss.SSS'-03:00'"), F.concat(F.lit("Posted "), n, F.lit(" days ago")),
        F.concat(n, F.lit(" weeks ago")), F.lit("soon"),
        F.concat(F.lit("Mon, "), f("dd MMM yyyy"), F.lit(" 09:30:00 -0100")),
    ]
    form = (_c("o_orderkey") % 12).cast("int")
    value = F.element_at(F.array(*forms), form + 1)
    as_of = F.lit("2024-07-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "orders").withColumn("value", value).select(
        "o_orderkey", F.date_format(dates.parse_datetime(_c("value"), as_of), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("parse_relative_date", """
SELECT o_orderkey, strftime(CASE o_orderkey % 5 WHEN 0 THEN TIMESTAMP '2024-07-01' WHEN 1 THEN TIMESTAMP '2024-06-30'
  WHEN 2 THEN TIMESTAMP '2024-07-01' - INTERVAL 30 DAY * (o_orderkey % 7) WHEN 3 THEN date_trunc('day', o_orderdate) END,
  '%Y-%m-%d %H:%M:%S') AS parsed FROM orders""")
def parse_relative_date(spark, sf_dir):
    forms = F.array(F.lit("Today"), F.lit(" yesterday"), F.concat((_c("o_orderkey") % 7).cast("string"), F.lit(" months ago")),
                    F.date_format("o_orderdate", "d MMMM yyyy"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    value = F.element_at(forms, (_c("o_orderkey") % 5).cast("int") + 1)
    as_of = F.lit("2024-07-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "orders").withColumn("value", value).select(
        "o_orderkey", F.date_format(dates.parse_relative_date(_c("value"), as_of), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def _bounded(pattern):
    """DuckDB form of a pattern with Unicode word edges."""
    return pattern.replace(r"\b", "", 1).rstrip("b").rstrip("\\")


_LOW = "lower(title || ' ' || description)"
_JT = " ".join(
    rf"WHEN regexp_matches(t, '(^|[^\pL\pN_]){p[2:-2]}($|[^\pL\pN_])') THEN '{n}'" for p, n in vocab.JOB_TYPES)


@query("job_type", with_views(f"SELECT arrival, CASE {_JT} ELSE 'unknown' END AS job_type FROM (SELECT arrival, {_LOW} AS t FROM v_raw)"))
def job_type(spark, sf_dir):
    return v_raw(spark, sf_dir).select(
        "arrival", classify.job_type(F.lit(None).cast("string"), _c("title"), _c("description")).alias("job_type"))


def _word_cases(groups, col):
    return " ".join("WHEN " + " OR ".join(f"contains({col}, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in groups)


_YEARS = r"regexp_extract(t, '([0-9]+)\+?\s+years?', 1)"


@query("experience_level", with_views(f"""
SELECT arrival, CASE {_word_cases(vocab.EXPERIENCE_WORDS, 'tt')} ELSE 'unknown' END AS stated,
  CASE {_word_cases(vocab.EXPERIENCE_WORDS, 't')} WHEN {_YEARS} = '' THEN 'unknown' WHEN CAST({_YEARS} AS INT) <= 1 THEN 'entry'
   WHEN CAST({_YEARS} AS INT) <= 3 THEN 'junior' WHEN CAST({_YEARS} AS INT) <= 5 THEN 'mid' WHEN CAST({_YEARS} AS INT) <= 8 THEN 'senior' ELSE 'lead' END AS inferred
FROM (SELECT arrival, lower(title) AS tt, lower('x ' || replace(description, 'Full Time', '') || CASE arrival % 4 WHEN 0 THEN ' 1 year' ELSE '' END) AS t FROM v_raw)"""))
def experience_level(spark, sf_dir):
    desc = F.concat(F.replace("description", F.lit("Full Time"), F.lit("")),
                    F.when(_c("arrival") % 4 == 0, " 1 year").otherwise(""))
    return v_raw(spark, sf_dir).select(
        "arrival", classify.experience_level(_c("title")).alias("stated"),
        classify.infer_experience(F.lit("x"), desc).alias("inferred"))


_PLACE = "CASE arrival % 5 WHEN 0 THEN 'Kenya' WHEN 1 THEN '' WHEN 2 THEN 'Berlin' WHEN 3 THEN 'Remote' ELSE 'africa' END"


@query("workplace_type", with_views(f"""
SELECT arrival, CASE {_word_cases(vocab.WORKPLACE_WORDS, 't')} WHEN lower(place) IN ('kenya','uganda','nigeria','africa') THEN 'unknown'
  WHEN place <> '' THEN 'onsite' ELSE 'unknown' END AS workplace FROM (
  SELECT arrival, {_PLACE} AS place, lower({_PLACE} || ' ' || title || ' ' || description) AS t FROM v_raw)"""))
def workplace_type(spark, sf_dir):
    return v_raw(spark, sf_dir).withColumn("place", F.expr(_PLACE)).select(
        "arrival", classify.workplace_type(_c("place"), _c("title"), _c("description")).alias("workplace"))


# (text, location, city, region, country) for each form; the second part of the key varies the region.
_PLACES = (
    ("'Nairobi, Kenya'", "'Nairobi, Kenya'", "'Nairobi'", "NULL", "'Kenya'"),
    ("'remote'", "'Remote'", "NULL", "NULL", "NULL"),
    ("'Zone ' || p_size || ' / London'", "'Zone ' || p_size || ' , London'", "'London'", "'Zone ' || p_size", "'United Kingdom'"),
    ("'nyc | plant ' || p_size", "'nyc | plant ' || p_size", "'Nyc'", "'Plant ' || p_size", "'USA'"),
    ("'usa'", "'usa'", "NULL", "NULL", "'Usa'"),
    ("'Greater nyc area'", "'Greater nyc area'", "'New York'", "'Greater Nyc Area'", "'USA'"),
    ("'Hybrid, Dublin'", "'Hybrid, Dublin'", "'Dublin'", "'Hybrid'", "'Ireland'"),
    ("''", "'Unspecified'", "NULL", "NULL", "NULL"),
    ("'Unit ' || p_size || ', Lagos, Accra'", "'Unit ' || p_size || ', Lagos, Accra'", "'Accra'", "'Unit ' || p_size", "'Ghana'"),
)


def _place_case(i):
    return "CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN {p[i]}" for k, p in enumerate(_PLACES)) + " END"


@query("parse_location", f"""
SELECT p_partkey, {_place_case(1)} AS location, {_place_case(2)} AS city, {_place_case(3)} AS region, {_place_case(4)} AS country,
  CASE p_partkey % 9 WHEN 1 THEN 'remote' WHEN 6 THEN 'hybrid' WHEN 7 THEN 'unknown' ELSE 'onsite' END AS workplace_type FROM part""")
def parse_location(spark, sf_dir):
    raw = F.expr(_place_case(0))
    return table(spark, sf_dir, "part").select(
        "p_partkey", location.parse_location(raw, _c("p_name"), F.lit("")).alias("p")).select("p_partkey", "p.*")


_PAYS = (  # text, min, max, currency, interval
    ("'KSh ' || p_size || ',000 - ' || (p_size + 5) || ',000.50 per month'", "p_size * 1000.0", "(p_size + 5) * 1000.0 + 0.5", "'KES'", "'month'"),
    ("'pays ' || p_size || '-' || (p_size + 9) || 'k a Year'", "p_size * 1.0", "(p_size + 9) * 1000.0", "NULL", "'year'"),
    ("'€' || p_size || 'K'", "p_size * 1000.0", "p_size * 1000.0", "'EUR'", "NULL"),
    ("'about ' || p_size || ' per hour'", "NULL", "NULL", "NULL", "'hour'"),
    ("'Confidential, USD ' || p_size", "NULL", "NULL", "NULL", "NULL"),
    ("'gbp ' || p_size || ' to ' || (p_size + 1)", "p_size * 1.0", "p_size + 1.0", "'GBP'", "NULL"),
    ("'USD negotiable'", "NULL", "NULL", "'USD'", "NULL"),
)


def _pay_case(i, cast=None):
    body = "CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN {p[i]}" for k, p in enumerate(_PAYS)) + " END"
    return f"CAST({body} AS {cast})" if cast else body


@query("parse_salary", f"""
SELECT p_partkey, {_pay_case(1, 'DOUBLE')} AS salary_min, {_pay_case(2, 'DOUBLE')} AS salary_max, {_pay_case(3)} AS currency,
  {_pay_case(4)} AS pay_interval FROM part""")
def parse_salary(spark, sf_dir):
    p = salary.parse_salary(F.expr(_pay_case(0)), _c("p_name"), _c("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", p.alias("p")).select(
        "p_partkey", _c("p.min").alias("salary_min"), _c("p.max").alias("salary_max"),
        _c("p.currency").alias("currency"), _c("p.interval").alias("pay_interval"))


_SKILL_CASES = ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(t, '{a}')" for a in aliases) + f" THEN '{n}' END" for n, aliases in vocab.SKILLS)


@query("extract_skills", with_views(f"""
SELECT arrival, array_to_string(list_filter([{_SKILL_CASES}, 'tag ' || arrival % 3,
  CASE WHEN contains(t, 'experience with spark sql and more') THEN 'spark sql' END], lambda s: s IS NOT NULL)[1:20], '|') AS skills
FROM (SELECT arrival, ' ' || lower({_ws("title || ' ' || company || ' ' || description")}) || ' ' AS t FROM v_raw)"""))
def extract_skills(spark, sf_dir):
    tags = F.array(F.concat(F.lit(" Tag  "), (_c("arrival") % 3).cast("string")))
    return v_raw(spark, sf_dir).select("arrival", F.array_join(skills.extract_skills(
        _c("title"), _c("company"), _c("description"), tags), "|").alias("skills"))


@query("structure_description", rf"""
SELECT doc_id, array_to_string(list_transform(list_filter([('Overview', ov), ('Requirements', rq), ('Benefits', bn)], lambda s: s[2] <> ''),
  lambda s: s[1] || '=' || s[2]), '#') AS sections FROM (
  SELECT doc_id, regexp_replace({_ws("replace(text, chr(10), ' ') || '.x'")}, '^[•*\-\d.)(]+\s*', '') AS ov,
    CASE WHEN doc_id % 2 = 0 THEN 'years of ' || source || '|must ' || lang ELSE '' END AS rq,
    array_to_string(list_transform(generate_series(1, (doc_id % 30)::INT), lambda i: 'perk no ' || i), '|') AS bn FROM documents)""")
def structure_description(spark, sf_dir):
    """Whole texts, all items kept."""
    html = _description_html(_c("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", sections.render_sections(sections.structure_description(html)).alias("sections"))


def _description_html(body):
    perks = F.array_join(F.transform(F.sequence(F.lit(1), (_c("doc_id") % 30).cast("int")), lambda i: F.concat(
        F.lit("<li>perk no "), i.cast("string"), F.lit("</li>"))), "")
    return F.concat(
        F.lit("<p>"), F.replace(body, F.lit("\n"), F.lit(" ")), F.lit(".x</p>"),
        F.lit("<h3>Qualifications: </h3>"),
        F.when(_c("doc_id") % 2 == 0, F.concat(F.lit("5 years of "), "source", F.lit("<br>* must "), "lang")).otherwise(""),
        F.lit("<h3>benefits</h3><ul>"), F.when(_c("doc_id") % 30 > 0, perks).otherwise(""), F.lit("</ul>"))


@query("noise_filter", with_views(f"""
SELECT arrival, title FROM v_raw WHERE length(trim(title)) >= 4 AND NOT ({" OR ".join(
    f"contains(lower({_ws('title')} || ' ' || {_ws('description')}), '{p}')" for p in vocab.NOISE_PHRASES)})"""))
def noise_filter(spark, sf_dir):
    return norm.noise_filter(v_raw(spark, sf_dir)).select("arrival", "title")


@query("split_title_company", with_views("""
SELECT arrival, CASE WHEN hit THEN trim(regexp_extract(title, '^[^:]*:(.*)$', 1)) ELSE title END AS title,
  CASE WHEN hit THEN trim(string_split(title, ':')[1]) ELSE company END AS company FROM (
  SELECT *, source = 'weworkremotely' AND lower(company) = 'unknown company' AND contains(title, ':') AS hit FROM v_raw)"""))
def split_title_company(spark, sf_dir):
    return norm.split_title_company(v_raw(spark, sf_dir)).select("arrival", "title", "company")


@query("humanize", """
SELECT p_partkey, array_to_string(list_transform(string_split(replace(lower(p_type) || '-' || p_name || '_x', '_', '-'), '-'),
  lambda w: upper(w[1]) || w[2:]), ' ') AS shown FROM part""")
def humanize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", detail.humanize(
        F.concat(F.lower("p_type"), F.lit("-"), "p_name", F.lit("_x"))).alias("shown"))


@query("hours_per_week", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || '-' || (p_size + 1) || ' hours/week' WHEN 1 THEN p_size || ' hrs/week' END AS hours FROM part""")
def hours_per_week(spark, sf_dir):
    s = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'up to ' || p_size || '-' || (p_size + 1) || ' hours per week' "
               "WHEN 1 THEN p_name || ' ' || p_size || ' hrs / week' ELSE p_size || ' hours' END")
    return table(spark, sf_dir, "part").select("p_partkey", detail.hours_per_week(s).alias("hours"))


_BODY = r"""replace(replace(text, chr(10), ' '), ';', ',')"""
_DETAIL_SRC = f"""
SELECT doc_id, {_BODY} AS t, 'What you''ll do: Build pipelines number ' || doc_id || ' and keep them running; Review the work of peers every day.' AS resp,
  'Requirements: Ten years of patience with ' || lang || ' text; Fluent in ' || source || ' and one more.' AS req, doc_id % 4 AS form FROM documents
WHERE NOT regexp_matches(lower(text), 'requirements|qualifications|responsibilities|what you|about you|who you are|skills and experience|your work')"""
_DETAIL_TEXT = "CASE form WHEN 0 THEN t || ' ' || resp || ' ' || req WHEN 1 THEN t || ' ' || req || ' ' || resp WHEN 2 THEN t ELSE resp END"


def _detail_docs(spark, sf_dir, every=False):
    sql = (_DETAIL_SRC.partition("\nWHERE")[0] if every else _DETAIL_SRC).replace("chr(10)", "'\\n'").replace("What you''ll", "What you\\'ll").replace(
        "regexp_matches(lower(text),", "regexp_like(lower(text),").replace("FROM documents", "FROM {src}")
    docs = spark.sql(sql, src=table(spark, sf_dir, "documents"))
    return docs.withColumn("description", F.expr(_DETAIL_TEXT))


@query("detail_sections", f"""
SELECT doc_id, CASE form WHEN 3 THEN '' WHEN 2 THEN t ELSE t || ' ' END AS about,
  CASE form WHEN 0 THEN resp || ' ' WHEN 1 THEN resp WHEN 2 THEN '' ELSE resp END AS responsibilities,
  CASE form WHEN 0 THEN req WHEN 1 THEN req || ' ' || resp ELSE '' END AS requirements,
  'Position=Role|Type=Full Time|Location=Berlin' AS fields
FROM ({_DETAIL_SRC})""")
def detail_sections(spark, sf_dir):
    fields = detail.about_fields(F.lit("Role"), F.lit("full-time"), F.lit("Berlin"), F.lit(None).cast("string"), _c("description"))
    return _detail_docs(spark, sf_dir).select("doc_id", detail.detail_parts(_c("description")).alias("d"), F.array_join(
        F.transform(fields, lambda f: F.concat_ws("=", f["label"], f["value"])), "|").alias("fields")).select("doc_id", "d.*", "fields")


_POINTS = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), '\. ([a-zA-Z0-9])', '.' || chr(1) || '\1', 'g'), '[•]', chr(1), 'g'), chr(1)),
  lambda x: trim(x)), lambda x: length(x) > 20)"""


@query("split_points", f"""
SELECT doc_id, array_to_string({_POINTS}, '|') AS points, CAST(len({_POINTS}) AS INT) AS n FROM ({_DETAIL_SRC})""")
def split_points(spark, sf_dir):
    points = detail.split_points(_c("t"))
    return _detail_docs(spark, sf_dir).select(
        "doc_id", F.array_join(points, "|").alias("points"), F.size(points).alias("n"))


@query("preview_sections")
def preview_sections(spark, sf_dir):
    """Previews of every document in all four forms, words of headings in the text or not."""
    view = detail.detail_view(F.lit("Role"), F.lit("full-time"), F.lit("Berlin"), F.lit(None).cast("string"), _c("description"))
    shown = F.array_join(F.transform("v.preview", lambda s: F.concat(
        s["title"], F.lit("="), F.array_join(F.concat(F.transform(s["fields"], lambda f: f["value"]), s["items"]), "|"))), "#")
    return _detail_docs(spark, sf_dir, every=True).select("doc_id", view.alias("v")).select(
        "doc_id", shown.alias("preview"), _c("v.has_more").alias("has_more"))
