"""Host-level quality rules.

Rules are counted per document, failures are summed per host, and the failure rates of the hosts are
shrunk with a beta prior fitted to all hosts.  The base rules and the symbol rule reject a document by
themselves; the soft rules (repeated lines, capitals) reject it where they fail together.  A host whose
shrunken rate is surely above the rate of all (its lower bound passes the prior's mean) is strict: there a
document also goes if it breaks the symbol rule or a soft rule at half their limits.

Only DataFrame functions are used.  Defined results:

- NULL text: no words, so the base rule fails.  NULL host: all such rows form one host.
- No rows: no rows.  One host, or hosts without spread: the prior is as wide as one host allows and
  the rates stay close to the overall rate.
- Repeated rows and ids: each row is judged by itself.
- Very long texts: whole; the work of a row is n log n in its words.
- Columns of the input are read before any is added, so their names cannot clash.
"""

from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACES, join_side, words

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOL_PERCENT = 50
DUP_LINE_PERCENT = 30
UPPER_PERCENT = 60
#: A host is strict if its rate, less ``Z`` standard deviations, passes this multiple of the rate of all.
HOST_FACTOR = 1.0
Z = 2.0
#: Divisor of the limits on strict hosts.
STRICTER = 2

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("few_words", "repeats", "symbols", "dup_lines", "upper_case")


def _windows(w, n):
    """A 64-bit hash of each 3-word window; equal windows within one text are told by it."""
    return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
                   1, F.greatest(n - 2, F.lit(0)))


def with_metrics(rows):
    """``rows`` has ``text``; adds the counts of ``METRICS`` and the shares the rules need."""
    out = rows.withColumn("_w", words(F.col("text"))).withColumn("_n", F.size("_w"))
    w, n = F.col("_w"), F.col("_n")
    out = out.withColumn("_t", _windows(w, n))
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", lines)
    out = out.withColumn("_again", F.size(F.array_distinct("_t")) < F.size("_t"))
    out = out.withColumn("_s", F.when(F.col("_again"), F.sort_array(F.transform(
        F.col("_t"), lambda x, i: F.struct(x.alias("t"), i.alias("i"))))))
    s = F.col("_s")
    hits = F.filter(F.transform(s, lambda x, i: F.when(
        (x["t"] == F.get(s, i - 1)["t"]) | (x["t"] == F.get(s, i + 1)["t"]), x["i"])), lambda x: x.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array(i, i + 1, i + 2)))))
    text = F.coalesce(F.col("text"), F.lit(""))
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.concat_ws("", w)).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_upper": F.regexp_count(text, F.lit(r"[A-Z]")).cast("long"),
        "n_repeat_words": F.when(F.col("_again"), covered).otherwise(0).cast("long"),
    })
    return out.drop("_w", "_n", "_t", "_lines", "_again", "_s")


def rule_failures(divisor=1):
    """One boolean per rule, over the columns of ``with_metrics``; ``divisor`` tightens all but the base rules."""
    c = F.col
    return {
        "few_words": c("n_words") < MIN_WORDS,
        "repeats": 100 * c("n_repeat_words") > REPEAT_PERCENT * c("n_words"),
        "symbols": divisor * 100 * c("n_symbols") > SYMBOL_PERCENT * c("n_words"),
        "dup_lines": divisor * 100 * c("n_dup_lines") > DUP_LINE_PERCENT * c("n_lines"),
        "upper_case": divisor * 100 * c("n_upper") > UPPER_PERCENT * c("word_chars"),
    }


def host_rates(judged):
    """Failure rate of each host, shrunk towards the rate of all.

    Returns the table (host, host_docs, host_failed, host_rate, host_strict) and its number of rows.
    The prior is the moment estimate of a beta-binomial: one row of sums reaches the driver.
    """
    hosts = cut_lineage(judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed")))
    n, x = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    sums = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"),
                     F.sum(x).alias("x"), F.sum(x * x / n).alias("xx")).first()
    k, total = sums["k"], sums["n"] or 0.0
    mean = (sums["x"] + 0.5) / (total + 1.0) if k else 0.5
    spread = (sums["xx"] - sums["x"] ** 2 / total) / (mean * (1 - mean)) if total else 0.0
    room = total - sums["nn"] / total - (k - 1) if total else 0.0
    rho = min(max((spread - (k - 1)) / room if room > 0 else 0.5, 1e-4), 0.9)
    strength = (1 - rho) / rho
    rate = (x + mean * strength) / (n + strength)
    low = F.col("host_rate") - Z * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (n + strength + 1))
    return hosts.withColumn("host_rate", rate).withColumn("host_strict", low > HOST_FACTOR * mean), k


def quality_rules(docs, text="text", host="source", carry=("doc_id",)):
    """Judge every row; returns the carried columns, the counts, rule failures, host rate and ``kept``.

    ``carry`` names columns of ``docs``, or columns built from them.  The counts are written once to
    the shared folder; only sums per host are shuffled.
    """
    rows = docs.select(F.struct(*carry).alias("_carry"), F.coalesce(F.col(host), F.lit("")).alias("host"),
                       F.col(text).alias("text"))
    rows = with_metrics(rows).drop("text")
    fails = rule_failures()
    rows = rows.withColumns({f"fails_{r}": F.coalesce(fails[r], F.lit(False)) for r in RULES})
    tight = rule_failures(STRICTER)
    near = tight["symbols"] | tight["dup_lines"] | tight["upper_case"]
    base = F.col("fails_few_words") | F.col("fails_repeats")
    hard = base | F.col("fails_symbols") | (F.col("fails_dup_lines") & F.col("fails_upper_case"))
    count = sum((F.col(f"fails_{r}").cast("int") for r in RULES[1:]), F.col(f"fails_{RULES[0]}").cast("int"))
    judged = cut_lineage(rows.withColumns({
        "base_failed": base, "hard_failed": hard, "near_failed": F.coalesce(near, F.lit(False)),
        "n_failed": count, "failed": count > 0}))
    rates, k = host_rates(judged)
    out = join_side(judged, rates, "host", k, ["_carry"], "inner")
    kept = ~F.col("hard_failed") & ~(F.col("host_strict") & F.col("near_failed"))
    return out.withColumn("kept", kept).select(
        "_carry.*", *METRICS, "base_failed", "kept", "n_failed", "host_rate", "host_strict")


def keep_good(docs):
    """The rows of ``docs`` that pass, with exactly their columns."""
    whole = quality_rules(docs, carry=[F.struct("*").alias("_row")])
    return whole.filter("kept").select("_row.*")


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text,
       list_filter(regexp_split_to_array(text, '{SPACES}'), lambda x: x <> '') AS w,
       list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, host, len(w)::BIGINT AS n_words,
        length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
        length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} AS r1, 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS r2,
        100 * n_symbols > {SYMBOL_PERCENT} * n_words AS r3, 100 * n_dup_lines > {DUP_LINE_PERCENT} * n_lines AS r4,
        100 * n_upper > {UPPER_PERCENT} * word_chars AS r5,
        {STRICTER} * 100 * n_symbols > {SYMBOL_PERCENT} * n_words OR {STRICTER} * 100 * n_dup_lines > {DUP_LINE_PERCENT} * n_lines
        OR {STRICTER} * 100 * n_upper > {UPPER_PERCENT} * word_chars AS near FROM m),
h AS (SELECT host, count(*)::DOUBLE AS n, sum((r1 OR r2 OR r3 OR r4 OR r5)::INT)::DOUBLE AS x FROM f GROUP BY host),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * n) AS nn, sum(x) AS x, sum(x * x / n) AS xx,
        (sum(x) + 0.5) / (sum(n) + 1.0) AS mean FROM h),
p AS (SELECT mean, least(greatest(CASE WHEN n - nn / n - (k - 1) > 0 THEN
        ((xx - x * x / n) / (mean * (1 - mean)) - (k - 1)) / (n - nn / n - (k - 1)) ELSE 0.5 END, 1e-4), 0.9) AS rho FROM s),
q AS (SELECT host, n, mean, (x + mean * ((1 - rho) / rho)) / (n + (1 - rho) / rho) AS host_rate, (1 - rho) / rho AS strength FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 OR r2 AS base_failed,
  NOT (r1 OR r2 OR r3 OR (r4 AND r5)) AND NOT (near AND
    host_rate - {Z} * sqrt(host_rate * (1 - host_rate) / (q.n + strength + 1)) > {HOST_FACTOR} * mean) AS kept
FROM f JOIN q USING (host)
"""
