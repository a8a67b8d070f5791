"""The row-by-row merge as a table of rules, the yardstick for the set-based one.

Every field of a merged record follows one rule over the record that leads (``a``) and the other
(``b``); signatures and score are lists of parts.  One loop applies them.
"""

from hirelake.operators.merge import PICKED

BLANK = (None, "", "unknown")


def either(a, b, k):
    return b[k] if a[k] in BLANK else a[k]


def known(a, b, k):
    return b[k] if a[k] is None else a[k]


def united(*columns):
    def rule(a, b, _):
        parts = [x for column in columns for r in (a, b) for x in (r[column] if isinstance(r[column], list) else [r[column]])]
        return list(dict.fromkeys(map(str.lower, parts)))

    return rule


def extreme(pick):
    return lambda a, b, k: pick(a[k], b[k])


RULES = {
    **dict.fromkeys(PICKED, either), **dict.fromkeys(("salary_min", "salary_max"), known),
    "description_sections": lambda a, b, k: a[k] or b[k],
    **dict.fromkeys(("skills", "tags"), united("skills", "tags")),
    "aggregated_sources": united("aggregated_sources", "source"),
    "posted_at": extreme(min), "discovered_at": extreme(min), "scraped_at": extreme(max),
}
#: Points for a value: a test for one point, or the greatest number of points for a list.
POINTS = {
    **dict.fromkeys(("title", "description", "posted_at", "job_url", "skills", "source_website", "source_job_id", "scraped_at"), bool),
    "company": lambda v: bool(v) and v.lower() != "unknown company",
    "location": lambda v: bool(v) and v.lower() not in ("unspecified", "africa", "kenya"),
    **dict.fromkeys(("job_type", "experience_level"), lambda v: v != "unknown"),
}
LISTS = {"description_sections": 4, "skills": 5}
PLACE = ("title", "company", "location_city", "location_country", "job_type")
SIGNS = (
    lambda r: r["source_job_id"] and f"source-id:{r['source']}:{r['source_job_id'].lower()}",
    lambda r: next(("url:" + r[k].lower() for k in ("canonical_url", "job_url", "apply_url") if r[k]), None),
    lambda r: r["title"] and r["company"] and "content:" + "|".join((r[k] or "").lower() for k in PLACE),
)


def score(r):
    paid = any(r[k] for k in ("salary_text", "salary_min", "salary_max"))
    return paid + sum(test(r[k]) for k, test in POINTS.items()) + sum(min(len(r[k]), most) for k, most in LISTS.items())


def signatures(r):
    return [s for s in (sign(r) for sign in SIGNS) if s]


def combine(record, row):
    lead, other = (row, record) if score(row) > score(record) else (record, row)
    made = {**lead, **{k: rule(lead, other, k) for k, rule in RULES.items()}}
    return {**made, "quality_score": score(made)}


def replay(existing, incoming):
    """(records, report): records as a list, report per source."""
    records = {r["id"]: r for r in existing}
    owners = {s: key for key, r in ((r["id"], r) for r in existing) for s in signatures(r)}
    report = {}
    for row in incoming:
        key = next((owners[s] for s in signatures(row) if s in owners), None)
        before = records.get(key)
        after = row if before is None else combine(before, row)
        key = row["id"] if before is None else key
        records[key] = after
        owners.update(dict.fromkeys(signatures(after), key))
        tally = report.setdefault(row["source"], dict.fromkeys(("collected", "inserted", "updated", "deduplicated"), 0))
        for name, add in (("collected", True), ("inserted", before is None), ("deduplicated", before is not None),
                          ("updated", before is not None and after != before)):
            tally[name] += add
    return list(records.values()), report
