"""Matching and merging of duplicate postings.

``merge_postings`` gives exactly the result of taking the incoming rows one by one against a live
signature index, but computes it set-based.  Every row carries two guesses: the record it belongs
to and whether it takes that record over.  From the guesses of all earlier rows the state of each
record and of the index right before a row follows by running aggregates; that state yields a
better guess.  A row whose predecessors are guessed right gets the right answer in the next round,
so by induction over arrival the guesses can only come to rest on the sequential result.  No group
is collected anywhere; hot signatures and hot records are cut into ranges (``running_before``).

Only the first round sees all rows.  After it a round takes up the records that a moved row has left
or joined, and the rows that read a signature whose owners have changed; all others are settled, as
nothing they depend on is different.
"""

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import distinct_lower, is_blank, normalize_ws
from ..schema import POSTING_SCHEMA
from ..session import cut_lineage
from .ordering import with_rank
from .running import crowded, running_before

_c = F.col

# Fields taken from the leading record unless blank there.
PICKED = (
    "source_job_id", "title", "company", "location", "location_city", "location_region",
    "location_country", "workplace_type", "source_type", "source_website", "job_type",
    "experience_level", "description", "description_html", "job_url", "apply_url", "canonical_url",
    "salary_text", "salary_currency", "salary_interval",
)
_SIGNED = ("source_job_id", "url_key", "title", "company", "location_city", "location_country", "job_type")
_MOMENTS = ("posted_at", "scraped_at", "discovered_at")
# What the rounds of guessing read of a row.
_GUESSED = ("t", "stored", "source", *_SIGNED, "company_ok", "location_ok", "n_sections", "skills", "mask", "score", "n_skills", "signatures")
# Arrivals that fill at least one number in so many serve as row numbers themselves.
SPARSE = 64
# Parts of the score that can only be gained: true as soon as one row of the record has them.
_GAINED = (0, 3, 4, 5, 6, 7, 8, 10, 11, 12)


class MergeResult:
    """Outcome of a merge: the new table, one decision per incoming row, counters per source.

    Each is put together when it is first asked for: a report alone moves no texts, a table alone looks for no changes.
    """

    def __init__(self, build, decide):
        self._build, self._decide = build, decide

    @cached_property
    def postings(self) -> DataFrame:
        return self._build()

    @cached_property
    def decisions(self) -> DataFrame:
        return self._decide()

    @cached_property
    def report(self) -> DataFrame:
        return merge_report(self.decisions)


def with_signatures(postings):
    return postings.withColumn("signatures", scoring.job_signatures())


def _pairs(df, *cols):
    # The outer form, so that no filter on the list is inferred and pushed into its expression.
    return df.select(*cols, F.posexplode_outer("signatures").alias("prio", "sig")).filter(_c("sig").isNotNull())


def match_signatures(existing, incoming, key="arrival"):
    """First signature of each incoming row found among the existing ones.

    Returns (key, match_id, prio), one row per matched incoming row.  When several existing rows
    own a signature the last one counts.
    """
    index = _pairs(with_signatures(existing), "id", "arrival").groupBy("sig").agg(
        F.max_by("id", "arrival").alias("match_id"))
    hits = _pairs(with_signatures(incoming), key).join(index, "sig")
    return hits.groupBy(key).agg(F.min_by("match_id", "prio").alias("match_id"), F.min("prio").alias("prio"))


def unmatched(existing, incoming, key="arrival"):
    """Incoming rows without any signature among the existing ones."""
    return incoming.join(match_signatures(existing, incoming, key).select(key), key, "left_anti")


def _control(postings):
    """The narrow columns that decide matching, precedence and changes; wide texts stay behind."""
    flags = scoring.score_flags()
    mask = F.lit(0).cast("bigint")
    for bit in _GAINED:
        mask = mask.bitwiseOR(F.when(flags[bit], 1 << bit).otherwise(0).cast("bigint"))
    # Each text is tidied once; records put signatures together from the tidy values.
    low = {n: F.lower(_c(n)) if n == "source_job_id" else F.lower(normalize_ws(_c(n))) for n in _SIGNED if n != "url_key"}
    tidy = postings.withColumns({**{f"_low_{n}": c for n, c in low.items()}, "_low_url_key": scoring.url_key(), **_lists()})
    own = lambda n: _c(f"_low_{n}")
    return tidy.select(
        "arrival", _c("_stored").alias("stored"), "id", "source",
        *[F.when(~is_blank(_c(n)), own(n)).alias(n) for n in _SIGNED if n != "url_key"],
        F.when(own("url_key") != "", own("url_key")).alias("url_key"),
        F.when(~is_blank(_c("company")), flags[1]).alias("company_ok"),
        F.when(~is_blank(_c("location")), flags[2]).alias("location_ok"),
        F.when(F.size("description_sections") > 0, F.size("description_sections")).alias("n_sections"),
        _c("_skills").alias("skills"),
        mask.alias("mask"),
        scoring.completeness().alias("score"),
        F.size("skills").alias("n_skills"),
        scoring.joined_signatures(_c("source"), *map(own, _SIGNED)).alias("signatures"),
        *_facts(),
    )


def _lists():
    """The skills and the sources of a row, tidied."""
    tidy = lambda a, b: distinct_lower(F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array())))
    return {"_skills": tidy("skills", "tags"), "_sources": tidy("aggregated_sources", F.array("source"))}


def _facts():
    """What decides whether a row changes its record and which row fills a field; reads ``_lists``."""
    bits = F.lit(0).cast("bigint")
    tests = [~is_blank(_c(n)) for n in PICKED] + [
        F.size("description_sections") > 0, _c("salary_min").isNotNull(), _c("salary_max").isNotNull()]
    for i, test in enumerate(tests):
        bits = bits.bitwiseOR(F.when(test, 1 << i).otherwise(0).cast("bigint"))
    named = lambda mark, items: F.transform(items, lambda x: F.concat(F.lit(mark), x))
    items = F.concat(named("k:", "_skills"), named("s:", "_sources"))
    return bits.alias("bits"), items.alias("items"), *[F.unix_micros(n).alias(n) for n in _MOMENTS]


def _repeats(df):
    """Whether some arrival comes more than once."""
    counts = df.filter(_c("arrival").isNotNull()).groupBy("arrival").agg(F.count(F.lit(1)).alias("n"))
    return not counts.filter("n > 1").isEmpty()


def _gained(mask):
    return F.bit_count(mask)


def _score(mask, company_ok, location_ok, n_sections, n_skills):
    yes = lambda b: F.coalesce(b, F.lit(False)).cast("int")
    return (
        _gained(F.coalesce(mask, F.lit(0).cast("bigint"))) + yes(company_ok) + yes(location_ok)
        + yes(n_skills > 0) + F.least(F.coalesce(n_skills, F.lit(0)), F.lit(5))
        + F.least(F.coalesce(n_sections, F.lit(0)), F.lit(4))
    )


def _firsts(rows, items="skills"):
    """(rec, t), once for each item that row ``t`` brings to its record first."""
    return rows.select("rec", "t", F.explode(items).alias("item")).groupBy("rec", "item").agg(F.min("t").alias("t")).select("rec", "t")


def _judge(rows, repeats, hot):
    """Whole records with each row's better guess ``new_top`` and the signatures it ``leaves`` in the index.

    A row's first guess, if it has none: a record scores at least as high as any of its rows, so a take-over
    is mostly a new maximum.
    """
    if repeats:  # rows that share a number count their skills each
        added = _firsts(rows).groupBy("t").agg(F.count(F.lit(1)).alias("added"))
        events = rows.join(added, "t", "left").withColumn("at", _c("t") * 2)
    else:
        # First skills stand among the rows, right after the row that brings them.
        news = _firsts(rows).select("rec", (_c("t") * 2 + 1).alias("at"), F.lit(1).cast("bigint").alias("added"))
        events = rows.withColumn("at", _c("t") * 2).unionByName(news, allowMissingColumns=True)
    if "top" not in rows.columns:
        events = running_before(events, "rec", "at", {"_best": ("max", _c("score"))}, hot=hot).withColumn(
            "top", (_c("rec") == _c("t")) | F.coalesce(_c("score") > _c("_best"), F.lit(False)))
    lead = lambda n: F.when(_c("top"), _c(n))
    specs = {"p_mask": ("bit_or", _c("mask")), "p_added": ("sum", _c("added")),
             "p_source": ("last", lead("source"))}
    for n in (*_SIGNED, "company_ok", "location_ok", "n_sections"):
        specs[f"l_{n}"] = ("last", lead(n))
        specs[f"f_{n}"] = ("first", _c(n))
    seen = running_before(events, "rec", "at", specs, hot=hot).filter(_c("t").isNotNull())
    before = lambda n: F.coalesce(_c(f"l_{n}"), _c(f"f_{n}"))
    first_row = _c("rec") == _c("t")
    beats = _c("score") > _score(_c("p_mask"), before("company_ok"), before("location_ok"),
                                 before("n_sections"), _c("p_added"))
    seen = seen.withColumn("new_top", first_row | F.coalesce(beats, F.lit(True)))
    after = {n: F.when(_c("new_top"), F.coalesce(_c(n), before(n))).otherwise(F.coalesce(before(n), _c(n)))
             for n in _SIGNED}
    source = F.when(_c("new_top"), _c("source")).otherwise(F.coalesce(_c("p_source"), _c("source")))
    leaves = scoring.joined_signatures(source, *[after[n] for n in _SIGNED])
    # Rows may share a number (repeated arrivals): each has a place of its own from its first round on.
    first = [] if "top" in rows.columns else ["top"]
    place = [] if "row" in rows.columns else [F.monotonically_increasing_id().alias("row")]
    # Read several times, so it is written out once.
    return cut_lineage(seen.select(*rows.columns, *first, *place, "new_top", leaves.alias("leaves")))


def _reads(rows):
    return rows.filter(~_c("stored")).select(F.posexplode("signatures").alias("prio", "sig"), "t")


def _writes(rows, signatures, owner):
    return rows.filter(~_c("stored")).select(F.explode(signatures).alias("sig"), "t", _c(owner).alias("owner"))


def _look_up(reads, writes, stored_writes, hot):
    """(t, hit): the owner of a row's first signature that was in the index right before the row."""
    events = (
        reads.select("sig", "prio", (_c("t") * 2).alias("at"), "t", F.lit(None).cast("bigint").alias("owner"))
        .unionByName(writes.select("sig", F.lit(None).cast("int").alias("prio"), (_c("t") * 2 + 1).alias("at"), "t", "owner"))
        .unionByName(stored_writes)
    )
    # One row may name a signature once only, so (sig, at) is unique.
    looked_up = running_before(events, "sig", "at", {"hit": ("last", _c("owner"))}, hot=hot).filter(
        _c("prio").isNotNull() & _c("hit").isNotNull())
    return looked_up.groupBy("t").agg(F.min_by("hit", "prio").alias("hit"))


def _moved(rows):
    """Records that a row with a new guess has left or joined."""
    moved = rows.filter((_c("rec") != _c("new_rec")) | (_c("top") != _c("new_top")))
    return cut_lineage(moved.select(F.explode(F.array("rec", "new_rec")).alias("rec")).distinct())


def _settled(rows):
    """The new guesses.  A row that joins another record was judged against the one it left: most rows take
    no record over, and as a false leader it would send others on the same way, one in each round."""
    joined = F.when(_c("rec") == _c("new_rec"), _c("new_top")).otherwise(_c("new_rec") == _c("t"))
    return rows.withColumns({"rec": _c("new_rec"), "top": joined}).drop("new_rec", "new_top")


def _followed(rows, others=None):
    """``new_rec`` followed to where the record's first row has gone itself; ``bent`` tells such rows.

    A record is named after its first row, so a row that is sent to a record whose first row is no longer
    its own was read from a stale guess.  Steps double, so a chain of any length is followed at once and
    does not cost a round per link.  It only improves the guess: bent rows are read again every round and
    none is left when the guesses rest.
    """
    aims = rows.filter(_c("t") != _c("new_rec")).select(_c("new_rec").alias("head")).distinct()
    placed = rows.select(_c("t").alias("head"), _c("new_rec").alias("to"))
    if others is not None:
        placed = placed.unionByName(others.select(_c("t").alias("head"), _c("rec").alias("to")))
    # Rows may share a number (repeated arrivals); each head leads to one place.
    gone = cut_lineage(placed.filter(_c("head") != _c("to")).join(aims, "head", "left_semi").groupBy("head").agg(
        F.min("to").alias("to")))
    if gone.isEmpty():
        return rows.withColumn("bent", F.lit(False))
    while True:
        onward = gone.select(_c("head").alias("to"), _c("to").alias("next"))
        gone = cut_lineage(gone.select("head", "to").join(onward, "to", "left").select(
            "head", F.coalesce("next", "to").alias("to"), _c("next").isNotNull().alias("more")))
        if gone.filter("more").isEmpty():
            break
    found = rows.join(gone.select(_c("head").alias("new_rec"), "to"), "new_rec", "left")
    return cut_lineage(found.withColumns({
        "bent": _c("to").isNotNull(), "new_rec": F.coalesce("to", "new_rec")}).select(rows.columns))


def _settle(rows, stored_writes, repeats):
    """Iterate until no guess changes.  There is no cap: the loop ends when the result is exact.

    ``rows`` have a guess of their record, and of ``top`` unless they come for the first time.  Returns the
    guesses at rest and the rows' facts with what they have written to the index, linked by ``row``.  Only
    guesses change in a round, so they are kept apart: no round moves the facts of rows it does not take up.
    """
    judged = _judge(rows, repeats, crowded(rows, "rec"))
    reads, writes = _reads(judged), _writes(judged, "leaves", "rec")
    named = crowded(reads.select("sig").unionByName(writes.select("sig")).unionByName(stored_writes.select("sig")), "sig")
    hit = _look_up(reads, writes, stored_writes, named)
    guesses = cut_lineage(judged.select("row", "t", "stored", "rec", "top", "new_top").join(hit, "t", "left").select(
        "row", "t", "rec", "top", "new_top", F.when(_c("stored"), _c("t")).otherwise(F.coalesce("hit", "t")).alias("new_rec"),
        F.lit(False).alias("bent")))
    guesses = _followed(guesses)
    touched, guesses, patch = _moved(guesses), _settled(guesses), None
    # ``writes`` are what a row has left in the index, ``owner`` is the record it did so for.
    facts = judged.drop("top", "new_top").withColumnsRenamed({"rec": "owner", "leaves": "writes"})
    newest = lambda base: base if patch is None else base.join(
        patch.select("t"), "t", "left_anti").unionByName(patch.select(base.columns))
    while True:
        known, held = newest(guesses), newest(facts)
        bent = known.filter("bent").select("t")
        if touched.isEmpty() and bent.isEmpty():
            return known, held
        # Written out, so that Spark knows when they are few and leaves the facts where they are.
        taken = cut_lineage(known.join(touched, "rec", "left_semi").drop("t"))
        judged = _judge(held.join(taken, "row"), repeats, crowded(known, "rec"))
        both = _writes(judged, "writes", "owner").unionByName(_writes(judged, "leaves", "rec"))
        changed = both.groupBy("sig", "t", "owner").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("sig").distinct()
        concerned = _reads(held).join(changed, "sig", "left_semi").select("t").unionByName(bent).distinct()
        reads = cut_lineage(_reads(held).join(concerned, "t", "left_semi"))
        readers = reads.select("t").distinct()
        renewed = judged.withColumns({"writes": _c("leaves"), "owner": _c("rec")}).drop("leaves")
        done = judged.select("t")
        rest = known.join(done, "t", "left_anti")
        names = reads.select("sig").distinct()
        writes = _writes(held.join(done, "t", "left_anti"), "writes", "owner").unionByName(_writes(renewed, "writes", "owner"))
        hit = _look_up(reads, writes.join(names, "sig", "left_semi"), stored_writes.join(names, "sig", "left_semi"), named)
        waiting = cut_lineage(rest.join(readers, "t", "left_semi").withColumn("new_top", _c("top")).drop("t"))
        again = renewed.unionByName(held.join(waiting, "row"))
        again = again.join(readers.withColumn("_reads", F.lit(True)), "t", "left").join(hit, "t", "left")
        again = cut_lineage(again.withColumn("new_rec", F.when(
            _c("_reads"), F.coalesce("hit", "t")).otherwise(_c("rec"))).drop("_reads", "hit"))
        again = _followed(again, rest)
        touched = _moved(again)
        again = _settled(again)
        if patch is not None:
            again = cut_lineage(patch.join(again.select("t"), "t", "left_anti").unionByName(again))
        patch = again


def _numbered(control):
    """(rows with number ``t`` in arrival order, whether numbers repeat); existing rows come first.

    ``t`` is the distance from the first arrival, so that ranges of it hold about equal shares; arrivals that
    lie far apart, or repeat, are sorted and counted instead.
    """
    spans = {r["stored"]: r for r in control.groupBy("stored").agg(
        F.min("arrival").alias("low"), F.max("arrival").alias("high"), F.count("arrival").alias("n")).collect() if r["n"]}
    repeats = _repeats(control)
    if repeats or any(r["high"] - r["low"] >= SPARSE * r["n"] for r in spans.values()):
        ranks = with_rank(control.select("arrival").filter(_c("arrival").isNotNull()).orderBy("arrival"), "t")
        return cut_lineage(control.join(ranks, "arrival", "left")), repeats
    t, used = F.lit(None).cast("bigint"), 1
    for stored in (True, False):
        if stored in spans:
            low, high = spans[stored]["low"], spans[stored]["high"]
            t, used = F.when(_c("stored") == stored, _c("arrival") - low + used).otherwise(t), used + high - low + 1
    return control.withColumn("t", t), False


def _replay(control, repeats):
    """Decisions (t, rec, top) for the rows whose signatures meet; all others stand alone."""
    control = control.filter(_c("t").isNotNull())
    stored = control.filter("stored")
    keeper = stored.groupBy("id").agg(F.max("t").alias("keep"))
    stored = stored.join(keeper, "id")
    stored_writes = cut_lineage(stored.select(
        F.explode("signatures").alias("sig"), F.lit(None).cast("int").alias("prio"),
        (_c("t") * 2 + 1).alias("at"), "t", _c("keep").alias("owner")))
    fresh = control.filter(~_c("stored")).select(*_GUESSED)
    kept = cut_lineage(stored.filter(_c("t") == _c("keep")).select(*_GUESSED))
    live = fresh if kept.isEmpty() else fresh.unionByName(kept)

    own = _pairs(live, "t", "stored")
    everyone = own.select("sig", "t", _c("t").alias("live")).unionByName(
        stored_writes.select("sig", "t", F.lit(None).cast("bigint").alias("live")))
    shared = everyone.groupBy("sig").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.min("live").alias("low")).filter("a <> b")
    earlier = F.when((_c("low") < _c("t")) & ~_c("stored"), _c("prio"))
    guess = own.join(shared.select("sig", "low"), "sig").groupBy("t").agg(F.min_by("low", earlier).alias("low"))
    rows = cut_lineage(live.join(guess, "t").withColumn("rec", F.coalesce("low", "t")).drop("low"))
    while True:
        settled, facts = _settle(rows, stored_writes, repeats)
        # A merged record can carry a signature none of its rows had (title of one, city of the
        # other).  A row outside that has this signature must join in.
        outside = cut_lineage(own.join(rows.select("t"), "t", "left_anti").select("t", "sig"))
        written = facts.select(F.explode("writes").alias("sig"))
        reached = cut_lineage(outside.join(written, "sig", "left_semi").select("t").distinct())
        if reached.isEmpty():
            return settled.select("t", "rec", "top")
        joined = live.join(reached, "t", "left_semi").withColumns({"rec": _c("t"), "top": F.lit(True)})
        rows = cut_lineage(facts.join(settled.drop("t"), "row").select(*_GUESSED, "rec", "top").unionByName(joined))


def _rank():
    """Precedence inside a record: take-overs from the last to the first, then the others in order."""
    return F.when(_c("top"), -_c("t") - 1).otherwise(_c("t") + 1)


def _assemble(rows, table, repeats, singles=None):
    """Merged records from member rows with ``rec``, ``top`` and their facts; ``table`` has the whole rows.

    Which row leads a record and which ones fill its blanks follows from the facts; only those rows, and
    ``singles``, are then taken from the table, with all their texts.
    """
    fields = [*POSTING_SCHEMA.names, "arrival"]
    ranked = rows.withColumn("_rank", _rank())
    heads = cut_lineage(ranked.groupBy("rec").agg(
        F.min("arrival").alias("_first"), F.min_by("arrival", "_rank").alias("arrival"), F.min_by("bits", "_rank").alias("_own"),
        F.bit_or("bits").alias("_any"), F.min("posted_at").alias("_posted_at"), F.max("scraped_at").alias("_scraped_at"),
        F.min("discovered_at").alias("_discovered_at")))
    need = heads.select("rec", _c("_any").bitwiseAND(F.bitwise_not(_c("_own"))).alias("_need")).filter("_need <> 0")
    gives = _c("bits").bitwiseAND(_c("_need"))
    places = F.filter(F.array(*[F.when(gives.bitwiseAND(F.lit(1 << i)) != 0, i) for i in range(len(PICKED) + 3)]), lambda i: i.isNotNull())
    givers = ranked.select("rec", "arrival", "_rank", "bits").join(need, "rec").filter(gives != 0).select(
        "rec", "arrival", "_rank", F.explode(places).alias("_place")).groupBy("rec", "_place").agg(
        F.min_by("arrival", "_rank").alias("arrival"))
    # One row of ``wanted`` for a leading row, for each field that a row fills, and for a row on its own.
    wanted = heads.drop("_own", "_any").withColumn("_place", F.lit(-1)).unionByName(givers, allowMissingColumns=True)
    if singles is not None:
        wanted = wanted.unionByName(singles.select("arrival", F.lit(-2).alias("_place")), allowMissingColumns=True)
    picked = cut_lineage(table.select(*fields).join(wanted, "arrival"))
    lead = picked.filter("_place = -1")
    if repeats:
        lead = lead.dropDuplicates(["rec"])
    at = lambda i: _c("_place") == i
    n = len(PICKED)
    text = F.element_at(F.array(*PICKED), F.when(_c("_place") < n, _c("_place") + 1))
    gift = F.struct("_place", text.alias("text"), F.when(at(n), _c("description_sections")).alias("sections"),
                    F.when(at(n + 1), _c("salary_min")).when(at(n + 2), _c("salary_max")).alias("pay"))
    gifts = picked.filter("_place >= 0").groupBy("rec").agg(F.collect_list(gift).alias("_gifts"))
    items = ranked.select("rec", "_rank", F.posexplode("items").alias("_pos", "_item")).groupBy("rec", "_item").agg(
        F.min("_rank").alias("_rank"), F.min_by("_pos", "_rank").alias("_pos"))
    lists = items.groupBy("rec").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_rank", "_pos", "_item"))), lambda s: s["_item"]).alias("_items"))
    given = lambda i, kind: F.get(F.filter("_gifts", lambda g: g["_place"] == i), F.lit(0))[kind]
    filled = {p: F.coalesce(given(i, "text"), _c(p)) for i, p in enumerate(PICKED)}
    filled |= {"description_sections": F.coalesce(given(n, "sections"), _c("description_sections")),
               "salary_min": F.coalesce(given(n + 1, "pay"), _c("salary_min")),
               "salary_max": F.coalesce(given(n + 2, "pay"), _c("salary_max"))}
    named = lambda mark: F.coalesce(F.transform(
        F.filter("_items", lambda s: s.startswith(mark)), lambda s: F.substring(s, F.lit(3), F.length(s))),
        F.array().cast("array<string>"))
    records = lead.join(gifts, "rec", "left").join(lists, "rec", "left").withColumns({
        **filled, "arrival": _c("_first"), "skills": named("k:"), "tags": named("k:"), "aggregated_sources": named("s:"),
        **{m: F.timestamp_micros(f"_{m}") for m in _MOMENTS}})
    records = records.withColumn("quality_score", scoring.completeness()).select(*fields)
    return records if singles is None else records.unionByName(picked.filter("_place = -2").select(*fields))


def _changes(rows, repeats):
    """``rows`` with ``changed``: take-overs, first fills, new list items, moved dates alter a record."""
    narrow = rows.select("rec", "arrival", "t", "top", "source", "stored", "bits", "items", *_MOMENTS)
    # First items stand among the rows, right before the row that brings them.
    news = _firsts(narrow, "items").distinct().select("rec", (_c("t") * 2).alias("at"))
    events = narrow.withColumn("at", _c("t") * 2 + 1).drop("items").unionByName(news, allowMissingColumns=True)
    if repeats:
        events = narrow.withColumn("at", _c("t") * 2 + 1).join(_firsts(narrow, "items").distinct().select(
            "t", (_c("t") * 2).alias("_brought")), "t", "left")
    seen = running_before(events, "rec", "at", {
        "p_bits": ("bit_or", _c("bits")), "p_posted": ("min", _c("posted_at")),
        "p_scraped": ("max", _c("scraped_at")), "p_found": ("min", _c("discovered_at")),
        "p_brought": ("last", F.when(_c("t").isNull(), _c("at")))}, hot=crowded(narrow, "rec")).filter(_c("t").isNotNull())
    brought = _c("_brought") if repeats else _c("p_brought")
    changed = (
        _c("top") | (_c("bits").bitwiseAND(F.bitwise_not(_c("p_bits"))) != 0) | F.coalesce(brought == _c("at") - 1, F.lit(False))
        | (_c("posted_at") < _c("p_posted")) | (_c("scraped_at") > _c("p_scraped"))
        | (_c("discovered_at") < _c("p_found")))
    return seen.withColumn("changed", (_c("rec") != _c("t")) & F.coalesce(changed, F.lit(False)))


def merge_postings(incoming, existing=None, materialise=True):
    """Upsert ``incoming`` into ``existing`` exactly as one row after the other would.

    Both are postings with a LONG ``arrival``; existing rows count as earlier than all incoming
    ones, whatever their numbers.  Existing rows are never merged with each other; of several with
    one id the last stays.  The incoming rows are read several times and written out first, unless
    the caller says that they come straight from a table.
    """
    fields = [*POSTING_SCHEMA.names, "arrival"]
    if materialise:
        incoming = cut_lineage(incoming.select(*fields))
    new = incoming.select(*fields, F.lit(False).alias("_stored"))
    if existing is None:
        table = new
    else:
        span = existing.agg(F.max("arrival").alias("m")).first()["m"]
        low = incoming.agg(F.min("arrival").alias("m")).first()["m"]
        shift = 0 if span is None or low is None or low > span else span - low + 1
        table = existing.select(*fields, F.lit(True).alias("_stored")).unionByName(
            new.withColumn("arrival", _c("arrival") + shift))
    control, repeats = _numbered(cut_lineage(_control(table)))
    decided = cut_lineage(_replay(control, repeats))
    sizes = decided.groupBy("rec").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    members = cut_lineage(control.select("arrival", "stored", "source", "t", "bits", "items", *_MOMENTS).join(
        decided.join(sizes, "rec", "left"), "t", "left"))
    grouped, alone = members.filter("_n IS NOT NULL").drop("_n"), members.filter("_n IS NULL")

    def build():
        singles = alone.select("arrival").distinct() if repeats else alone.select("arrival")
        if existing is not None:
            last = table.filter("_stored").groupBy("id").agg(
                F.max("arrival").alias("_keep"), F.count(F.lit(1)).alias("_more")).filter("_more > 1")
            stale = table.filter("_stored").join(last, "id").filter(_c("arrival") != _c("_keep")).select("arrival")
            singles = singles.join(stale, "arrival", "left_anti")
        return _assemble(grouped, table, repeats, singles).unionByName(table.filter(_c("arrival").isNull()).select(*fields))

    shown = lambda changed: (
        "arrival", "source", "rec", "top", F.coalesce(_c("rec") == _c("t"), F.lit(True)).alias("inserted"), changed.alias("updated"))
    fresh = lambda rows: rows.filter(~_c("stored"))

    def decide():
        if repeats:
            changes = _changes(grouped, repeats).filter(_c("rec") != _c("t")).select("arrival", "changed")
            return fresh(members).join(changes, "arrival", "left").select(*shown(F.coalesce("changed", F.lit(False))))
        return fresh(_changes(grouped, repeats)).select(*shown(_c("changed"))).unionByName(
            fresh(alone).select(*shown(F.lit(False))))

    return MergeResult(build, decide)


def merge_report(decisions):
    """Counters per source: collected, inserted, updated, deduplicated."""
    return decisions.groupBy("source").agg(
        F.count(F.lit(1)).alias("collected"), F.count_if("inserted").alias("inserted"),
        F.count_if("updated").alias("updated"), F.count_if(~_c("inserted")).alias("deduplicated"))


def connected_components(pairs, node="t", via="sig"):
    """(node, component) for a bipartite table of node-to-signature pairs.

    Minimum label over each signature and back, with a jump to the label's own label each round, so
    long chains shrink quickly.  Both steps are combinable aggregates.
    """
    pairs = cut_lineage(pairs.select(_c(node).alias("node"), _c(via).alias("via")))
    labels = cut_lineage(pairs.groupBy("node").agg(F.min("node").alias("comp")))
    while True:
        low = pairs.join(labels, "node").groupBy("via").agg(F.min("comp").alias("low"))
        near = pairs.join(low, "via").groupBy("node").agg(F.min("low").alias("low"))
        stepped = labels.join(near, "node").select("node", "comp", F.least("comp", "low").alias("next"))
        jump = stepped.select(_c("node").alias("next"), _c("next").alias("hop"))
        stepped = cut_lineage(stepped.join(jump, "next").select("node", "comp", F.least("next", "hop").alias("next")))
        moved = stepped.filter(_c("comp") != _c("next")).limit(1).count()
        labels = stepped.select("node", _c("next").alias("comp"))
        if not moved:
            return labels.select(_c("node").alias(node), "comp")


def merge_canonical(postings, strict_ids=False):
    """Order-free variant for backfills: every connected group becomes one record.

    Unlike ``merge_postings`` it unites all postings linked by any chain of signatures; the most
    complete posting leads, blanks are filled in order of completeness, then arrival.  With
    ``strict_ids`` an identifier cut from a URL slug counts only when it contains a digit.
    """
    signed = with_signatures(postings)
    pairs = signed.select(_c("arrival").alias("t"), F.explode("signatures").alias("sig"))
    if strict_ids:
        pairs = pairs.filter(~_c("sig").startswith("source-id:") | F.regexp_extract("sig", "([^:]*)$", 1).rlike("[0-9]"))
    comp = connected_components(pairs).withColumnRenamed("t", "arrival")
    # Precedence: score first, then arrival.
    order = ((F.lit(22) - scoring.completeness()).cast("decimal(3,0)") * F.lit(str(1 << 63)).cast("decimal(20,0)")
             + _c("arrival").cast("decimal(20,0)"))
    members = cut_lineage(postings.withColumns(_lists()).select("arrival", order.alias("t"), *_facts()).join(comp, "arrival", "left").withColumns({
        "rec": F.coalesce("comp", "arrival"), "top": F.lit(False)}))
    return _assemble(members, postings, _repeats(members))
