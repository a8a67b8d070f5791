"""Secret scans: Markov models of random strings against one of ordinary identifiers.

Base rules find secrets by their form (``assign``, ``access``, ``hex``).  Their distinct matches are
the labelled random strings.  The labelled ordinary ones are all other runs of identifier characters
that are shorter than ``MIN_RUN``: longer runs are what is to be judged, and hidden secrets among them
would teach the ordinary model to expect themselves.  Rows of ``labelled`` (value, secret) can be added
to either.  From them come

- the ordinary model: interpolated (Witten-Bell) trigrams of characters without case, times the
  chance of a capital after what stands before; so that words never seen are not taken for random
  strings, any letter after a letter, any digit after a digit, repeats (``_____``, ``aaaa``) and steps
  (``abcd``, ``1234``) have a share, too;
- a random model per alphabet: pairs of characters, drawn towards the uniform distribution by
  ``PRIOR`` counts a row, so that a few odd samples do not turn it into a model of words.

A stretch of a run of ``MIN_RUN`` or more identifier characters whose log-likelihood ratio reaches
``LIMIT`` is a secret of kind ``markov``; it is widened to the next of the signs ``+/_-`` or the end
of the run.  Base spans stay as they are, whether or not a ``markov`` span covers the same text.

Counting and scanning run by batches of whole texts in Arrow.  What reaches the driver are counts by
character (at most ``41**3`` and ``6 * 67**2`` rows), whatever the size of the corpus.

Defined results: NULL text counts as empty; an empty text has no spans.  Repeated rows and ids are
scanned each.  Ties in start are ordered by kind.  A very long text is a batch of its own.  Without
rows to learn from no ``markov`` span is found.  No rows: no rows.  Extra columns are not read.
"""

import re

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import byte_lengths, portions, small_batches
from .common import spans as stretch_at

MIN_RUN = 16
LIMIT = 16.0
PRIOR = 1000.0
BATCH_BYTES = 4 << 20
#: Shares of the ordinary model besides the trigrams; the first two exceed any pair of an alphabet.
REPEAT, STEP, KIN, ANY = 0.08, 0.07, 0.25, 0.01
KEEP = 0.2  # share of letters that simply keep the case of the one before
FLOOR = -14.0  # log-likelihood of a character outside a random model's alphabet

_LOWER, _UPPER, _DIGITS, _SIGNS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_-"
_CHARS = _LOWER + _UPPER + _DIGITS + _SIGNS
ALPHABETS = ("abcdef" + _DIGITS, "ABCDEF" + _DIGITS, _LOWER + _DIGITS, _UPPER + _DIGITS,
             _LOWER + _UPPER + _DIGITS, _CHARS)
_N = len(_CHARS) + 1  # 0: not in a run
_FOLDED = len(_LOWER + _DIGITS + _SIGNS) + 1
KINDS = ("assign", "access", "hex", "markov")


def _either_case(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Fixed patterns of the base rules.
_WORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
_MAYBE = rf"({_WORDS})[\"']?\x20*[:=]|AKIA[A-Z0-9]{{12}}|[0-9a-f]{{32}}"
_RULES = [re.compile(p) for p in (ASSIGN, ACCESS, HEX)]


def base_spans(text):
    """(start, kind, end, secret) of the base rules in code points, in order."""
    found = [(m.start(), 0, m.end(), m[2]) for m in _RULES[0].finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), m[0]) for m in _RULES[1].finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in _RULES[2].finditer(text) if m.end() - m.start() >= 32]
    return sorted(found)


def _tables():
    """Symbol, symbol without case and case (0 none, 1 small, 2 capital) of each byte."""
    symbol, folded, case = (np.zeros(256, np.int32) for _ in range(3))
    for i, c in enumerate(_CHARS):
        symbol[ord(c)] = i + 1
        folded[ord(c)] = (_LOWER + _DIGITS + _SIGNS).index(c.lower()) + 1
        case[ord(c)] = 1 if c in _LOWER else 2 if c in _UPPER else 0
    return symbol, folded, case


_SYMBOL, _FOLD, _CASE = _tables()


def _joined(texts):
    """Bytes of the texts with a line end before each and at the end, and where each text begins."""
    parts = [t.encode() for t in texts]
    raw = np.frombuffer(b"\n" + b"".join(p + b"\n" for p in parts), dtype=np.uint8)
    starts = 1 + np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])[:-1]]) if parts else np.zeros(0)
    return raw, starts.astype(np.int64), [len(p) for p in parts]


def _code_points(raw):
    """Byte at which each code point begins."""
    return np.flatnonzero((raw & 0xC0) != 0x80)


def _ordinary_codes(raw):
    """Code of (two before, one before, this) and of (case before, case) of each character in a run."""
    at = np.flatnonzero(_FOLD[raw])
    f, c = _FOLD[raw], _CASE[raw]
    one = f[at - 1]
    two = np.where(one > 0, f[np.maximum(at - 2, 0)], 0)
    before = np.where(one > 0, c[at - 1], 3)
    return at, (two * _FOLDED + one) * _FOLDED + f[at], before * 3 + c[at]


def _count_codes(raw):
    _, triples, cases = _ordinary_codes(raw)
    return np.bincount(triples, minlength=_FOLDED**3), np.bincount(cases, minlength=12)


def _runs(raw):
    """Where runs of identifier characters begin and end."""
    edges = np.diff(np.concatenate([[0], (_SYMBOL[raw] > 0).astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _learn(batches):
    """Counts of short ordinary runs (model 0: triples, 1: cases) and the secrets of the base rules (model 2)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    total = [np.zeros(_FOLDED**3, np.int64), np.zeros(12, np.int64)]
    schema = pa.schema([("model", pa.int32()), ("code", pa.int64()), ("n", pa.int64()), ("value", pa.string())])
    for rows in portions(batches, lambda b: byte_lengths(b.column("text")), BATCH_BYTES):
        texts = rows.column("text").combine_chunks()
        marked = pc.match_substring_regex(texts, _MAYBE).to_numpy(zero_copy_only=False)
        texts, values = texts.to_pylist(), set()
        raw, starts, sizes = _joined(texts)
        raw = raw.copy()
        for i in np.flatnonzero(marked):
            mine = raw[starts[i]:starts[i] + sizes[i]]
            points = np.append(_code_points(mine), len(mine))
            for s, _, e, value in base_spans(texts[i]):
                mine[points[s]:points[e]] = 10
                values.add(value)
        first, last = _runs(raw)
        long = last - first >= MIN_RUN
        raw[stretch_at(first[long], (last - first)[long])] = 10
        for held, new in zip(total, _count_codes(raw)):
            held += new
        if values:
            yield pa.RecordBatch.from_pydict({"model": [2] * len(values), "code": [0] * len(values),
                                              "n": [1] * len(values), "value": sorted(values)}, schema=schema)
    for model, held in enumerate(total):
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), model, np.int32)), pa.array(at), pa.array(held[at]), pa.nulls(len(at), pa.string())],
            schema=schema)


def alphabet_of(value):
    """Number of the first alphabet that holds all characters but ``.`` and ``=``; None if there is none."""
    own = set(value) - set(".=")
    return next((k for k, chars in enumerate(ALPHABETS) if own and own <= set(chars)), None)


def _learn_values(batches):
    """Distinct values to counts: secrets by alphabet and pair of characters (model 2), others as ordinary."""
    import pyarrow as pa

    total = [np.zeros(_FOLDED**3, np.int64), np.zeros(12, np.int64), np.zeros(len(ALPHABETS) * _N * _N, np.int64)]
    for batch in batches:
        secret = batch.column("secret").to_pylist()
        values = batch.column("value").to_pylist()
        raw, _, _ = _joined([v for v, s in zip(values, secret) if not s])
        for held, new in zip(total, _count_codes(raw)):
            held += new
        for value in (v for v, s in zip(values, secret) if s):
            if (k := alphabet_of(value)) is not None:
                codes = _SYMBOL[np.frombuffer(("\n" + value).encode(), dtype=np.uint8)]
                pairs = (k * _N + codes[:-1]) * _N + codes[1:]
                np.add.at(total[2], pairs[codes[1:] > 0], 1)
    for model, held in enumerate(total):
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), model, np.int32)), pa.array(at), pa.array(held[at])],
                                         names=["model", "code", "n"])


def _witten_bell(counts, lower):
    """Interpolates counts by context (rows) with the model of a shorter context."""
    total, kinds = counts.sum(-1, keepdims=True), (counts > 0).sum(-1, keepdims=True)
    return np.where(total > 0, (counts + kinds * lower) / np.maximum(total + kinds, 1), lower)


def log_ratios(triples, cases, pairs):
    """Counts to (log-likelihoods of ordinary triples, of cases, of random pairs by alphabet)."""
    n = _FOLDED
    counts = triples.reshape(n, n, n).astype(float)
    counts[:, :, 0] = 0
    uniform = np.full(n, 1 / (n - 1))
    one = _witten_bell(counts.sum((0, 1)), uniform)
    two = _witten_bell(counts.sum(0), one)
    three = _witten_bell(counts, two)
    prev, this = np.indices((n, n))
    repeat = (prev == this) & (this > 0)
    step = (this == prev + 1) & (prev > 0)
    sort = np.array([0] + [1] * len(_LOWER) + [2] * len(_DIGITS) + [3] * len(_SIGNS))
    kin = ((sort[prev] == 1) & (sort[this] == 1)) / len(_LOWER) + ((sort[prev] == 2) & (sort[this] == 2)) / len(_DIGITS)
    ordinary = ((1 - REPEAT - STEP - KIN - ANY) * three + (REPEAT * repeat + STEP * step + KIN * kin)[None]
                + ANY * uniform)
    letters = cases.reshape(4, 3)[:, 1:] + 1.0
    same = np.array([[0.5, 0.5], [1, 0], [0, 1], [0.5, 0.5]])
    case = np.ones((4, 3))
    case[:, 1:] = (1 - KEEP) * letters / letters.sum(1, keepdims=True) + KEEP * same
    random = np.full((len(ALPHABETS), _N, _N), FLOOR)
    for k, chars in enumerate(ALPHABETS):
        own = [_CHARS.index(c) + 1 for c in chars]
        seen = pairs.reshape(len(ALPHABETS), _N, _N)[k][:, own].astype(float)
        random[k][:, own] = np.log((seen + PRIOR / len(own)) / (seen.sum(1, keepdims=True) + PRIOR))
    return np.log(ordinary).ravel(), np.log(case).ravel(), random.reshape(len(ALPHABETS), -1)


def fit(docs, labelled=None):
    """Models learned from all texts of ``docs`` and, if given, rows ``value``, ``secret`` of ``labelled``.

    A value that occurs many times counts once, so that a copied secret does not shift the models.
    """
    spark = small_batches(docs.sparkSession)
    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _learn, "model int, code long, n long, value string")
    # One pass over the texts gives both kinds of rows; they are few and small next to the texts.
    found = cut_lineage(found.groupBy("model", "code", "value").agg(F.sum("n").alias("n")))
    values = found.filter("model = 2").select("value", F.lit(True).alias("secret"))
    if labelled is not None:
        more = labelled.select(F.col("value").cast("string"), F.col("secret").cast("boolean")).dropna()
        values = values.unionByName(more).distinct()
    learned = values.mapInArrow(_learn_values, "model int, code long, n long")
    counts = found.filter("model < 2").select("model", "code", "n").unionByName(learned)
    rows = counts.groupBy("model", "code").agg(F.sum("n").alias("n")).collect()
    sums = [np.zeros(_FOLDED**3, np.int64), np.zeros(12, np.int64), np.zeros(len(ALPHABETS) * _N * _N, np.int64)]
    for r in rows:
        sums[r["model"]][r["code"]] = r["n"]
    return log_ratios(*sums) if rows else None


def stretches(scores, limit):
    """Stretches whose sum reaches ``limit``, each cut where the sum has fallen by ``limit`` again."""
    found, i, n = [], 0, len(scores)
    while i < n:
        total = top = 0.0
        start = end = i
        while i < n:
            total += scores[i]
            i += 1
            if total > top:
                top, end = total, i
            elif total <= max(0.0, top - limit):
                break
        if top >= limit:
            found.append((start, end))
            i = end
    return found


def _markov(raw, model):
    """Byte spans of random stretches in the joined texts, in order."""
    ordinary, case, random = model
    starts, ends = _runs(raw)
    long = ends - starts >= MIN_RUN
    out = []
    for s, e in zip(starts[long].tolist(), ends[long].tolist()):
        run = raw[s - 1:e]
        _, triples, cases = _ordinary_codes(run)
        plain = ordinary[triples] + case[cases]
        codes = _SYMBOL[run]
        scores = random[:, codes[:-1] * _N + codes[1:]] - plain
        spans = []
        for k in np.flatnonzero(np.maximum(scores, 0).sum(1) >= LIMIT):
            spans += stretches(scores[k].tolist(), LIMIT)
        if not spans:
            continue
        signs = np.flatnonzero(codes[1:] > len(_CHARS) - len(_SIGNS))
        upto = -1
        for a, b in sorted(spans):
            left, right = np.searchsorted(signs, a), np.searchsorted(signs, b)
            a = int(signs[left - 1]) + 1 if left else 0
            b = int(signs[right]) if right < len(signs) else e - s
            if a <= upto:  # stretches of several alphabets are one
                out[-1] = (out[-1][0], max(out[-1][1], s + b))
            else:
                out.append((s + a, s + b))
            upto = out[-1][1] - s
    return out


def _scan(model):
    """Texts to their spans."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for rows in portions(batches, lambda b: byte_lengths(b.column("text")), BATCH_BYTES):
            texts = rows.column("text").combine_chunks()
            marked = pc.match_substring_regex(texts, _MAYBE).to_numpy(zero_copy_only=False)
            texts = texts.to_pylist()
            raw, starts, sizes = _joined(texts)
            found = [[] for _ in texts]
            for i in np.flatnonzero(marked):
                found[i] = [(s, k, e) for s, k, e, _ in base_spans(texts[i])]
            random = _markov(raw, model.value) if model.value else []
            home = np.searchsorted(starts, [a for a, _ in random], side="right") - 1
            points, last = None, -1
            for (a, b), i in zip(random, home.tolist()):
                if i != last:
                    points, last = _code_points(raw[starts[i]:starts[i] + sizes[i]]), i
                at = np.searchsorted(points, [a - starts[i], b - starts[i]]).tolist()
                found[i].append((at[0], 3, at[1]))
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), pa.array(spans, span)],
                                             names=["doc_id", "spans"])

    return run


def scan(docs, model):
    """``doc_id`` and ``spans``, an array of (kind, start, end) by start and kind; code points, end exclusive."""
    spark = small_batches(docs.sparkSession)
    shipped = spark.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(
        "spans array<struct<kind: string, start: long, end: long>>").fields])
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_scan(shipped), schema)


def span_digest(found):
    """Counts by kind, the digest of the base spans and all spans as one string."""
    def shown(spans):
        each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(each, ",")

    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = shown(F.filter("spans", lambda s: s["kind"] != KINDS[-1]))
    return found.select("doc_id", *[number(k) for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"),
                        shown(F.col("spans")).alias("spans"))
