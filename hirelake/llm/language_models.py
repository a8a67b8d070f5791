"""Language identification with interpolated Kneser-Ney character models.

Texts become lower-case letters, every run of other characters one boundary.  Spark counts all 4-grams
of each language over all training texts and derives the continuation counts of the lower orders; a
gram is its code points, 21 bits each, two in ``hi`` and two in ``lo``, so none is folded into another.
The model is a table of all grams and contexts with their counts and grows with the training texts.
Up to ``HELD_ROWS`` rows it is sent to the tasks as sorted arrays, 4-grams under a 64-bit hash; a larger
one stays a table, and the distinct grams of the texts are joined to it.  A text goes to the language with the lowest
cross-entropy per character; the confidence is a softmax whose temperature is fitted on a bounded
hash sample of training rows, and so is the score below which a guess is flagged ``rejected``.

Defined results: NULL text and text without a letter: ``und``, score 0.  Ties go to the smaller
language name.  NULL languages are not learned; with no training row at all, every text is ``und``.
Repeated rows and ids are separate.  A NULL id is held in no fold but learned from.  Extra columns
are not read.  No rows: no rows.
"""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import byte_lengths, fold, join_side, portions, small_batches, stored

ORDER = 4
BITS = 21
MASK = (1 << BITS) - 1
#: Rows of a model up to which the tasks hold it; a larger one is joined.
HELD_ROWS = 2_000_000
MAX_LANGUAGES = 256
CALIBRATION = 4096
PRECISION = 0.99
FOLDS, HELD_OUT = 3, 1
BATCH_BYTES = 2 << 20
_FLUSH = 1_000_000


class _Letters:
    """Table from code points to lower-case letters, 0 for all else, made once per process."""

    tables = None

    @classmethod
    def get(cls):
        if cls.tables is None:
            chars = [chr(c) for c in range(0x110000)]
            letter = np.fromiter((c.isalpha() for c in chars), bool, len(chars))
            lower = np.fromiter((ord(c.lower()[0]) if c.isalpha() else 0 for c in chars), np.int64, len(chars))
            cls.tables = np.where(letter, lower, 0)
        return cls.tables


def mixed(hi, lo):
    """64-bit hash of a gram."""
    with np.errstate(over="ignore"):
        h = hi.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.astype(np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def suffix(hi, lo, order):
    """The last ``order`` letters of 4-grams; arrays and columns alike."""
    if order == 4:
        return hi, lo
    if order == 3:
        return _low(hi), lo
    return hi * 0, lo if order == 2 else _low(lo)


def context(hi, lo):
    """All letters of a gram but the last."""
    if isinstance(hi, np.ndarray):
        return hi >> BITS, (_low(hi) << BITS) | (lo >> BITS)
    return F.shiftright(hi, BITS), F.shiftleft(_low(hi), BITS).bitwiseOR(F.shiftright(lo, BITS))


def _low(x):
    return x & MASK if isinstance(x, np.ndarray) else x.bitwiseAND(F.lit(MASK))


def grams(texts):
    """4-grams of an Arrow string array: their two halves, the row of each, and letters per row."""
    import pyarrow.compute as pc

    values = pc.fill_null(texts, "").to_pylist()
    sizes = np.array([len(t) + 2 for t in values], dtype=np.int64)
    points = np.frombuffer("".join(f"\n{t}\n" for t in values).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    classes = _Letters.get()[points]
    owner = np.repeat(np.arange(len(values)), sizes)
    letters = np.bincount(owner[classes > 0], minlength=len(values))
    keep = (classes > 0) | np.concatenate([[True], (classes[:-1] > 0) | (owner[1:] != owner[:-1])])
    classes, owner = classes[keep], owner[keep]
    if not len(classes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), owner, letters

    def back(n):
        """The class ``n`` places before, a boundary beyond the text's start."""
        out = np.zeros_like(classes)
        out[n:] = np.where(owner[n:] == owner[:-n], classes[:-n], 0)
        return out

    hi, lo = (back(3) << BITS) | back(2), (back(1) << BITS) | classes
    first = np.concatenate([[True], owner[1:] != owner[:-1]])  # the leading boundary is no event
    return hi[~first], lo[~first], owner[~first], letters


def _distinct(hi, lo, by=None):
    """The place of each gram among the distinct ones, and the first index of each of those."""
    import pyarrow as pa

    coded = pa.array(mixed(hi, lo) if by is None else mixed(mixed(hi, lo), by)).dictionary_encode()
    code = coded.indices.to_numpy()
    first = np.zeros(len(coded.dictionary), dtype=np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return code, first


def _count(batches):
    """Text and language to (language, gram, count), summed per task."""
    import pyarrow as pa

    held = {}

    def out():
        for lang, parts in held.items():
            hi, lo, n = _summed(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(hi), pa.string()), pa.array(hi), pa.array(lo), pa.array(n)], names=["lang", "hi", "lo", "n"])

    for rows in portions(batches, lambda b: byte_lengths(b.column("text")), BATCH_BYTES):
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        of = langs.indices.to_numpy()
        hi, lo, owner, _ = grams(rows.column("text").combine_chunks())
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            own = of[owner] == i
            some_hi, some_lo = hi[own], lo[own]
            code, first = _distinct(some_hi, some_lo)
            n = np.bincount(code, minlength=len(first)).astype(np.int64)
            held.setdefault(lang, []).append((some_hi[first], some_lo[first], n))
            if len(held[lang]) > 32:
                held[lang] = [_summed(held[lang])]
        if sum(len(n) for parts in held.values() for _, _, n in parts) > _FLUSH * 4:
            yield from out()
            held = {}
    yield from out()


def _summed(parts):
    hi, lo, n = (np.concatenate(x) for x in zip(*parts))
    code, first = _distinct(hi, lo)
    return hi[first], lo[first], np.bincount(code, n, len(first)).astype(np.int64)


class Model:
    """Counts of all languages: ``rows`` is the table, ``held`` its arrays if it is small enough.

    ``discounts`` is {language: one discount per order}, ``base`` the probability of any letter before
    a context is known: one over the letters of all languages and one unseen.
    """

    def __init__(self, rows, most):
        self.rows = rows
        once = rows.filter("kind = 0").groupBy("lang", "ord").agg(
            F.sum((F.col("n") == 1).cast("long")).alias("once"), F.sum((F.col("n") == 2).cast("long")).alias("twice"))
        found = once.limit(MAX_LANGUAGES * ORDER + 1).collect()
        if len(found) > MAX_LANGUAGES * ORDER:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        self.discounts = {lang: [0.5] * ORDER for lang in sorted({r["lang"] for r in found})}
        for r in found:
            if r["once"] and r["twice"]:
                self.discounts[r["lang"]][r["ord"] - 1] = r["once"] / (r["once"] + 2 * r["twice"])
        self.base = 1 / (1 + rows.filter("kind = 0 AND ord = 1").select("lo").distinct().count())
        self.n_rows = rows.count()
        self.held = self._arrays() if self.n_rows <= most else None

    def _arrays(self):
        got, models = self.rows.toPandas(), {}
        for lang, d in self.discounts.items():
            some, models[lang] = got[got.lang == lang], []
            for order in range(1, ORDER + 1):
                sides = []
                for kind in (0, 1):
                    one = some[(some.ord == order) & (some.kind == kind)]
                    keys = mixed(one.hi.to_numpy(np.int64), one.lo.to_numpy(np.int64))
                    at = np.argsort(keys)
                    sides.append((keys[at], one.n.to_numpy(np.float64)[at], one.types.to_numpy(np.float64)[at]))
                models[lang].append((*sides[0][:2], *sides[1], d[order - 1]))
        return models


def train(docs, most=None):
    """Model from rows with text and lang; held by the tasks up to ``most`` rows."""
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    table = stored(rows.mapInArrow(_count, "lang string, hi long, lo long, n long").groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n")))
    parts = []
    for order in range(ORDER, 0, -1):
        ctx = context(F.col("hi"), F.col("lo"))
        about = ("lang", F.lit(order).alias("ord"))
        parts.append(table.select(*about, F.lit(0).alias("kind"), "hi", "lo", "n", F.lit(0).cast("long").alias("types")))
        parts.append(table.groupBy(*about, F.lit(1).alias("kind"), ctx[0].alias("hi"), ctx[1].alias("lo")).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")))
        if order > 1:
            # A gram of the next order counts the different letters that stand before it.
            less = suffix(F.col("hi"), F.col("lo"), order - 1)
            table = stored(table.groupBy("lang", less[0].alias("hi"), less[1].alias("lo")).agg(F.count(F.lit(1)).alias("n")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return Model(stored(whole), HELD_ROWS if most is None else most)


def _look(keys, values, wanted):
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def log_probabilities(model, base, hi, lo):
    """Natural log of the interpolated Kneser-Ney probability of each 4-gram's last letter."""
    p = np.full(len(hi), base)
    for order in range(1, ORDER + 1):
        gram_keys, counts, ctx_keys, totals, types, d = model[order - 1]
        part = suffix(hi, lo, order)
        ctx = mixed(*context(*part))
        total, kinds = _look(ctx_keys, totals, ctx), _look(ctx_keys, types, ctx)
        n = _look(gram_keys, counts, mixed(*part))
        got = (np.maximum(n - d, 0) + d * kinds * p) / np.maximum(total, 1)
        p = np.where(total > 0, np.minimum(got, 1), p)
    return np.log(np.maximum(p, 1e-12))


def entropies(held, texts):
    """Cross-entropy per character, a row per text and a column per language, and letters per text."""
    models, base = held
    hi, lo, owner, letters = grams(texts)
    n = np.bincount(owner, minlength=len(letters))
    code, first = _distinct(hi, lo)
    out = np.zeros((len(letters), len(models)))
    for j, model in enumerate(models.values()):
        if len(code):
            logs = log_probabilities(model, base, hi[first], lo[first])
            out[:, j] = -np.bincount(owner, logs[code], len(letters)) / np.maximum(n, 1)
    return out, n, letters


def _row_grams(batches):
    """Distinct 4-grams of every row, and how often each occurs in it."""
    import pyarrow as pa

    for rows in portions(batches, lambda b: byte_lengths(b.column("text")), BATCH_BYTES):
        hi, lo, owner, _ = grams(rows.column("text").combine_chunks())
        code, first = _distinct(hi, lo, owner)
        n = np.bincount(code, minlength=len(first)).astype(np.int64)
        rids = rows.column("rid").to_numpy()
        for at in range(0, len(first), _FLUSH):
            f = first[at:at + _FLUSH]
            yield pa.RecordBatch.from_arrays([pa.array(rids[owner[f]]), pa.array(hi[f]), pa.array(lo[f]), pa.array(n[at:at + _FLUSH])],
                                             names=["rid", "hi", "lo", "n"])


def gram_logs(distinct, model):
    """``hi``, ``lo`` and ``logs``: the log-probability of each gram in all languages, by joins to the table."""
    spark = distinct.sparkSession
    langs = spark.createDataFrame([(lang, d) for lang, d in model.discounts.items()], "lang string, d array<double>")
    table = distinct.crossJoin(F.broadcast(langs)).withColumn("p", F.lit(model.base))
    for order in range(1, ORDER + 1):
        part = suffix(F.col("hi"), F.col("lo"), order)
        for kind, (hi, lo), names in ((0, part, ("n", "_")), (1, context(*part), ("total", "kinds"))):
            side = model.rows.filter((F.col("ord") == order) & (F.col("kind") == kind)).select(
                "lang", F.col("hi").alias("khi"), F.col("lo").alias("klo"), F.col("n").alias(names[0]), F.col("types").alias(names[1]))
            table = join_side(table.withColumns({"khi": hi, "klo": lo}), side, ["lang", "khi", "klo"], side.count(), ["hi", "lo"])
            table = table.drop("khi", "klo", "_").fillna(0, subset=[x for x in names if x != "_"])
        d, p = F.col("d")[order - 1], F.col("p")
        got = (F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("kinds") * p) / F.greatest(F.col("total"), F.lit(1))
        table = cut_lineage(table.withColumn("p", F.when(F.col("total") > 0, F.least(got, F.lit(1.0))).otherwise(p)).drop(
            "n", "total", "kinds"))
    logs = F.array_sort(F.collect_list(F.struct("lang", F.log(F.greatest("p", F.lit(1e-12))).alias("x"))))
    return table.groupBy("hi", "lo").agg(logs["x"].alias("logs"))


def joined_entropies(rows, model):
    """``rows`` (text and others) with ``h``, ``events`` and ``letters`` in place of the text, for a model too large to hold."""
    keyed = cut_lineage(rows.withColumn("rid", F.monotonically_increasing_id()))
    some = stored(keyed.select("rid", "text").mapInArrow(_row_grams, "rid long, hi long, lo long, n long"))
    logs = cut_lineage(gram_logs(some.select("hi", "lo").distinct(), model))
    whole = join_side(some, logs, ["hi", "lo"], logs.count(), ["rid"])
    summed = whole.select("rid", "n", _low(F.col("lo")).alias("last"), F.posexplode("logs").alias("pos", "x")).groupBy("rid", "pos").agg(
        F.sum(F.col("n") * F.col("x")).alias("x"), F.sum("n").alias("events"),
        F.sum(F.when(F.col("last") > 0, F.col("n")).otherwise(0)).alias("letters"))
    h = F.array_sort(F.collect_list(F.struct("pos", (-F.col("x") / F.col("events")).alias("x"))))
    per_row = summed.groupBy("rid").agg(h["x"].alias("h"), F.first("events").alias("events"), F.first("letters").alias("letters"))
    none = F.array_repeat(F.lit(0.0), len(model.discounts))
    return keyed.drop("text").join(per_row, "rid", "left").withColumns({
        "h": F.coalesce("h", none), "events": F.coalesce("events", F.lit(0)), "letters": F.coalesce("letters", F.lit(0))}).drop("rid")


def _entropies_of(rows, shipped):
    """As ``entropies``, read from the columns if they are there."""
    if "h" not in rows.column_names:
        return entropies(shipped.value, rows.column("text").combine_chunks())
    h = rows.column("h").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return h.reshape(rows.num_rows, -1), rows.column("events").to_numpy(), rows.column("letters").to_numpy()


def _row_bytes(batch):
    return byte_lengths(batch.column("text")) if "text" in batch.schema.names else np.full(batch.num_rows, 64)


def _posteriors(h, n, temperature):
    z = -(h - h.min(axis=1, keepdims=True)) * (np.maximum(n, 1)[:, None] ** 0.5) / temperature
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def _calibration_rows(shipped):
    def run(batches):
        import pyarrow as pa

        for rows in portions(batches, _row_bytes, BATCH_BYTES):
            h, n, letters = _entropies_of(rows, shipped)
            keep = np.flatnonzero(letters > 0)
            yield pa.RecordBatch.from_arrays(
                [rows.column("lang").combine_chunks().take(pa.array(keep)), pa.array([v.tobytes() for v in h[keep]], pa.binary()),
                 pa.array(n[keep].astype(np.int64))], names=["lang", "h", "n"])

    return run


def calibrate(docs, model, shipped):
    """Temperature of the softmax, and the score from which guesses are right often enough."""
    some = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    chosen = some.select("doc_id").filter(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION)
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema).distinct()
    rows = some.join(F.broadcast(chosen), "doc_id", "left_semi").select("text", "lang")
    rows = rows if model.held is not None else joined_entropies(rows, model)
    got = rows.mapInArrow(_calibration_rows(shipped), "lang string, h binary, n long").collect()
    if not got:
        return 1.0, 0.0
    langs = list(model.discounts)
    h = np.stack([np.frombuffer(r["h"]) for r in got])
    n = np.array([r["n"] for r in got])
    truth = np.array([langs.index(r["lang"]) for r in got])
    grid = np.geomspace(0.05, 20, 40)
    loss = [-np.log(np.maximum(_posteriors(h, n, t)[np.arange(len(h)), truth], 1e-6)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    score, right = _posteriors(h, n, temperature).max(axis=1), h.argmin(axis=1) == truth
    order = np.argsort(-score, kind="stable")
    precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
    return temperature, float(score[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0


def _predict(shipped, langs, temperature, limit):
    def run(batches):
        import pyarrow as pa

        names = np.array([*langs, "und"], dtype=object)
        for rows in portions(batches, _row_bytes, BATCH_BYTES):
            if langs:
                h, n, letters = _entropies_of(rows, shipped)
                score = np.where(letters > 0, _posteriors(h, n, temperature).max(axis=1), 0.0)
                best = np.where(letters > 0, h.argmin(axis=1), len(langs))
            else:
                score, best = np.zeros(rows.num_rows), np.zeros(rows.num_rows, dtype=int)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").combine_chunks(), pa.array(names[best], pa.string()), pa.array(score),
                 pa.array(score < limit)], names=["doc_id", "lang_pred", "score", "rejected"])

    return run


def identify(docs, training, most=None):
    """``doc_id``, ``lang_pred``, ``score`` and ``rejected`` for every row; learns from ``training``."""
    spark = small_batches(docs.sparkSession)
    model = train(training, most)
    shipped = spark.sparkContext.broadcast((model.held, model.base)) if model.held is not None else None
    temperature, limit = calibrate(training, model, shipped)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    rows = docs.select("doc_id", "text")
    rows = rows if model.held is not None else joined_entropies(rows, model)
    return rows.mapInArrow(_predict(shipped, list(model.discounts), temperature, limit), schema)


def held_out(doc_id):
    return fold(doc_id, FOLDS) == HELD_OUT
