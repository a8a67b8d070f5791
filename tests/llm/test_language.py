import math
from collections import Counter, defaultdict

import pyarrow as pa

from hirelake.llm import language_models as m

ALPHABETS = {"aa": (0x61, 26), "cj": (0x4E00, 700), "ha": (0xAC00, 700)}


def texts():
    rows, k = [], 7
    for lang, (start, size) in ALPHABETS.items():
        for doc in range(40):
            letters = []
            for _ in range(120):
                k = (k * 1103515245 + 12345) % 2**31
                letters.append(" " if k >> 12 & 7 == 0 else chr(start + (k >> 8) % (k >> 16) % size if k >> 16 else start))
            rows.append((len(rows), "".join(letters), lang))
    return rows


def events(text):
    """Letters and boundaries of a text after its leading boundary, each with the three before it."""
    line = [0]
    for c in text + "\n":
        x = ord(c.lower()[0]) if c.isalpha() else 0
        if x or line[-1]:
            line.append(x)
    line = [0, 0, 0, *line]
    return [tuple(line[i - 3:i + 1]) for i in range(4, len(line))]


def direct(rows):
    """Kneser-Ney models of the training rows by plain dictionaries; gives the entropies of a text."""
    counts = defaultdict(lambda: [None] * 5)
    for lang in {r[2] for r in rows}:
        counts[lang][4] = Counter(g for r in rows if r[2] == lang for g in events(r[1]))
        for order in (3, 2, 1):
            counts[lang][order] = Counter(g[1:] for g in counts[lang][order + 1])
    base = 1 / (1 + len({g for c in counts.values() for g in c[1]}))
    about = {}
    for lang, c in counts.items():
        for order in range(1, 5):
            total, types = Counter(), Counter()
            for g, n in c[order].items():
                total[g[:-1]] += n
                types[g[:-1]] += 1
            once, twice = (sum(n == x for n in c[order].values()) for x in (1, 2))
            about[lang, order] = total, types, once / (once + 2 * twice) if once and twice else 0.5

    def entropy(text, lang):
        whole = events(text)
        out = 0.0
        for g in whole:
            p = base
            for order in range(1, 5):
                part = g[4 - order:]
                total, types, d = about[lang, order]
                if total[part[:-1]]:
                    p = min(1, (max(counts[lang][order][part] - d, 0) + d * types[part[:-1]] * p) / total[part[:-1]])
            out -= math.log(max(p, 1e-12))
        return out / len(whole)

    return entropy


def test_held_and_joined_models_are_kneser_ney(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = m.train(docs)
    # Every gram is kept: 251 classes of letters and bounded slots would merge some.
    whole = {(lang, g) for _, text, lang in rows for g in events(text)}
    assert model.rows.filter("kind = 0 AND ord = 4").count() == len(whole)
    entropy, some = direct(rows), rows[::20]
    h, n, letters = m.entropies((model.held, model.base), pa.array([r[1] for r in some]))
    far = {r["doc_id"]: r for r in m.joined_entropies(spark.createDataFrame(some, docs.schema).select("doc_id", "text"), model).collect()}
    for i, (doc_id, text, _) in enumerate(some):
        assert n[i] == far[doc_id]["events"] == len(events(text)) and letters[i] == far[doc_id]["letters"]
        for j, lang in enumerate(sorted(ALPHABETS)):
            want = entropy(text, lang)
            assert abs(h[i, j] - want) < 1e-9 and abs(far[doc_id]["h"][j] - want) < 1e-9


def test_identify_by_both_paths(spark):
    rows = texts()
    docs = spark.createDataFrame([*rows, (None, None, None), (1, "12 !", "aa"), (1, "", None)], "doc_id long, text string, lang string")
    held, joined = (sorted(map(tuple, m.identify(docs, docs, most).collect()), key=str) for most in (None, 0))
    assert len(held) == len(joined) == len(rows) + 3
    for a, b in zip(held, joined):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9
    assert sum(r[1] == "und" and r[2] == 0 for r in held) == 3
    good = {r[0]: r[2] for r in rows}
    assert all(r[1] == good[r[0]] for r in held if r[1] != "und")
    assert [r.lang_pred for r in m.identify(docs.limit(2), docs.limit(0)).collect()] == ["und", "und"]
    assert m.identify(docs.limit(0), docs).collect() == []
