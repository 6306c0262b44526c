"""Source divergence: plain Python on small tables, both ways of counting, odd rows."""
import collections
import math
import random
import re

import pytest

from logweir.llm import divergence


def expected(rows, least, top):
    """The result rows of (text, lang, source), from dense counts and exact fractions."""
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), lang or "", source or "")
            for text, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        seen = collections.Counter(t for d in own for t in set(d[0]))
        kept = sorted((t for t, n in seen.items() if n >= least), key=lambda t: t.encode())
        counts = {s: collections.Counter(t for d in own if d[2] == s for t in d[0] if seen[t] >= least) for s in {d[2] for d in own}}
        whole = sum(counts.values(), collections.Counter())

        def share(count, term):
            return 1 + math.floor(10 ** 9 * (count[term] + 2) // (sum(count.values()) + 2 * len(kept)))

        def f(p, q):
            return (p - q) ** 2 // (p + q)
        for source, count in counts.items():
            pairs = [(s, sum(f(share(count, t), share(c, t)) for t in kept)) for s, c in counts.items() if s != source]
            terms = [(t, f(share(count, t), share(whole, t))) for t in kept if count[t] and share(count, t) > share(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def random_rows(seed, n):
    rng = random.Random(seed)
    names = ["a", "B", "ab", "é", "Ω", "word", "other", "rare"]
    return [(rng.choice([None, "", " 12 ", *[" ".join(rng.choices(names, range(1, 9), k=rng.randrange(1, 40))) for _ in range(8)]]),
             rng.choice(["en", "en", "en", "de", None, "", "xx"] if k else ["lonely"]), rng.choice(["s1", "s1", "s2", "s3", None, "é"])) for k in range(n)]


@pytest.mark.parametrize("limit", [divergence.VOCABULARY_LIMIT, 0])
def test_random_tables(spark, monkeypatch, limit):
    monkeypatch.setattr(divergence, "_ENTRIES", 5)
    rows = random_rows(1, 300)
    df = spark.createDataFrame([(k, *r, "t", "c", 1) for k, r in enumerate(rows)],
                               "doc_id long, text string, lang string, source string, term string, terms string, count int").repartition(3)
    got = sorted(tuple(r) for r in divergence.source_divergence(df, least=4, top=2, vocabulary_limit=limit).collect())
    assert got == expected(rows, 4, 2)


def test_sums_that_are_passed_on(spark, monkeypatch):
    rows = random_rows(2, 200)
    df = spark.createDataFrame(rows, "text string, lang string, source string").na.fill("")
    ways = []
    for limit, cells in ((10 ** 6, 1 << 23), (10 ** 6, 10), (0, 0)):
        monkeypatch.setattr(divergence, "_CELLS", cells)
        ways.append(sorted(tuple(r) for r in divergence.source_term_counts(df, 3, limit).collect()))
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) > 20


def test_odd_rows(spark, documents, odd_rows):
    docs = documents([(i, t, ("en", None)[k % 2], ("s", None, "t")[k % 3]) for k, (i, t) in enumerate(odd_rows)])
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    got = sorted(tuple(r) for r in divergence.source_divergence(docs, least=2).collect())
    assert got == expected(rows, 2, 10) and any(r[2] == "term" for r in got)
    assert divergence.source_divergence(documents([])).collect() == []
    alone = divergence.source_divergence(documents([(1, "some words", "en", "a"), (2, None, "en", "b")])).collect()
    assert sorted(tuple(r) for r in alone) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_texts_are_counted_once_for_the_vocabulary(spark, documents, monkeypatch):
    """CountVectorizer is fitted on kept terms alone, not on the texts again; and the limit is on kept terms, not on all that occur."""
    fitted, fit = [], divergence.CountVectorizer.fit
    monkeypatch.setattr(divergence.CountVectorizer, "fit", lambda self, df, *more: (fitted.append(sorted(t for r in df.collect() for t in r.terms)),
                                                                                   fit(self, df, *more))[1])
    monkeypatch.setattr(divergence, "_TASK_TERMS", 5)
    rows = [(k, f"often often \u00e9t\u00e9 rare{chr(97 + k)} Twice" if k < 4 else "only here", "en" if k < 4 else "de", "ab"[k % 2]) for k in range(5)]
    df = documents(rows).repartition(3)
    got = sorted(tuple(r) for r in divergence.source_term_counts(df, 4, 3).collect())
    assert fitted == [["often", "twice", "\u00e9t\u00e9"]]
    assert got == sorted(("en", s, t, 4 if t == "often" else 2) for s in "ab" for t in ("often", "twice", "\u00e9t\u00e9"))
