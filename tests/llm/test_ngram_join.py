"""The n-gram join against all pairs."""
import random

import numpy as np
import pyarrow as pa
import pytest

from logweir.llm import ngram_join, parity

from llm.conftest import words


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                top[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i is None, i or 0, len(sets[k]), -1 if (c := least.get(root(k))) is None else c) for k, (i, _) in enumerate(rows))


def found(docs):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id)
                  for r in ngram_join.joined_documents(docs).collect())


def near_groups(seed):
    rng = random.Random(seed)
    rows = []
    passage = words(99, 40)
    for group in range(6):
        base = words(100 + group, rng.randrange(30, 200))
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(len(own))] = rng.choice("uvw") + str(rng.randrange(1000))
            rows.append((len(rows), " ".join(own + (passage if rng.random() < 0.3 else []))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("keys,frequent", [(16, 32), (1, 3)])
def test_equals_all_pairs(documents, monkeypatch, keys, frequent):
    """With one key, pivots are few and poor, so open regions are taken apart; with a low limit, prefixes are reordered."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rows = near_groups(keys)
    assert found(documents(rows)) == brute(rows)


def test_odd_rows(documents, odd_rows):
    assert found(documents(odd_rows)) == brute(odd_rows)
    assert found(documents([])) == []


def test_leading_shingles_and_places_lose_no_link():
    """Any two linked sets share a shingle that leads in the smaller one, and what they share can fit wherever they share one."""
    rng = random.Random(4)
    rows = [(k, " ".join(words(3, 60)[: rng.randrange(5, 60)] + words(k, rng.randrange(4)))) for k in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], names=["text"])
    postings = pa.Table.from_batches(ngram_join._prefixes(iter([batch]), 5, 75, None)).to_pylist()
    own = {}
    for p in postings:
        own.setdefault(p["class"], {})[p["shingle"]] = (p["at"], p["leads"])
    sets = {ngram_join._class(s): set(s.tolist()) for s in ngram_join._sets(batch.column(0), 5)}
    linked = 0
    for a, x in sets.items():
        for b, y in sets.items():
            if a != b and len(x) <= len(y) and 100 * len(x & y) >= 75 * len(x | y):
                linked += 1
                both = own[a].keys() & own[b].keys()
                assert any(own[a][s][1] for s in both)
                for s in both:
                    i, j = own[a][s][0], own[b][s][0]
                    assert (min(i, j) + min(len(x) - i, len(y) - j)) * 175 >= 75 * (len(x) + len(y))
    assert linked > 20 and not all(p["leads"] for p in postings)


def test_postings_are_written_once(documents, monkeypatch):
    """Prefixes are taken from the texts twice, for their counts and for the join, and a class told by several tasks is joined once."""
    names, written = [], ngram_join.written

    def kept(df, name):
        out = written(df, name)
        names.append((name, out))
        return out

    monkeypatch.setattr(ngram_join, "written", kept)
    rows = near_groups(1)
    assert found(documents(rows * 3).repartition(6)) == sorted(brute(rows) * 3)
    tables = dict(names)
    assert tables["prefixes"].count() >= tables["postings"].count() == tables["postings"].select("shingle", "class").distinct().count() > 0


def half_alike(n):
    """Texts with own words in place of some of one text's, so that most pairs share prefix shingles and few are near."""
    rng = random.Random(8)
    base = words(7, 140)
    rows = []
    for k in range(n):
        own = list(base)
        for at in rng.sample(range(140), rng.choice((1, 5, 6, 7, 8))):
            own[at] = f"own{k}x{at}"
        rows.append((k, " ".join(own)))
    return rows


def test_texts_that_are_half_alike_are_not_all_measured(documents, monkeypatch):
    measured = []

    def written(df, name, write=ngram_join.written):
        out = write(df, name)
        if name == "pairs":
            measured.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", written)
    rows = half_alike(150)
    assert found(documents(rows)) == brute(rows)
    assert sum(measured) < 3 * len(rows)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 3, 140, 400, 900, 5000):
        for changed in (0, 1, n // 8, n // 2, n):
            x = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
            y = np.concatenate([x[changed:], rng.integers(0, 1 << 63, changed + n // 9, np.uint64)])
            apart = parity.differing(parity.parity(x).view(np.int64), parity.parity(y).view(np.int64))
            assert apart <= len(np.setxor1d(x, y)) and (changed + n // 9 > 0 or apart == 0)
            assert changed != n // 2 or n > 900 or n < 100 or apart > n // 3
