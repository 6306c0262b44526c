"""Repeated windows against a word-by-word version."""
import hashlib

import pytest

from logweir.llm import substring_dedup

from llm.conftest import words


def brute(rows, width=50):
    first = {}
    split = [(i, (t or "").split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - width + 1 if i is not None else 0):
            key = tuple(w[k:k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1 if i is not None else 0):
            if first[tuple(w[k:k + width])] < i:
                gone.update(range(k, k + width))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


def found(docs, **options):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
                  for r in substring_dedup.without_repeats(docs, **options).collect())


@pytest.mark.parametrize("hot", [4096, 1])
def test_equals_brute_force(documents, hot):
    passage, loop = words(5, 70), words(6, 9) * 30
    rows = [(k, " ".join(words(200 + k, 60) + (passage if k % 2 else passage[:55]) + words(300 + k, 20) + (loop if k % 3 else loop[4:])))
            for k in range(12)]
    rows += [(40, rows[3][1]), (41, " ".join(passage[:49])), (42, "\n".join(passage[:50]))]
    assert found(documents(rows), hot_bucket=hot) == brute(rows)


def test_odd_rows(documents, odd_rows):
    assert found(documents(odd_rows)) == brute(odd_rows)
    assert found(documents([])) == []
