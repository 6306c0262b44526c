"""Benchmark items in documents against every window."""
from collections import Counter

from logweir.llm import decontaminate

from llm.conftest import words


def bag(w, k):
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(rows, items):
    out = set()
    for i, t in rows:
        w = (t or "").lower().split()
        for j, text in items:
            own = (text or "").lower().split()
            if not own:
                continue
            k = min(5, len(own))
            for at in range(max(1, len(w) - len(own) + 1)):
                a, b = bag(w[at:at + len(own)], k), bag(own, k)
                union = sum((a | b).values())
                if union and 100 * sum((a & b).values()) >= 75 * union:
                    out.add((i, j))
    return out


def test_equals_every_window(spark, documents, odd_rows):
    items = [(k, " ".join(words(700 + k, n))) for k, n in enumerate((40, 12, 7, 3, 60))] + [(9, None), (10, "  ")]
    long_item = items[0][1].split()
    rows = list(odd_rows) + [(20, " ".join(words(1, 30) + long_item + words(2, 30))), (21, items[0][1].upper().replace(" ", "\n")),
                             (22, " ".join(long_item[:20] + ["new"] + long_item[20:])), (23, " ".join(long_item[:15])),
                             (24, items[3][1] + " tail"), (25, items[1][1] + " " + items[1][1]), (26, " ".join(words(3, 200)))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(rows)
    found = decontaminate.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute(rows, items)
    clean = decontaminate.without_benchmark(docs, benchmark)
    bad = {i for i, _ in brute(rows, items)}
    assert sorted(r.doc_id for r in clean.collect() if r.doc_id is not None) == sorted(i for i, _ in rows if i is not None and i not in bad)
    assert clean.columns == docs.columns
    assert decontaminate.contaminated(documents([]), benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


def test_blocks_miss_nothing_within_the_radius():
    import random
    rng = random.Random(1)
    edges = [k * 64 // 21 for k in range(22)]
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 20):
            b ^= 1 << bit
        assert any((a >> lo) & ((1 << (hi - lo)) - 1) == (b >> lo) & ((1 << (hi - lo)) - 1) for lo, hi in zip(edges, edges[1:]))


def test_best_window_between_two_alignments(spark, documents):
    """Words changed at both ends and some put in: the windows that shared shingles line up are all below the threshold."""
    def other(n, seed):
        return [f"other{seed}x{k}" for k in range(n)]
    one, two = ([f"{name}{k}" for k in range(1, n + 1)] for name, n in (("a", 59), ("b", 80)))
    items = [(1, " ".join(one)), (2, " ".join(two))]
    rows = [(1, " ".join(other(30, 1) + one[2:30] + other(3, 2) + one[30:58] + other(30, 3))),
            (2, " ".join(other(30, 4) + two[3:40] + other(6, 5) + two[40:77] + other(30, 6))),
            (3, " ".join(other(90, 7) + two[42:] + other(3, 8) + two[:40] + other(90, 9)))]
    expected = brute(rows, items)
    assert {(1, 1), (2, 2), (3, 2)} <= expected
    found = decontaminate.contaminated(documents(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    assert round(next(r.similarity for r in found if r.doc_id == 1), 3) == 0.774
