"""Similar lines against all pairs."""
import random

from logweir.llm import line_dedup

from llm.conftest import words


def sets(line):
    line = line.strip().lower()
    size = line_dedup.SHINGLE
    return {line[k:k + size] for k in range(max(1, len(line) - size + 1))}


def brute(rows):
    occurrences = {}
    for i, t in rows:
        for no, line in enumerate((t or "").split("\n")):
            if line.strip():
                occurrences.setdefault(line.strip().lower(), set()).add((i, no))
    lines = list(occurrences)
    top = {x: x for x in lines}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    shapes = {x: sets(x) for x in lines}
    for k, a in enumerate(lines):
        for b in lines[:k]:
            common = len(shapes[a] & shapes[b])
            if 100 * common >= 80 * len(shapes[a] | shapes[b]):
                top[root(a)] = root(b)
    groups = {}
    for x in lines:
        groups.setdefault(root(x), set()).update(occurrences[x])
    gone = {place for g in groups.values() for place in sorted(g)[1:]}
    return sorted((i, t, None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone)) for i, t in rows)


def found(docs):
    return sorted((r.doc_id, r.text, r.kept_text) for r in line_dedup.without_near_lines(docs).collect())


def test_equals_all_pairs(documents):
    base = [" ".join(words(k, 25)) for k in range(8)]
    rows = []
    for k in range(24):
        line = base[k % 8]
        rows.append((k, "\n".join([line.replace("a", "b", k % 3), "", "The end.", " ".join(words(500 + k, 12)), line[: -1 - k % 2].upper()])))
    assert found(documents(rows)) == brute(rows)


def test_odd_rows(documents, odd_rows):
    # Repeats of one doc_id and text are one document.
    rows = [(i, t) for i, t in odd_rows if i is not None and t is not None]
    assert found(documents(rows)) == brute(rows)
    nulls = {r.doc_id: r.kept_text for r in line_dedup.without_near_lines(documents(odd_rows)).collect()}
    assert nulls[1] is None and nulls[None] == ""
    assert found(documents([])) == []


def test_signatures_do_not_depend_on_neighbours():
    lines = [" ".join(words(k, 5 + 900 * (k % 3))) for k in range(9)] + ["ab", "x" * 5000, " ".join(words(7, 70))]
    together = line_dedup._signatures(lines, 6)
    assert all((line_dedup._signatures([x], 6)[0] == together[k]).all() for k, x in enumerate(lines))


def changed(rng, line, share):
    return "".join(rng.choice("abcdefghij ") if rng.random() < share else c for c in line)


def test_recall_and_share_of_candidates():
    """Of pairs at the threshold and above few are missed, at any length; of unlike ones few are candidates."""
    rng = random.Random(5)
    for length in (20, 40, 300, 480, 560, 700):
        near, far = [0, 0], [0, 0]
        for _ in range(500):
            line = "".join(rng.choice("abcdefghij ") for _ in range(length))
            for other in (changed(rng, line, 0.7 / length), changed(rng, line, 0.015), changed(rng, line, 0.15)):
                one, two = sets(line), sets(other)
                alike = len(one & two) / len(one | two)
                met = bool(set(line_dedup._signatures([line], 6)[0]) & set(line_dedup._signatures([other], 6)[0]))
                kind = near if alike >= 0.8 else far if alike < 0.4 else None
                if kind is not None:
                    kind[0] += met
                    kind[1] += 1
        assert near[1] > 100 and near[0] >= 0.99 * near[1]
        assert far[1] > 50 and far[0] <= 0.2 * far[1]


def test_a_changed_character_in_sixty_is_a_near_repeat(documents):
    line = "the quick brown fox jumps over the lazy dog while birds sing"
    other = line[:30] + "#" + line[31:]
    rows = [(1, line), (2, other)]
    shapes = [{x[k:k + 6] for k in range(55)} for x in (line, other)]
    assert len(line) == 60 and 0.8 <= len(shapes[0] & shapes[1]) / len(shapes[0] | shapes[1]) < 0.81
    assert found(documents(rows)) == [(1, line, line), (2, other, "")]


def test_texts_are_fetched_for_near_lines_only(documents, monkeypatch):
    """Lines that are half alike share bands and are told apart by parities, without their texts."""
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(240))
    rows = []
    for k in range(80):
        own = list(base)
        for _ in range(rng.choice((2, 14, 15, 16))):
            own[rng.randrange(240)] = rng.choice("0123456789")
        rows.append((k, "x" + "".join(own)))
    tables = {}

    def written(df, name, write=line_dedup.written):
        out = write(df, name)
        tables.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(line_dedup, "written", written)
    found = sorted((r.doc_id, r.text, r.kept_text) for r in line_dedup.without_near_lines(documents(rows)).collect())
    assert found == brute(rows)
    assert "bands" not in tables["lines"][0].columns
    shared = tables["shared"][0].select("line").distinct().count()
    assert sum(t.count() for t in tables["near-lines"]) < shared


def test_unlike_lines_of_a_band_are_told_apart_where_they_meet(documents, monkeypatch):
    """Many lines that are alike below the border: no pair of them is written or dealt out, whatever the parts a band is cut into."""
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(240))
    rows = []
    for k in range(90):
        own = list(base)
        for _ in range(rng.choice((3, 9, 10))):
            own[rng.randrange(240)] = rng.choice("0123456789")
        rows.append((k, "x" + "".join(own)))
    pairs, links = [], []

    def near_pairs(own, met, near=line_dedup.near_pairs):
        pairs.append(met.count())
        return near(own, met)

    def written(df, name, write=line_dedup.written):
        out = write(df, name)
        if name in ("shared", "links"):
            links.append((name, out.count()))
        return out

    monkeypatch.setattr(line_dedup, "near_pairs", near_pairs)
    monkeypatch.setattr(line_dedup, "written", written)
    expected = brute(rows)
    assert found(documents(rows)) == expected
    monkeypatch.setattr(line_dedup, "PART_LINES", 7, raising=False)
    assert found(documents(rows)) == expected
    shared = dict(links)["shared"]
    assert sum(pairs) <= 2 * shared and sum(pairs[1:2]) <= shared


def test_lines_of_different_groups_are_linked_in_cells(monkeypatch):
    """Cells reach over batches; a pair meets in one cell; only pairs of different components that the cell joins are told."""
    import pyarrow as pa

    base = "".join(random.Random(9).choices("abcdefghijklmnop ", k=200))
    texts = [base + str(k) for k in range(6)] + ["something else altogether"]
    made = next(line_dedup._with_parities(iter([pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.array(texts)], names=["line", "text"])]), 6))
    rows = pa.RecordBatch.from_arrays(
        [pa.array([1] * 7, pa.int64()), pa.array([0] * 7, pa.int32()), pa.array([1] * 7, pa.int32()), pa.array([0, 0, 1, 1, 0, 1, 1], pa.int32()), made.column(0),
         pa.array([0, 0, 2, 3, 4, 4, 6], pa.int64()), made.column(3), made.column(4), made.column(1)],
        names=["band", "low", "high", "part", "line", "component", "n", "parity", "text"])
    out = [x for batch in line_dedup._linked_in_cells(iter([rows.slice(0, 3), rows.slice(3)]), 6, 80) for x in zip(*(c.to_pylist() for c in batch.columns))]
    top = list(range(7))
    for a, b in [(0, 1), (4, 5), *out]:
        top = [top[b] if x == top[a] else x for x in top]
    assert len(set(top[:6])) == 1 and top[6] != top[0] and len(out) == 3


def test_near_lines_have_near_sketches_and_others_leave_their_band():
    """Of lines that share a band all similar ones go on, those with nothing else in common do not."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    lines = []
    for length in (20, 60, 300, 460, 700):
        for _ in range(40):
            line = "".join(rng.choices("abcdefghij ", k=length)).strip()
            lines += [line, changed(rng, line, 0.01).strip()]
    lines = list(dict.fromkeys(lines))
    made = line_dedup._sketched(lines, 6)
    band, sketch = (np.concatenate(x) for x in zip(*made))
    line = np.repeat(np.arange(len(lines)), [len(x) for x, _ in made])
    band = np.where(np.arange(len(band)) % 12 == 0, np.uint64(5), band)
    order = np.argsort(band.view(np.int64), kind="stable")
    rows = pa.RecordBatch.from_arrays([pa.array(x[order].view(np.int64)) for x in (band, line, sketch)], names=["band", "line", "sketch"])
    left, groups = {}, {}
    for batch in line_dedup._near_postings(iter([rows.slice(0, 100), rows.slice(100)])):
        for b, x in zip(*(c.to_pylist() for c in batch.columns)):
            left.setdefault(b, set()).add(x)
    for b, x in zip(band.view(np.int64).tolist(), line.tolist()):
        groups.setdefault(b, set()).add(x)
    shapes = [sets(x) for x in lines]
    near = {b: {x for x in g if any(x != y and len(shapes[x] & shapes[y]) >= 0.8 * len(shapes[x] | shapes[y]) for y in g)} for b, g in groups.items()}
    assert len(near[5]) > 50 and all(g <= left.get(b, set()) for b, g in near.items())
    assert len(left[5]) < len(groups[5])
