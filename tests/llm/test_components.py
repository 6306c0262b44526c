"""Connected components of chains, stars and random links."""
import random

from logweir.llm import components


def test_components(spark, monkeypatch):
    monkeypatch.setattr(components, "LOCAL_LINKS", 4)
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(3, 3), (None, 4)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(-5, 7), (7, -9)]
    found = {r.node: r.component for r in components.components(
        spark.createDataFrame(links, "a long, b long").repartition(9)).collect()}
    top = {}

    def root(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    real = [(a, b) for a, b in links if a is not None and a != b]
    for a, b in real:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    assert found == {x: root(x) for link in real for x in link}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_task_has_one_python_worker(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(components, "written", lambda df, name, write=components.written: (
        plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    found = components.components(spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)]
    assert max(p.count("MapInArrow") for p in plans) == 1
