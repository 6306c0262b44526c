"""Factorization machine: pairs by brute force, pairs that no linear weights tell, held-out documents, odd rows."""
import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logweir.llm import toxicity

from conftest import SF_DIR
from llm.conftest import words


def _machine(seed: int) -> toxicity.Machine:
    rng = np.random.default_rng(seed)
    size = 1 << toxicity.TABLE_BITS
    return toxicity.Machine(-0.3, rng.normal(size=size).astype(np.float32), rng.normal(size=(size, 3)).astype(np.float32))


def test_margins_equal_all_pairs():
    machine = _machine(1)
    texts = [np.array(sorted(random.Random(k).sample(range(1 << toxicity.TABLE_BITS), k)), np.int64) for k in (0, 1, 2, 7, 0, 12)]
    for terms, found in zip(texts, toxicity.margins(machine, texts)):
        pairs = sum(float(machine.factors[a].astype(float) @ machine.factors[b]) for a, b in itertools.combinations(terms, 2))
        assert abs(found - (machine.bias + machine.weights[terms].sum() + pairs)) < 1e-3


def test_terms_of_a_text():
    one, again, other, none, blank = toxicity.text_terms(pa.array(["Scum, scum!", "scum scum", "scum", None, " 12 -- "]))
    assert one.tolist() == again.tolist() and not len(none) and not len(blank)
    assert len(one) == 3 and len(other) == 2 and len(set(one) & set(other)) == 1
    alone = next(toxicity.text_terms(pa.array(["héllo wörld"])))
    between = list(toxicity.text_terms(pa.array(["a", "héllo wörld", "wörldly"])))[1]
    assert alone.tolist() == between.tolist()


def test_pairs_that_linear_weights_miss():
    rng = random.Random(4)
    texts, toxic = [], []
    for _ in range(1200):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        filler = [rng.choice("abcdefgh") * 3 for _ in range(6)]
        texts.append(" ".join([*filler, "awful" if insult else "lovely", "neighbours" if group else "furniture"]))
        toxic.append(int(insult and group or not (insult or group)))
    terms = list(toxicity.text_terms(pa.array(texts)))

    def right(factors: int) -> float:
        scores = toxicity.margins(toxicity.train(terms[:900], toxic[:900], factors, deviations=0.0), terms[900:])
        return float(((scores > 0) == np.array(toxic[900:], bool)).mean())
    assert right(toxicity.FACTORS) >= 0.95 and right(0) <= 0.65


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = toxicity.toxic_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(found) > 50 and found.score.between(0, 1).all()
    assert (found.predicted == (found.score >= 0.7)).all()
    toxic, clean = found[found.toxic == 1].score.to_numpy(), found[found.toxic == 0].score.to_numpy()
    above = (toxic[:, None] > clean[None]).mean() + (toxic[:, None] == clean[None]).mean() / 2
    assert above >= 0.8 and (clean >= 0.7).mean() <= 0.05


def _labelled(spark, documents):
    rows = [(k, " ".join([*words(k, 30), *["awful"] * (k % 4 == 0), "awful" if k % 4 == 0 else "fine"])) for k in range(240)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(240)], "doc_id long, quality int, toxic int")
    return documents(rows), labels


def test_odd_rows(spark, documents, odd_rows):
    docs, labels = _labelled(spark, documents)
    machine = toxicity.fit(docs, labels, F.lit(True))
    given = [*odd_rows, (50, "such awful awful words"), (51, "such fine words")]
    rows = toxicity.with_toxicity(documents(given).withColumn("toxicity", F.lit("old")), machine).collect()
    assert len(rows) == len(given) and {type(r.toxicity) for r in rows} == {float}
    assert [r["class"] for r in rows] == ["x"] * len(rows)
    by = {r.doc_id: r.toxicity for r in rows}
    assert by[50] > 0.7 > by[51] and by[1] == by[2] == by[3] and by[6] == by[7] == by[8]
    assert toxicity.with_toxicity(documents([]), machine).count() == 0


def test_what_is_learned_from(spark, documents):
    docs, labels = _labelled(spark, documents)
    once = toxicity.fit(docs, labels, F.lit(True))
    copies = docs.unionByName(docs.where("doc_id < 120").withColumn("doc_id", F.col("doc_id") + 1000)).repartition(5)
    both_ways = labels.unionByName(labels.withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(
        spark.createDataFrame([(None, 1, 1), (7, 1, None)], labels.schema))
    again = toxicity.fit(copies, both_ways, F.col("doc_id") < 1000)
    assert once.bias == again.bias and (once.weights == again.weights).all() and (once.factors == again.factors).all()
    unsure = labels.unionByName(labels.withColumn("toxic", 1 - F.col("toxic")))
    for none in (toxicity.fit(docs, unsure, F.lit(True)), toxicity.fit(docs, labels.limit(0), F.lit(True)),
                 toxicity.fit(documents([]), labels, F.lit(True))):
        assert not none.weights.any() and none.bias == 0
