"""Mixing: targets, taken words, odd rows."""
from logweir.llm import mixing

from conftest import SF_DIR


def test_targets_are_met_and_capped(spark):
    rows = mixing.mixed_words(spark.read.parquet(f"{SF_DIR}/documents.parquet")).toPandas()
    assert (rows.taken <= 2 * rows["size"]).all() and (rows.target <= 2 * rows.source_size + 1e-6).all()
    by = rows.groupby(["source_size", "target"]).agg(taken=("taken", "sum"), largest=("size", "max")).reset_index()
    assert ((by.taken - by.target).abs() <= by.largest).all()
    assert abs(by.target.sum() - 1.5 * by.source_size.sum()) < 1e-3


def test_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    once, again = (sorted(map(tuple, mixing.mixed_words(d).collect())) for d in (docs, docs.repartition(7)))
    assert once == again


def test_excess_is_reshared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert found["a"] == 20 and abs(found["b"] - 295 * 2 / 3) < 1e-9 and abs(found["c"] - 295 / 3) < 1e-9


def test_odd_rows(documents, odd_rows):
    docs = documents([(i, t, None, s) for k, (i, t) in enumerate(odd_rows) for s in [("s1", None, "s2")[k % 3]]])
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(odd_rows)
    assert all(r["mix_size"] == len((r["text"] or "").split()) for r in rows)
    assert mixing.mix_sources(documents([])).collect() == []
