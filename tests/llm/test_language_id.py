"""Language of words and texts."""
from pyspark.sql import functions as F

from logweir.llm import language_id

from conftest import SF_DIR


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = language_id.predicted_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    out = found[found.held_out]
    assert len(out) and (out.lang_pred == out.lang).mean() >= 0.95
    assert found.score.between(0, 1).all()


def test_switched_text_and_neighbours(spark, documents, odd_rows):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    field = language_id.fit(docs, F.lit(True))
    one = {r.lang: r.text for r in docs.where("lang in ('en', 'de')").dropDuplicates(["lang"]).collect()}
    mixed = " ".join(one["en"].split()[:40] + one["de"].split()[:40])
    rows = [*odd_rows, (50, mixed), (51, "12 34 ++"), (52, one["de"])]
    found = language_id.with_languages(documents(rows), field)
    by = {r.doc_id: r for r in found.collect()}
    runs = by[50].lang_runs
    assert sum(r["words"] for r in runs) == 80
    assert sum(r["words"] for r in runs if r["lang"] == "en" and r["first"] < 40) >= 30
    assert sum(r["words"] for r in runs if r["lang"] == "de" and r["first"] + r["words"] > 40) >= 30
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1, 2, 3, 51))
    alone = language_id.with_languages(documents([(52, one["de"])]), field).first()
    assert (alone.lang_pred, alone.score) == ("de", by[52].score)
    assert language_id.with_languages(documents([]), field).count() == 0


def test_nothing_to_learn_from(documents):
    docs = documents([(1, "some words"), (2, None)])
    assert [r.lang_pred for r in language_id.predicted_languages(docs).collect()] == ["und", "und"]
