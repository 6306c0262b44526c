"""The pipeline, stage by stage."""
from pyspark.sql import functions as F

import corpus_pipeline

from conftest import SF_DIR
from llm.conftest import words


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "line dedup", "near copies", "benchmark decontamination", "mixing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF_DIR)
        assert after.columns == columns and after.schema == kept.schema
        path = corpus_pipeline.new_path(spark, "test-stage")
        after.write.parquet(path)
        after = spark.read.parquet(path)
        assert 0.7 * kept.count() <= after.count() <= kept.count()
        kept = after
    mixed = corpus_pipeline.mix(spark, kept, SF_DIR)
    assert mixed.columns == [*columns, "size", "copies"] and mixed.where("copies < 1").count() == 0


def test_empty_table(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0


def texts_left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_near_copies_keeps_one_row_and_all_clean_ones(spark, documents):
    """Rows with null ids, repeats, two texts under one id; clashing column names."""
    same, near, clean, short = (" ".join(words(k, 60)) for k in (1, 1, 2, 3))
    near = near.rsplit(" ", 1)[0] + " changed"
    rows = [(1, same), (1, same), (None, same), (2, near), (2, clean), (None, clean + " more"), (3, None), (3, None), (4, ""), (5, " "), (5, " "), (6, short), (None, short)]
    docs = documents(rows).withColumn("gone", F.lit(1)).withColumn("copy_group", F.lit("x")).withColumn("at", F.lit("y")).withColumn("row", F.lit("z"))
    after = corpus_pipeline.near_copies(spark, docs, SF_DIR)
    assert after.columns == docs.columns
    assert texts_left(after) == sorted([(1, same), (2, clean), (3, None), (3, None), (4, ""), (5, " "), (5, " "), (6, short)], key=repr)


def test_clashing_columns(spark, documents):
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    leaked = bench.where("length(text) > 200").first().text
    docs = documents([(1, leaked), (None, leaked), (1, "some clean words")])
    docs = docs.withColumns({c: F.lit("x") for c in ("bad_id", "bad_key", "bad", "leaks", "item_id", "length", "size", "copies", "text_key")})
    assert texts_left(corpus_pipeline.benchmark_leaks(spark, docs, SF_DIR)) == [(1, "some clean words")]
    mixed = corpus_pipeline.mix(spark, docs, SF_DIR)
    assert mixed.columns[-2:] == ["size", "copies"] and mixed.where("size = 3").count() in (0, 1) and mixed.schema["size"].dataType.typeName() == "long"


def test_line_stage_deals_out_no_pairs_of_unlike_lines(spark, documents, monkeypatch):
    """Lines that are alike below the border share bands; pairs of them grow with the square of their number."""
    import random

    rng = random.Random(8)
    base = "".join(rng.choices("abcdefghijklmnop ", k=240))
    rows = []
    for k in range(90):
        own = list(base)
        for _ in range(10):
            own[rng.randrange(240)] = rng.choice("0123456789")
        rows.append((k, "x" + "".join(own)))
    pairs = []

    def near_pairs(own, met, near=corpus_pipeline.line_dedup.near_pairs):
        pairs.append(met.count())
        return near(own, met)

    monkeypatch.setattr(corpus_pipeline.line_dedup, "near_pairs", near_pairs)
    assert corpus_pipeline.lines(spark, documents(rows), SF_DIR).count() <= 90
    assert 0 < sum(pairs) < 90 * 89 // 8
