"""Documents to a training mix: stages that each apply one operator to what the one before kept."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import decontaminate, language_id, line_dedup, mixing, ngram_join
from logweir.llm.scratch import new_path, small_arrow_batches, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# A text is rejected when no language has at least half of its words.
LEAST_LANGUAGE_SCORE = 0.5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: texts that are null, have no letter, or are of no language for the most part go."""
    small_arrow_batches(spark)
    field = language_id.fit(docs, ~language_id.held_out(F.col("doc_id")))
    found = language_id.with_languages(docs, field, with_runs=False)
    known = F.lit(field is None) | ((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return found.where(known).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that nearly repeat an earlier one; a document that loses all it has goes."""
    small_arrow_batches(spark)
    found = line_dedup.without_near_lines(docs)
    emptied = (F.col("n_removed") > 0) & F.col("kept_text").rlike(r"^\s*$")
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)}
    return found.where(~F.coalesce(emptied, F.lit(False))).select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, texts joined by links: the one with the smallest doc_id, then text hash.

    Groups are of texts, so that rows of one doc_id with different texts are judged apart; a null doc_id comes after all others, and of rows that
    are equal in both one stays. Rows whose texts have no words are linked with nothing and all stay.
    """
    small_arrow_batches(spark)
    key = F.xxhash64("text")
    # Every different text is one document of the join, under a number of its own.
    found = ngram_join.ngram_components(docs.select(key.alias("doc_id"), "text").where("text IS NOT NULL"))
    groups = written(found.where("n_shingles > 0").select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")).distinct(), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    rows = docs.select("doc_id", key.alias("key")).groupBy("doc_id", "key").agg(F.count("*").alias("times")).join(groups, "key")
    rows = written(rows.withColumn("place", place), "places")
    firsts = rows.groupBy(F.col("group").alias("own")).agg(F.min("place").alias("first"))
    judged = rows.join(firsts, F.col("group") == F.col("own")).select(
        F.struct("doc_id", "key").alias("copy"), (F.col("place") == F.col("first")).alias("stays"), "times")
    judged = written(judged.where("NOT stays OR times > 1"), "copies").alias("copies")
    own = F.struct(F.col("docs.doc_id"), F.xxhash64("docs.text").alias("key"))
    marked = docs.alias("docs").join(judged, own.eqNullSafe(F.col("copies.copy")), "left")
    alone = marked.where("copies.stays IS NULL").select("docs.*")
    # Of equal rows that stay, one does.
    every = F.struct(*[F.col(f"docs.`{c}`") for c in docs.columns])
    one = marked.where("copies.stays").groupBy("copies.copy").agg(F.first(every).alias("row")).select("row.*")
    return alone.unionByName(one)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their size in words and number of copies, in place of columns of these names."""
    mixed = mixing.mix_sources(docs)
    return mixed.where("mix_copies > 0").select(*[c for c in docs.columns if c not in ("size", "copies")],
                                                F.col("mix_size").alias("size"), F.col("mix_copies").alias("copies"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", languages),
    ("line dedup", lines),
    ("near copies", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing", mix),
]

# A trained model decides the first stage; SQL cannot express it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
