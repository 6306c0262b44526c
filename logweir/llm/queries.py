"""The queries of the subpackage and the SQL they are checked against."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweir.llm import conversations, decontaminate, divergence, embedding_dups, language_id, line_dedup, mixing, ngram_join
from logweir.llm import personal_data, secret_scan, substring_dedup, token_files, toxicity
from logweir.llm.scratch import small_arrow_batches


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                                       spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("text_key")


def _toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_arrow_batches(spark)
    return toxicity.toxic_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _over(table: str, query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(small_arrow_batches(spark).read.parquet(f"{sf_dir}/{table}.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_crf_language": _over("documents", language_id.predicted_languages),
    "op2_secret_scan": _over("documents", secret_scan.found_secrets),
    "op3_pareto_mix": _over("documents", mixing.mixed_words),
    "op4_token_counts": _over("documents", token_files.token_counts),
    "op5_ngram_join": _over("documents", ngram_join.joined_documents),
    "op6_line_dedup": _over("documents", line_dedup.kept_lines),
    "op7_personal_data": _over("documents", personal_data.found_personal_data),
    "op8_benchmark_leaks": _leaks,
    "op9_embedding_dups": _over("embeddings", embedding_dups.near_vectors),
    "op10_substring_dedup": _over("documents", substring_dedup.kept_words),
    "op11_source_divergence": _over("documents", divergence.source_divergence),
    "op12_conversation_repair": _over("conversations", conversations.repaired_conversations),
    "op13_toxicity": _toxic,
}

CHECKS: dict[str, str] = {
    "op3_pareto_mix": mixing.MIXED_WORDS_SQL,
    "op5_ngram_join": ngram_join.JOINED_DOCUMENTS_SQL,
    "op9_embedding_dups": embedding_dups.NEAR_VECTORS_SQL,
    "op10_substring_dedup": substring_dedup.KEPT_WORDS_SQL,
    "op11_source_divergence": divergence.SOURCE_DIVERGENCE_SQL,
    "op12_conversation_repair": conversations.REPAIRED_CONVERSATIONS_SQL,
}
