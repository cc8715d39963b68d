"""Registered queries of the operators and, where SQL can express one, the SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm import centroid_clustering, decontaminate, hard_negatives, jaccard_join, language_id, line_dedup, mixing, phrase_automata, quality_classifier, quality_rules, suffix_dedup, token_output, url_filter
from ebbflow.session import shared_dir


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokens_there_and_back(docs: DataFrame, keep: int = token_output.KEEP) -> DataFrame:
    """Write the token ids of ``docs`` to the shared folder; per document what is read back from there."""
    spark = docs.sparkSession
    path = token_output.write_tokens(docs, f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}", default_tokenizer(), keep=keep)
    return token_output.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def token_output_query(spark: SparkSession, folder: str) -> DataFrame:
    return tokens_there_and_back(spark.read.parquet(f"{folder}/documents.parquet"))


QUERIES = {
    "op1_benchmark_decontamination": decontaminate.registered,
    "op2_quality_rules": quality_rules.registered,
    "op3_suffix_dedup": suffix_dedup.registered,
    "op4_quality_classifier": quality_classifier.registered,
    "op5_url_filter": url_filter.registered,
    "op6_line_dedup": line_dedup.registered,
    "op6_passage_dedup": line_dedup.passages,
    "op7_mixing": mixing.registered,
    "op8_language_id": language_id.registered,
    "op9_token_output": token_output_query,
    "op10_ngram_jaccard_join": jaccard_join.registered,
    "op11_substring_dedup": phrase_automata.registered,
    "op12_centroid_clustering": centroid_clustering.registered,
    "op13_hard_negatives": hard_negatives.registered,
}

SQL = {
    "op1_benchmark_decontamination": decontaminate.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op6_passage_dedup": line_dedup.PASSAGES_SQL,
    "op7_mixing": mixing.SQL,
    "op10_ngram_jaccard_join": jaccard_join.SQL,
    "op11_substring_dedup": phrase_automata.SQL,
    "op12_centroid_clustering": centroid_clustering.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
