"""The training-data queries: one thin ``opN_<name>`` for each operator, and the pipeline.

Each applies its operator with production parameters to the whole table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import archives, decontamination, filter_audit, language_id, lm_score, mixing, near_dup, packing, pii, top_k, toxicity, vector_dup, whitening
from .common import table


def tokenizer_path() -> str:
    """Place of the public vocabulary file; TOKENIZER_FILE overrides it."""
    if given := os.environ.get("TOKENIZER_FILE"):
        return given
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.search(table(spark, sf_dir, "documents"))


def op2_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dup.near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_arc_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.convert(table(spark, sf_dir, "pages")).drop("target_uri")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    found = (
        op1_skip_chain_pii, op2_stupid_backoff, op3_best_fit_packing, op4_minhash_near_dedup, op5_top_k, op6_toxicity,
        op7_vector_near_dedup, op8_language_id, op9_mixing, op10_arc_converter, op11_filter_audit, op12_decontamination, op13_whitening,
    )
    import corpus_pipeline

    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_stupid_backoff": lm_score.ORACLE_SQL, "op4_minhash_near_dedup": near_dup.ORACLE_SQL, "op5_top_k": top_k.ORACLE_SQL,
        "op7_vector_near_dedup": vector_dup.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL, "op10_arc_converter": archives.ORACLE_SQL,
        "op11_filter_audit": filter_audit.ORACLE_SQL, "op12_decontamination": decontamination.ORACLE_SQL,
    }
