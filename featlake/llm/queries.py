"""The numbered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, divergence, language_id, license_scan, near_dedup, packing, quality, sharding, suffix_dedup, token_codec, url_filter, whitening


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the adaptive verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    df = quality.judged(docs, ["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return df.select(F.col("rec.doc_id").alias("doc_id"), *counts, "base_failed", "kept", "n_lines", *quality.RATIOS, *quality.FENCES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": url_filter.query,
        "op2_token_codec": token_codec.query,
        "op3_near_dedup": near_dedup.query,
        "op4_license_scan": license_scan.query,
        "op5_chat_format": chat_format.query,
        "op6_language_id": language_id.query,
        "op7_sharding": sharding.query,
        "op8_decontaminate": decontaminate.query,
        "op9_packing": packing.query,
        "op10_quality_rules": op10_quality_rules,
        "op11_suffix_dedup": suffix_dedup.query,
        "op12_source_divergence": divergence.query,
        "op13_whitening": whitening.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.ORACLE_SQL,
        "op3_near_dedup": near_dedup.ORACLE_SQL,
        "op4_license_scan": license_scan.ORACLE_SQL,
        "op5_chat_format": chat_format.ORACLE_SQL,
        "op8_decontaminate": decontaminate.ORACLE_SQL,
        "op11_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op12_source_divergence": divergence.ORACLE_SQL,
    }
