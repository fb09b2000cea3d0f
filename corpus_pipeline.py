"""From raw documents to packed token windows, in five stages.

A stage gets the documents that the one before it kept, written and read again.
All but the last return the columns of documents. Each stage judges its own
input: thresholds, language prototypes and duplicate groups follow from it.
Nulls, empty texts, ties and repeated rows are treated as the operators say; an
empty table passes through all stages. Rows with a null id are never removed as
duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featlake.llm import decontaminate, language_id, near_dedup, packing, quality
from featlake.llm.tables import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or lie beyond an adaptive fence of their language and source go."""
    return quality.keep_good(docs)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or that resemble no learned language, go."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return near_dedup.keep_one(docs)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of what is left."""
    return packing.digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_items),
    ("packing", pack_windows),
]

#: Sketches, hyperdimensional profiles and tokenisation have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each result written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
