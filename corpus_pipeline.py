"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes nulls in any column, empty and very long texts, repeated rows and ids, empty tables (which give empty
ones) and columns of any name; its docstring says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import mixing, near_copies, pieces, quality_rules, substring
from corvane.llm.common import materialise, release


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list rejects go, and those under 50 words with them: null and empty texts. Repeated rows go or stay together."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, the one with the smallest id; null ids come last.

    Null and empty texts are one group, equal rows leave one.
    """
    return near_copies.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that started earlier go from the texts; every row stays, null texts become empty, rows of one id are judged one after another."""
    return substring.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture reads them (once at least), block after block; a null source is a source, texts without words cost nothing."""
    return mixing.realise(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document read; null and empty texts have no ids."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", mix_sources),
    ("sentencepiece", tokenise),
]

#: The learned rules, hashes and tokens can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what the last one returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark)
    return docs
