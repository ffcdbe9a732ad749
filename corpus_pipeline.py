"""A corpus from raw documents to packed sequences; every stage reads the table the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkveil.llm import compression_rules, packing, pii, simhash, soft_mixing
from inkveil.llm.common import prepare, read_table, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word counts and the compression bands."""
    prepare(spark)
    return compression_rules.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    prepare(spark)
    return simhash.keep_one_of_each(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    prepare(spark)
    return pii.redact_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates for the target weights say."""
    prepare(spark)
    return soft_mixing.mix(docs, soft_mixing.domains_of(read_table(spark, sf_dir, "labels")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and place."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii", pii_redaction),
    ("mixing", mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Compression, fingerprints, checksums and token ids are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
