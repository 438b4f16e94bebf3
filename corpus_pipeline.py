"""A training-corpus pipeline: five stages, each one an operator of loomspan.llm applied to what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.

Defined cases of every stage: a null text counts as empty; texts may have any length; extra columns, whatever their names, come
through unchanged (all stages but the last); an empty table gives an empty one. Empty texts fail the quality rules, so they don't
reach the later stages of run(); given to a later stage alone, one empty text stays through exact dedup, all of them through near
duplicates, none through the mix, and packing gives each its end id. Rows without an id are documents like any others: one of each
group stays. Rows repeated in full are copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import exact_dedup, mixing, ngram_join, packing, quality
from loomspan.llm.common import stored, table
from loomspan.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the smallest id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with Jaccard 0.75 or more."""
    return ngram_join.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; sources come near their target words."""
    return mixing.mixed_rows(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the pieces of all documents and where each lies."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near duplicates", near_copies),
    ("source mix", source_mix),
    ("packing", sequences),
]

#: The first and last stages can't be expressed in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
