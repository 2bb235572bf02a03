"""A corpus from raw documents to token counts, in five stages.

Each stage takes (spark, docs, sf_dir); ``run`` writes what it returns and gives the written table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paddock.llm import bpe, minhash, mixing, quality, suffix
from paddock.llm.queries import pattern, vocabulary_file
from paddock.llm.texts import stage, table
from paddock.session import tune


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list rejects; rows without doc_id are judged alike."""
    tune(spark)
    rules = quality.learn_from(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (runs of five words, similarity 0.8): that of the smallest doc_id."""
    return minhash.keep_first(docs, n=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 200 bytes that occur more than once."""
    return suffix.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix wants them, in shuffled order; copies are equal rows."""
    return mixing.mix(docs, most_copies=None).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length and checksums of every document's tokens."""
    return bpe.encode_documents(docs, vocabulary_file("byte_bpe_50k.tiktoken"), pattern())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Learned rules and the BPE encoding have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
