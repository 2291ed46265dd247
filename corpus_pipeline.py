"""The corpus pipeline: quality rules, near-dedup, decontamination, secret masking, tokens.

Each stage is (name, function); a function takes (spark, docs, folder) and returns a table
that is written and read again as the next stage's documents. All but the last return the
columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.llm import bpe, decontaminate, neardup, quality_rules, secrets
from passagework.llm.common import save
from passagework.llm.queries import multilingual
from passagework.sources.tables import read_parquet


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the base rule and the learned rules keep."""
    return quality_rules.keep_good(docs, read_parquet(spark, folder, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.keep_first(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontaminate.decontaminate(docs, read_parquet(spark, folder, "benchmark"))


def mask(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.mask_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token counts and digests of every document and of what its tokens decode to."""
    return bpe.digest(docs, *multilingual())


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", clean_of_benchmarks),
    ("secret scans", mask),
    ("byte-level BPE", tokens),
]

# The learned rules of the first stage and the tokens of the last can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents, each written before the next reads it."""
    docs = read_parquet(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, folder), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, folder)
