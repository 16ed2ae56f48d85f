"""A corpus pipeline of five operators: filter, deduplicate twice, mix, pack.

Each stage reads all that the one before it kept; `run` writes the rows of a stage to Parquet in the
shared folder and reads them again for the next. Stages but the last give the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.llm import exact_dedup, minhash, mixing, packing, toxicity
from parley.llm.common import read_table, stash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those that are equal apart from white space."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words and a similarity of 0.8."""
    return minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents so often that the expected tokens of the domains meet the target weights."""
    return mixing.mix(docs, read_table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_duplicates),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Learnt models, signatures and tokenizers cannot be expressed in SQL; the tests hold each stage against
#: a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = stash(stage(spark, rows, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, rows, sf_dir)
