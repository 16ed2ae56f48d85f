"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import (
    chat,
    collocations,
    embedding_dedup,
    exact_dedup,
    minhash,
    mixing,
    packing,
    pii,
    secrets,
    substrings,
    toxicity,
    url_filter,
    whitening,
)
from parley.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.listed_urls(pages)).select(
        "page_id", "host", "path", "rule", "verdict"
    )


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_texts(read_table(spark, sf_dir, "conversations"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.col("found")).alias("spans"),
        "n_random",
    )


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.mixing_rates(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    )
    return rates.select(
        "doc_id",
        "tokens",
        F.col("posterior")["0"].alias("p_low"),
        F.col("posterior")["1"].alias("p_high"),
        "rate",
        "copies",
    )


@query
def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(
        read_table(spark, sf_dir, "documents"), shingle_words=3, percent=85
    )


@query
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    )


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.col("found")).alias("spans"),
    )


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


@query
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.drop_repeats(read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "n_removed", substrings.kept_digest(F.col("kept_text")).alias("kept_sha256")
    )
