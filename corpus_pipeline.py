"""Corpus pipeline over the documents table, as stages that each apply one operator.

quality classifier -> exact dedup -> near-dedup -> benchmark decontamination -> BPE. Every
stage works on all rows that the one before has kept and returns the columns of ``documents``; the last
returns the token ids. Rows pass whole, repeated rows are told apart by their position, and an empty
table runs through. Null texts count as empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from peakloom.llm import bpe, decontamination, exact_dedup, near_dedup, quality
from peakloom.llm.common import stored, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts at a 5-word shingle similarity of 0.8 or more the row with the smallest id stays.

    Links come from vantage-point trees over SimHash fingerprints and an exact check, those that trees leave out from prefixes.
    """
    return near_dedup.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of every document."""
    return bpe.encode_documents(docs, VOCABULARY, ["n_tokens", "ids", "ids_sha256", "decoded_sha256"])


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", first_copies),
    ("near-dedup", near_copies),
    ("decontamination", clean_of_benchmark),
    ("bpe", token_ids),
]
#: A trained model, XXH64 and a tokenizer are not SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
