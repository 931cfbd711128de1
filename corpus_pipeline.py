"""A corpus from raw documents to packed sequences, each stage one operator of tidemark.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, exact_dedup, ngram_join, packing, quality, secrets


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, with all their columns.

    Null and empty texts are scored like others; repeated rows go or stay together; without usable labels all stay; an empty table stays empty.
    """
    return quality.keep_good(docs, common.read_table(spark, sf_dir, "labels"))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id, with all its columns.

    Null counts as empty, so of null and empty texts one stays; rows without an id stay only where no row of their text has one; of rows
    repeated with one id and text one stays; an empty table stays empty.
    """
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies, with all its columns.

    Null and empty texts and rows without an id all stay; repeated rows of the id that stays all stay; an empty table stays empty.
    """
    return ngram_join.drop_near_copies(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars counted anew (null for null texts). Repeated rows are masked alike; an empty table stays empty."""
    masked = secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))
    return masked.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens. Null and empty texts are one end token; repeated rows are packed each; an empty table gives no pieces."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", no_copies),
    ("near_dedup", no_near_copies),
    ("secrets", no_secrets),
    ("packing", packed),
]

#: The classifiers and the tokenizer are not SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again for the next."""
    docs, last = common.read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = last = common.stored(stage(spark, docs, sf_dir), f"stage-{name}", replaces=last)
    return STAGES[-1][1](spark, docs, sf_dir)
