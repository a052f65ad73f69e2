"""From documents to packed token sequences, in five stages that each write Parquet and read it again.

language: documents whose language is not found, or only by a narrow margin, go. exact: one row of each group of equal texts stays. near: one
document of each SimHash component stays. secrets: secrets are masked. packing: what is left becomes sequences of at most 4096 ids.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import exact, language, packing, secrets, simhash
from tagloom.llm.common import documents, stash

ORACLE_SQL = None  # SimHash, zstandard and a tokenizer can't be expressed; the tests compare with brute force


def find_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.first_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_rows(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset)"""
    return packing.pack(packing.tokenized(docs, public_tokenizers.path("word_bpe_49k.json")), place="place")


STAGES = [("language", find_language), ("exact", drop_copies), ("near", drop_near_copies), ("secrets", mask_secrets), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs
