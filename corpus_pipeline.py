"""From raw documents to packed training sequences: four stages, each written and read again as the next one's input.

Every stage but the last returns the columns of its input, whatever they are, for the rows it keeps. A table without
rows passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import packing, quality_gam, quality_rules, simhash
from plumbline.llm.common import read, shared_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is trained on the labelled rows of `docs`."""
    return quality_gam.keep(docs, read(spark, sf_dir, "labels"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or read unlike the trusted ones go."""
    return quality_rules.keep(docs, quality_rules.trusted_ids(read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return simhash.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_filter),
    ("simhash_dedup", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]
# A trained model and a tokenizer have no SQL; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
