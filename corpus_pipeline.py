"""A corpus pipeline: each stage reads what the stage before it kept, as written Parquet.

Null texts are empty texts, and an empty text is judged by the classifier like any other; null sources are a source of their own.  Rows that
repeat a text are one after the second stage, whatever their ids, and null ids come before all others.  Columns beside those of
documents pass all stages but the last.  An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import exact_dedup, mixing, packing, quality, simhash
from panelforge.llm.text import table
from panelforge.session import checkpoint_dir

#: SQL cannot express the classifier and the tokenizer.
ORACLE_SQL = None


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels beside the documents."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def one_variant(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, each with its place in a sequence of at most 4096 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", good_only),
    ("exact_dedup", one_copy),
    ("simhash_near_dedup", one_variant),
    ("source_mix", mixed),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
