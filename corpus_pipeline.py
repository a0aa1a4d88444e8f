"""A corpus pipeline: quality classifier, exact dedup, near dedup, packing. Each stage takes the documents its predecessor
kept; all but the last return the columns of documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantrail.llm import exactdup, neardup, packing, quality
from vantrail.llm.common import checkpoint_dir, read_table

TOKENIZER = "word_bpe_49k.json"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior probability of good quality is at least one half; columns of any name are carried."""
    return quality.kept_rows(docs, read_table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exactdup.exact_dedup_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.kept_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents in their sequences."""
    placed = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), keep_ids=False)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("best-fit packing", packed),
]

#: A trained classifier, a tokenizer and packing are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
