"""From raw documents to packed sequences: toxicity, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
its result is written as Parquet and read again as the next one's documents.

All stages take nulls in any column, empty and very long texts, repeated rows, empty
tables and columns of any names: a stage that filters returns the columns it was
given, a row is judged by its text alone, and what null and empty texts come to is
said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kantele.llm import packing, quality, simhash, toxicity
from kantele.llm.common import written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject; null and empty texts stay."""
    return toxicity.keep_civil(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; texts of fewer than 50 words, null ones too, go."""
    return quality.keep_good(docs, quality.fit(docs, _labels(spark, sf_dir)))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the least id.

    Rows without an id stay only where their group has no other; texts that share an
    id are told apart; null and empty texts are one group.
    """
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids; a null or empty text is its end id."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", civil), ("quality rules", good), ("SimHash near-dedup", unique), ("packing", packed)]

#: Learned scores, connected components and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
