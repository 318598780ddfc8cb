"""Training-data pipeline over documents: quality rules, line dedup, near-dedup, mixing, encoding.

Every stage works on all rows its predecessor kept, written as Parquet in the cluster's shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, linedup, mixing, nearset, quality
from docloom.llm.common import documents, removed, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linedup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearset.keep(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, keep=("doc_id", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Minwise sketches, 64-bit line hashes and byte-pair merges are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, read from the shared folder. A stage's table is deleted once the next one is written."""
    docs, folder = documents(spark, sf_dir), scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return docs
