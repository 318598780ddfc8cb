"""The registered queries of this subpackage; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import avi, bpe, fixity, importance, langid, linedup, mixing, nearset, negatives, oracles, order, pii, quality, secrets
from docloom.llm.common import checkpointed, documents, scratch


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), "doc_id", "size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.decide(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op5_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas are stored, the second with known damage; both are read back from their bytes and audited."""
    pages, folder = spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch(spark)
    # Two whole stores lie on disk beside the shuffles, so they are packed more densely than by default.
    fixity.files(pages).write.parquet(f"{folder}/a", compression="zstd")
    first = spark.read.parquet(f"{folder}/a")
    fixity.damaged(first).write.parquet(f"{folder}/b", compression="zstd")
    return fixity.report(checkpointed(fixity.manifest(pages)), first, spark.read.parquet(f"{folder}/b"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.scan(docs, secrets.fit(docs)).drop("found")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.features(documents(spark, sf_dir))


def op8_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.index(order.materialise(documents(spark, sf_dir), scratch(spark)))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), ids=False)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearset.duplicates(documents(spark, sf_dir), k=2)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir)).drop("found")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_language": op2_language,
    "op3_lines": op3_lines,
    "op4_quality": op4_quality,
    "op5_fixity": op5_fixity,
    "op6_secrets": op6_secrets,
    "op7_media": op7_media,
    "op8_order": op8_order,
    "op9_bpe": op9_bpe,
    "op10_minhash": op10_minhash,
    "op11_pii": op11_pii,
    "op12_importance": op12_importance,
    "op13_negatives": op13_negatives,
}

ORACLES: dict[str, str] = {"op1_mixing": oracles.MIXING, "op4_quality": oracles.QUALITY, "op5_fixity": oracles.FIXITY, "op10_minhash": oracles.NEAR, "op12_importance": oracles.IMPORTANCE, "op13_negatives": oracles.NEGATIVES}
