"""Intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """df computed once, kept by a reliable checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


#: Spark's own setting: what a query shuffled is deleted once it has run.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffled rows on disk, which else stay until the driver collects its garbage. For tables that are stored, and so need them no more."""
    was = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if was is None else spark.conf.set(RELEASE, was)


def packed(df: DataFrame) -> tuple[DataFrame, str]:
    """df computed once, packed by zstd in a new folder of the shared one, and that folder; removed() deletes it once nothing reads it any more."""
    folder = f"{shared(df.sparkSession)}/tables-{uuid.uuid4().hex}"
    with released(df.sparkSession):
        df.write.parquet(folder, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def removed(spark: SparkSession, *folders: str) -> None:
    """Deletes folders that packed() gave, through the file system that holds them."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Unset, a folder of our own serves a local session; on a cluster, whose executors would not see it, that is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        told = sc.getConf().get("spark.checkpoint.dir")
        if not told and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def width(spark: SparkSession) -> int:
    """Tasks for work that is dear where rows are few: enough to keep all cores busy, no more than a shuffle has partitions. Each would write a piece for every partition
    of the next shuffle, so hundreds of them cost more than small tables do."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(32, 3 * spark.sparkContext.defaultParallelism))


def broadcast_if_small(df: DataFrame, row_bytes: int = 128, most: int = 64 << 20) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if its counted rows take `most` bytes at most."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df
