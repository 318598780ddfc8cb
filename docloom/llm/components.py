"""Connected components with DataFrame functions only, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed


def _stars(links: DataFrame, hub: str, leaf: str) -> DataFrame:
    """Every leaf of a hub linked to the smallest of the hub and its leaves. The minimum is pre-aggregated, hot hubs are split by AQE."""
    least = links.groupBy(F.col(hub).alias("_h")).agg(F.min(leaf).alias("_m"))
    return links.join(least, links[hub] == least["_h"]).withColumn("_m", F.least("_h", "_m"))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every id of a link to another id, root the smallest id reachable. Links may repeat or join an id to itself; null ends count for nothing.

    Each round halves the distance to the root or better; rounds end when the links no longer change. Only a count and two
    hashes of the links come to the driver.
    """
    # a is the larger end throughout
    now = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = checkpointed(now)
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(both, "a", "b").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        small = _stars(large, "a", "b")
        own = small.where(F.col("b") != F.col("_m")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        now = checkpointed(small.select("a", F.col("_m").alias("b")).union(own).distinct())
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
