"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source; each source gets a target in words, its repetition rate is target / words, and every document
is emitted floor(rate) times plus once more with a probability equal to the rate's fraction, drawn from a seeded hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACE, checkpointed, in_order, pick, small, unit_hash


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null: blanks between words once white space is squeezed, plus one. No string is made for each word."""
    plain = F.trim(F.regexp_replace(text, SPACE, " "))
    gaps = F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit("")))
    return F.when(F.coalesce(plain, F.lit("")) == "", 0).otherwise(gaps + 1).cast("bigint")


def targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target).

    Sources in code point order, null last, take the weights in turn and share `share` times all words by weight. No target
    exceeds cap * source_size; what is above is shared again by weight among the others until none is above. That is
    target = min(cap * size, level * weight). The level rises from an even share, as sources that it fills give up what is above,
    and stands when no further source is filled: a few sums over the sources, which no task holds as a whole.
    """
    df = in_order(totals, F.col("source").asc_nulls_last())
    df = df.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    df = checkpointed(df.select("source", "source_size", "weight", (F.col("source_size") * float(cap)).alias("_most")))
    words, weight = df.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first()
    goal, level, before = words * float(share), None, None
    while weight and weight != before:
        level, before = (goal - (full if before else 0.0)) / weight, weight
        free = F.col("_most") > F.lit(level) * F.col("weight")
        full, weight = df.agg(F.coalesce(F.sum(F.when(~free, F.col("_most"))), F.lit(0.0)), F.sum(F.when(free, F.col("weight")))).first()
    target = F.col("_most") if not weight else F.least("_most", F.lit(level) * F.col("weight"))
    return df.withColumn("target", target).select("source", "source_size", "weight", "target")


def draw(tries: int, seed: int) -> list[Column]:
    """The candidate draws of a document, one uniform number each."""
    return [unit_hash(F.lit(seed + k), "doc_id") for k in range(tries)]


def rates(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float, seed: int, tries: int) -> tuple[DataFrame, bool]:
    """(_source, source_size, target, rate, draw), one row a source, and whether it may be broadcast.

    Of `tries` seeds each source takes the one whose words come nearest to its target, the first of equals: few or very
    unequal documents leave a single draw far from it.
    """
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap).withColumnRenamed("source", "_source")
    goal = checkpointed(goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))))
    few = small(goal)
    joined = sized.join(F.broadcast(goal) if few else goal, sized.source.eqNullSafe(goal._source))
    fraction = F.col("rate") - F.floor("rate")
    sums = joined.groupBy("_source").agg(*[F.sum(F.when(u < fraction, F.col("size")).otherwise(0)).alias(f"_{k}") for k, u in enumerate(draw(tries, seed))])
    chosen = goal.join(sums.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")))
    off = [F.struct(F.abs(F.floor("rate") * F.col("source_size") + F.col(f"_{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(tries)]
    best = F.least(*off) if tries > 1 else off[0]
    return checkpointed(chosen.select("_source", "source_size", "target", "rate", best.k.alias("draw"))), few


def mix(docs: DataFrame, *keep: str, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17, tries: int = 16) -> DataFrame:
    """One row a document: the keep columns of documents, then source_size, target, copies, and size if keep names it.

    Null text has size 0. Null sources form one source, the last. Rows of one doc_id draw alike, so repeated rows are taken
    alike; rows without an id share one draw. A source without words gets target 0 and no copies. An empty table gives no rows.
    """
    own = pick(docs, "doc_id", "source", "text")
    sized = checkpointed(own.select("doc_id", "source", word_count(own.text).alias("size")))
    goal, few = rates(sized, weights, share, cap, seed, tries)
    rows = sized if set(keep) <= set(sized.columns) else pick(docs, *dict.fromkeys([*keep, "doc_id", "source"]))
    joined = rows.join(F.broadcast(goal) if few else goal, rows.source.eqNullSafe(goal._source))
    u = unit_hash(F.col("draw") + seed, "doc_id")
    copies = F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("bigint")
    return joined.select(*keep, "source_size", "target", copies.cast("bigint").alias("copies"))


def emit(docs: DataFrame, **settings) -> DataFrame:
    """The mixture itself: rows of documents, each repeated as often as it was drawn."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    mixed = mix(docs, *columns, **settings)
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("_copy")).drop("_copy")
