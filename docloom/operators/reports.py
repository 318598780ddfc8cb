"""Aggregations, set comparisons and edits over elements, codes and modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import codes


def only_in(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys of a that b lacks."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti")


def in_both(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """U1."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_semi")


def toggle(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on exactly one side."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full").where(F.col("_a").isNull() | F.col("_b").isNull()).select(key)


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Value of the last row of a key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def validate(output: DataFrame, reference: DataFrame) -> DataFrame:
    """Coded names of two trees (name), all levels: one row with counts and the share of reference codes found."""
    a = output.select(codes.folder_dmc("name").alias("dmc")).where("dmc IS NOT NULL").distinct().withColumn("_o", F.lit(1))
    b = reference.select(codes.folder_dmc("name").alias("dmc")).where("dmc IS NOT NULL").distinct().withColumn("_r", F.lit(1))
    both = F.col("_o").isNotNull() & F.col("_r").isNotNull()
    out = a.join(b, "dmc", "full").agg(F.count_if(both).alias("matched"), F.count_if(F.col("_o").isNull()).alias("only_reference"), F.count_if(F.col("_r").isNull()).alias("only_output"), F.count("_r").alias("total_reference"))
    return out.withColumn("percent", F.bround(F.try_divide(F.col("matched") * 100.0, F.col("total_reference")), 6))


def issues(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Unmatched elements of both sides, type mismatches and similarities under 0.95; those of one index merge, texts joined, the first category first."""
    m = matches
    gone = left.select("doc_id", "idx").join(m.select("doc_id", F.col("l").alias("idx")), ["doc_id", "idx"], "left_anti").select("doc_id", "idx", F.lit(0).alias("c"), F.lit("left").alias("side"), F.lit("unmatched").alias("category"))
    extra = right.select("doc_id", "idx").join(m.select("doc_id", F.col("r").alias("idx")), ["doc_id", "idx"], "left_anti").select("doc_id", "idx", F.lit(1), F.lit("right"), F.lit("unmatched"))
    kinds = m.where("type_l <> type_r").select("doc_id", F.col("l"), F.lit(2), F.lit("left"), F.lit("type"))
    texts = m.where("sim < 0.95").select("doc_id", F.col("l"), F.lit(3), F.lit("left"), F.lit("text"))
    rows = gone.union(extra).union(kinds).union(texts)
    told = F.array_sort(F.collect_list(F.struct("c", "side", "category")))
    df = rows.groupBy("doc_id", "idx").agg(told.alias("_t"))
    return df.select("doc_id", "idx", F.col("_t")[0].side.alias("side"), F.array_join(F.transform("_t", lambda x: x.category), "; ").alias("category"))


def badge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per document, whether type sequences agree once warnings and cautions are left out, and both counts."""

    def kinds(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(~F.col("type").isin("warning", "caution"))
        return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "type"))), lambda x: x.type).alias(name))

    df = kinds(left, "_l").join(kinds(right, "_r"), "doc_id", "full")
    return df.select("doc_id", F.coalesce(F.size("_l"), F.lit(0)).cast("bigint").alias("n_l"), F.coalesce(F.size("_r"), F.lit(0)).cast("bigint").alias("n_r"), F.coalesce(F.col("_l") == F.col("_r"), F.lit(False)).alias("same"))


def contents(refs: DataFrame) -> DataFrame:
    """The table of contents in three levels: (system_code, sub_key, kind, entry, dmcs): direct references (assembly 00) and components in first-seen order.

    A subsystem is named by its first direct reference, else by its tag.
    """
    rows = refs.withColumn("kind", F.when(F.col("assy") == "00", "direct").otherwise("component"))
    rows = rows.withColumn("entry", F.when(F.col("kind") == "direct", "").otherwise(F.col("assy")))
    subs = refs.groupBy("system_code", "sub_key").agg(F.min_by("tech_name", F.when(F.col("assy") == "00", F.col("pos"))).alias("_n"), F.min_by("tag", F.when(F.col("tag").isNotNull(), F.col("pos"))).alias("_t"), F.max((F.col("assy") == "00").cast("int")).alias("_d"))
    out = rows.groupBy("system_code", "sub_key", "kind", "entry").agg(F.min("pos").alias("first_pos"), F.array_sort(F.collect_set(F.struct("pos", "dmc"))).alias("_d2"))
    out = out.join(subs, ["system_code", "sub_key"])
    return out.select("system_code", "sub_key", F.when(F.col("_d") == 1, F.col("_n")).otherwise(F.col("_t")).alias("name"), "kind", "entry", "first_pos", F.transform("_d2", lambda x: x.dmc).alias("dmcs"))


# -- E: edits of reference markup ----------------------------------------------------------------------------------------------


def in_order(doc: str = "doc_id") -> Window:
    return Window.partitionBy(doc).orderBy("idx")


def merge_rows(df: DataFrame, head: Column) -> DataFrame:
    """Rows that are no heads merge into the row above: spans add up, the last end text stays."""
    df = df.withColumn("_g", F.sum((head | (F.row_number().over(in_order()) == 1)).cast("int")).over(in_order()))
    span = F.coalesce(F.nullif(F.col("span"), F.lit(0)), F.lit(1))
    return df.groupBy("doc_id", "_g").agg(F.min("idx").alias("idx"), F.min_by("type", "idx").alias("type"), F.min_by("text_start", "idx").alias("text_start"), F.max_by("text_end", "idx").alias("text_end"), F.sum(span).alias("span")).drop("_g")


def split_rows(df: DataFrame) -> DataFrame:
    """A row of span n becomes n rows of span 1; part counts them from 1. A span of 0 counts as 1."""
    span = F.coalesce(F.nullif(F.col("span"), F.lit(0)), F.lit(1)).cast("int")
    return df.select("doc_id", "idx", "type", F.explode(F.sequence(F.lit(1), span)).alias("part")).withColumns({"part": F.col("part").cast("bigint"), "span": F.lit(1).cast("bigint")})


def insert_row(df: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each block number (doc_id, block) the idx before which a row is inserted: the first whose running span passes the block; null: at the end."""
    span = F.coalesce(F.nullif(F.col("span"), F.lit(0)), F.lit(1))
    run = df.withColumn("_end", F.sum(span).over(in_order())).select("doc_id", "idx", (F.col("_end") - span).alias("_start"), "_end")
    return blocks.join(run, "doc_id", "left").groupBy("doc_id", "block").agg(F.min(F.when(F.col("_end") > F.col("block"), F.col("idx"))).alias("before_idx"))
