"""Figures that run over several sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import like

FIGURE = r"(?iuUs)рисунок\s*(\d+)\s*[–-]\s*(.+?)(?:\s*\(|\s+лист\s+\d+|\s*$)"


def multi_sheet_figures(elements: DataFrame) -> DataFrame:
    """elements (doc_id, seq, content) that name a figure with more than one sheet, the first per figure number.

    Gives figure_number, title, sheet_count, sheets. Null content names no figure.
    """
    sheets = F.regexp_extract_all("content", F.lit(r"(?iuU)лист\s*(\d+)"), F.lit(1)).cast("array<bigint>")
    df = elements.where(like("content", FIGURE)).select(
        "doc_id", "seq", F.regexp_extract("content", FIGURE, 1).cast("bigint").alias("figure_number"), F.trim(F.regexp_extract("content", FIGURE, 2)).alias("title"), sheets.alias("sheets"), "content"
    )
    df = df.where(F.size("sheets") > 1).withColumn("sheet_count", F.size("sheets").cast("bigint"))
    first = F.row_number().over(Window.partitionBy("doc_id", "figure_number").orderBy("seq"))
    return df.withColumn("_n", first).where("_n = 1").drop("_n")


def group_sheets(elements: DataFrame) -> DataFrame:
    """Runs of adjacent illustrations (doc_id, seq, type, content) with one figure number become one row.

    Gives first seq, figure_number, sheets (elements of the run), graphic_start (illustrations of the document before the run) and contents in order.
    """
    w = Window.partitionBy("doc_id").orderBy("seq")
    number = F.when((F.col("type") == "illustration") & like("content", r"(?U)[Рр]исунок\s*\d+"), F.regexp_extract("content", r"(?U)[Рр]исунок\s*(\d+)", 1).cast("bigint"))
    df = elements.withColumn("figure_number", number)
    df = df.withColumn("_new", (~F.col("figure_number").eqNullSafe(F.lag("figure_number").over(w)) | F.col("figure_number").isNull()).cast("bigint"))
    before = F.coalesce(F.sum((F.col("type") == "illustration").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumns({"_run": F.sum("_new").over(w), "_before": before})
    out = df.groupBy("doc_id", "_run").agg(
        F.min("seq").alias("seq"), F.min_by("type", "seq").alias("type"), F.min_by("figure_number", "seq").alias("figure_number"), F.count("*").alias("sheets"), F.min("_before").alias("graphic_start"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x.content).alias("contents"),
    )
    return out.drop("_run")
