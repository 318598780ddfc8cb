"""Operators over positioned blocks of pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import predicates as P
from docloom.functions.text import like
from docloom.operators.folds import ordered_fold


def zones(blocks: DataFrame, height: float) -> DataFrame:
    """A4: (doc_id, top_cutoff, bottom_cutoff) in percent of the page height.

    A zone counts if at least max(2, int(0.6 * pages)) pages have a block in the outer tenth. One aggregation by document.
    """
    top, bottom = F.col("y0") < height * 0.10, F.col("y1") > height * 0.90
    df = blocks.groupBy("doc_id").agg(
        F.count_distinct("page_num").alias("_p"), F.count_distinct(F.when(top, F.col("page_num"))).alias("_t"), F.count_distinct(F.when(bottom, F.col("page_num"))).alias("_b"),
        F.max(F.when(top, F.col("y1") / height * 100)).alias("_y1"), F.min(F.when(bottom, F.col("y0") / height * 100)).alias("_y0"),
    )
    least = F.greatest(F.lit(2), F.floor(F.col("_p") * 0.6))
    several = F.col("_p") >= 2
    return df.select(
        "doc_id", F.when(several & (F.col("_t") >= least), F.greatest(F.col("_y1"), F.lit(0.0)) + 0.5).otherwise(F.lit(0.0)).alias("top_cutoff"),
        F.when(several & (F.col("_b") >= least), F.least(F.col("_y0"), F.lit(100.0)) - 0.5).otherwise(F.lit(100.0)).alias("bottom_cutoff"),
    )


def drop_zones(blocks: DataFrame, cutoffs: DataFrame, height: float) -> DataFrame:
    """Without blocks that end in the top zone, or begin in the bottom zone with a text of 50 characters at most."""
    df = blocks.join(cutoffs, "doc_id")
    top, bottom = F.col("y1") / height * 100 <= F.col("top_cutoff"), F.col("y0") / height * 100 >= F.col("bottom_cutoff")
    return df.where(~top & (~bottom | (F.length("text") > 50))).drop("top_cutoff", "bottom_cutoff")


def in_page_order() -> Window:
    return Window.partitionBy("doc_id", "page_num").orderBy("y0", "blk_seq")


def gap_features(blocks: DataFrame) -> DataFrame:
    """Gap above a block and its horizontal shift, in page order."""
    w = in_page_order()
    return blocks.withColumns({"gap": F.col("y0") - F.lag("y1").over(w), "shift": F.col("x0") - F.lag("x0").over(w)})


def collapse_tables(blocks: DataFrame) -> DataFrame:
    """A5: runs of table blocks become one block: outer box, texts joined by ' | ', sums and maxima; other blocks pass."""
    w = in_page_order()
    start = ~F.col("in_table") | ~F.coalesce(F.lag("in_table").over(w), F.lit(False))
    df = blocks.withColumn("_run", F.sum(start.cast("int")).over(w))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "blk_seq", "text"))), lambda x: x.text), " | ")
    return df.groupBy("doc_id", "page_num", "_run").agg(
        F.min("blk_seq").alias("blk_seq"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), texts.alias("text"), F.sum("lines").alias("lines"),
        F.max("max_font_size").alias("max_font_size"), F.bool_or("is_bold").alias("is_bold"), F.bool_or("is_italic").alias("is_italic"), F.bool_or("in_table").alias("is_table"), F.bool_or("is_image").alias("is_image"),
    ).drop("_run")


def font_stats(blocks: DataFrame, *keys: str) -> DataFrame:
    """True median of same-page gaps in (0, 50) (10 without any), upper median of fonts, and the split threshold (1.6 * the least positive gap, else 1.3 * the font)."""
    df = gap_features(blocks)
    fonts = F.sort_array(F.collect_list("max_font_size"))
    out = df.groupBy(*keys).agg(
        F.coalesce(F.median(F.when((F.col("gap") > 0) & (F.col("gap") < 50), F.col("gap"))), F.lit(10.0)).alias("median_gap"),
        fonts.alias("_f"), F.min(F.when(F.col("gap") > 0, F.col("gap"))).alias("_g"),
    )
    font = F.element_at("_f", (F.floor(F.size("_f") / 2) + 1).cast("int"))
    return out.select(*keys, "median_gap", font.alias("median_font"), F.coalesce(F.col("_g") * 1.6, font * 1.3).alias("gap_threshold"))


TERMINAL = re.compile(r"[.!?;][»\"')\]]*\s*$")
START = re.compile(r"^(?:[\-–—−•●○‣▪▫⁃]|\d+[.)]\s|\d+(?:\.\d+)+\s)")
CAPTION = re.compile(r"[Рр]исунок\s*\d+")


def _splits(cur: dict, prev: dict, b: dict, limit: float, indent: float) -> bool:
    """Whether line b opens a new block after the block cur, whose last line is prev. The first of the position rules that applies decides
    among themselves; punctuation and list marks are asked only if none of them split."""
    if cur["is_table"] or b["is_table"] or cur["is_image"] or b["is_image"]:
        return True
    shift, step = b["x0"] - cur["anchor"], b["x0"] - prev["x0"]
    font = b["max_font_size"] / cur["max_font_size"] if cur["max_font_size"] > 0 else 1.0
    if b["y0"] - cur["y1"] > limit or shift < -3 or shift > indent or (abs(shift) < 3 and abs(step) > 3 and step < 0) or font > 1.25 or font < 0.8:
        return True
    if abs(shift) < 3 and TERMINAL.search(prev["text"].rstrip()):
        return True
    return bool(START.match(b["text"].strip()))


BLOCK = "doc_id bigint, page_num bigint, blk_seq bigint, x0 double, y0 double, x1 double, y1 double, text string, lines bigint, max_font_size double, is_bold boolean, is_italic boolean, is_table boolean"


def merge_page(rows: list) -> list[tuple]:
    lines = [r._asdict() for r in rows]
    fonts = sorted(b["max_font_size"] for b in lines)
    font = fonts[len(fonts) // 2]
    gaps = [g for a, b in zip(lines, lines[1:]) if (g := b["y0"] - a["y1"]) > 0]
    limit = min(gaps) * 1.6 if gaps else font * 1.3
    merged: list[dict] = []
    for prev, b in zip([None, *lines], lines):
        if prev is None or _splits(merged[-1], prev, b, limit, font * 1.1):
            merged.append(b | {"anchor": b["x0"]})
            continue
        cur = merged[-1]
        for k, f in (("y1", max), ("x1", max), ("x0", min), ("max_font_size", max), ("is_bold", max), ("is_italic", max)):
            cur[k] = f(cur[k], b[k])
        cur["lines"] += b["lines"]
        cur["text"] += " " + b["text"]
    return [tuple(b[c] for c in rows[0]._fields) for b in captioned(merged)]


def captioned(merged: list[dict]) -> list[dict]:
    """An image takes the first free caption within the next three blocks; one without text goes."""
    out, taken = [], set()
    for i, b in enumerate(merged):
        if i in taken:
            continue
        if b["is_image"]:
            near = [j for j in range(i + 1, min(i + 4, len(merged))) if j not in taken and not merged[j]["is_image"] and CAPTION.match(merged[j]["text"])]
            if near:
                c = merged[near[0]]
                taken.add(near[0])
                b = b | {"x0": min(b["x0"], c["x0"]), "x1": max(b["x1"], c["x1"]), "y1": max(b["y1"], c["y1"])} | {k: c[k] for k in ("text", "lines", "max_font_size")}
            if not b["text"]:
                continue
        out.append(b)
    return out


def merge_lines(blocks: DataFrame, tables: bool = True) -> DataFrame:
    """Lines of each page merged to paragraphs. The state of the fold (box, anchor, largest font so far) needs one pass in order, so a page
    is a group of an ordered fold; pages are small and many.
    """
    df = collapse_tables(blocks) if tables else blocks.withColumn("is_table", F.lit(False))
    columns = [c.strip().split()[0] for c in BLOCK.split(",")]
    made = ordered_fold(df.select(*columns, "is_image"), ["doc_id", "page_num"], ["y0", "blk_seq"], merge_page, BLOCK + ", is_image boolean")
    return made.drop("is_image")


def element_boxes(blocks: DataFrame, *keys: str) -> DataFrame:
    """The box of an element on each page, rounded to tenths, in page order; null for elements on one page."""
    per = blocks.groupBy(*keys, "page_num").agg(*[F.bround(f(c), 1).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    out = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page_num", "x0", "y0", "x1", "y1"))).alias("_b"))
    return out.select(*keys, F.when(F.size("_b") > 1, F.col("_b")).alias("bbox_pages"))


def in_regions(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks whose centre lies in a region (doc_id, page_num, rx0, ry0, rx1, ry1) of their page: an equi-join by page, the rectangle as condition."""
    r = regions.withColumnsRenamed({"doc_id": "_d", "page_num": "_p"})
    rect = F.struct(F.col("rx0").alias("x0"), F.col("ry0").alias("y0"), F.col("rx1").alias("x1"), F.col("ry1").alias("y1"))
    hit = P.inside(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), rect)
    return blocks.join(r, (F.col("doc_id") == F.col("_d")) & (F.col("page_num") == F.col("_p")) & hit, "left_semi")


def image_captions(blocks: DataFrame) -> DataFrame:
    """J27 where captions cannot compete: each image with the first caption among the next three blocks that are no images."""
    w = in_page_order()
    found: Column = F.lit(None).cast("string")
    for k in (3, 2, 1):
        t = F.lead("text", k).over(w)
        ok = ~F.lead("is_image", k).over(w) & like(t, r"(?U)^[Рр]исунок\s*\d+")
        found = F.when(ok, t).otherwise(found)
    return blocks.withColumn("caption", found).where("is_image")


def browser_lines(words: DataFrame) -> DataFrame:
    """Words (doc_id, page_num, blk_seq, x0, y0, x1, y1, text, max_font_size) to lines: a new line where y moves by over 0.6 fonts. A line may be a table row if it has at least three distinct x."""
    w = Window.partitionBy("doc_id", "page_num").orderBy("y0", "x0", "blk_seq")
    new = F.coalesce(F.abs(F.col("y0") - F.lag("y0").over(w)) > 0.6 * F.col("max_font_size"), F.lit(True))
    df = words.withColumn("line_no", F.sum(new.cast("bigint")).over(w))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "blk_seq", "text"))), lambda x: x.text), " ")
    return df.groupBy("doc_id", "page_num", "line_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), texts.alias("text"), (F.count_distinct("x0") >= 3).alias("maybe_table"))
