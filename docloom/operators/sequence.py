"""Operators over ordered rows of a document: runs, sections, counters, forward fill, look-ahead.

All are windows partitioned by document and ordered by an explicit sequence column, so a job is one shuffle by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import pytrim


def by(doc: str, seq: str) -> Window:
    return Window.partitionBy(doc).orderBy(seq)


def upto(w) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(w) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def run_id(key: Column, w) -> Column:
    """Number of the run of equal keys, from 1; nulls are one key."""
    return F.sum((~key.eqNullSafe(F.lag(key).over(w)) | F.row_number().over(w).eqNullSafe(1)).cast("bigint")).over(upto(w))


def section_id(is_header: Column, w) -> Column:
    """Number of headers at or above a row, 0 before the first."""
    return F.sum(is_header.cast("bigint")).over(upto(w))


def forward_fill(value: Column, w) -> Column:
    """Last value that is not null at or above a row."""
    return F.last(value, ignorenulls=True).over(upto(w))


def positions(df: DataFrame, doc: str = "doc_id", seq: str = "seq", text: str = "text") -> DataFrame:
    """Line number (newlines before the row) and column (characters since the last newline) at which each row begins."""
    w = before(by(doc, seq))
    breaks = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    start = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    df = df.withColumns({"line": F.coalesce(F.sum(breaks).over(w), F.lit(0)).cast("bigint"), "_start": start})
    after = F.when(F.instr(F.col(text), "\n") > 0, F.col("_start") + F.length(text) - F.length(F.substring_index(F.col(text), "\n", -1)))
    return df.withColumn("column", (F.col("_start") - F.coalesce(F.max(after).over(w), F.lit(0))).cast("bigint")).drop("_start")


def numbering(df: DataFrame, level: str = "level", doc: str = "doc_id", seq: str = "seq", depth: int = 4) -> DataFrame:
    """Hierarchical number of rows with a level (1 to depth); a parent that never came prints 0. Rows without a level get null."""
    w = by(doc, seq)
    keys: list[str] = []
    for k in range(1, depth + 1):
        own = Window.partitionBy(doc, *keys).orderBy(seq) if keys else w
        df = df.withColumn(f"_c{k}", F.coalesce(F.sum((F.col(level) == k).cast("bigint")).over(upto(own)), F.lit(0)))
        keys.append(f"_c{k}")
    parts = F.array(*[F.col(k).cast("string") for k in keys])
    return df.withColumn("number", F.when(F.col(level).isNotNull(), F.array_join(F.slice(parts, 1, F.least(F.col(level), F.lit(depth)).cast("int")), "."))).drop(*keys)


def header_counter(df: DataFrame, is_header: Column, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """N of the n-th header of a (num_id, ilvl) in its document, never reset; null for other rows."""
    w = Window.partitionBy(doc, "num_id", "ilvl", is_header).orderBy(seq)
    return df.withColumn("counter", F.when(is_header, F.row_number().over(w)).cast("bigint"))


def after_colon(df: DataFrame, doc: str = "doc_id", seq: str = "seq", text: str = "text") -> DataFrame:
    """Adds after_intro (going up over empty and ';' rows, the first other ends in ':') and in_colon_list (a ':' row above, no
    empty row between, the row itself neither empty nor ending in ':')."""
    w, t = before(by(doc, seq)), pytrim(text)
    # Frames look at each row several times: what they ask of its text is asked once.
    df = df.withColumns({"_other": (t != "") & ~t.endswith(";"), "_colon": t.endswith(":"), "_empty": t == ""})
    intro = F.last(F.when(F.col("_other"), F.col("_colon")), ignorenulls=True).over(w)
    colon = F.max(F.when(F.col("_colon"), F.col(seq))).over(w)
    empty = F.max(F.when(F.col("_empty"), F.col(seq))).over(w)
    inside = colon.isNotNull() & (empty.isNull() | (empty < colon)) & ~F.col("_empty") & ~F.col("_colon")
    return df.withColumns({"after_intro": F.coalesce(intro, F.lit(False)), "in_colon_list": inside}).drop("_other", "_colon", "_empty")


def fuse_captions(df: DataFrame, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """A reference to a figure followed by a caption paragraph becomes one illustration with the caption, consuming both.

    A caption is consumed once: of adjacent candidates the earlier fuses.
    """
    w = by(doc, seq)
    caption = (F.col("type") == "paragraph") & F.regexp_like("content", F.lit(r"(?U)^[Рр]исунок\s*\d+"))
    fuses = (F.col("type") == "illustration_reference") & F.coalesce(F.lead(caption).over(w), F.lit(False))
    df = df.withColumns({"_f": fuses, "_next": F.lead("content").over(w)})
    df = df.withColumn("_eaten", F.coalesce(F.lag("_f").over(w), F.lit(False)))
    return df.where(~F.col("_eaten")).withColumns({"type": F.when(F.col("_f"), "illustration").otherwise(F.col("type")), "content": F.when(F.col("_f"), F.col("_next")).otherwise(F.col("content"))}).drop("_f", "_next", "_eaten")


#: Mentions of numbered tables, removed in this order. Fixed values.
MENTIONS = [r"\s*\([Тт]аблица\s*\d+\)\s*", r"\s*[Тт]аблица\s*\d+\s*", r"\s*[Тт]аб\.\s*\d+\s*", r"\s*[Тт]абл\.\s*\d+\s*"]


def strip_table_mention(df: DataFrame, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """A paragraph right before a table loses mentions of numbered tables, then a final comma with a period before it."""
    follows = F.lead("type").over(by(doc, seq)) == "table"
    cut = F.col("content")
    for m in MENTIONS:
        cut = F.regexp_replace(cut, "(?iuU)" + m, "")
    cut = F.regexp_replace(pytrim(cut), r"\.?,$", "")
    return df.withColumn("content", F.when((F.col("type") == "paragraph") & F.coalesce(follows, F.lit(False)), cut).otherwise(F.col("content")))


def list_nesting(df: DataFrame, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """Rows (reaches_list, list_type or null, level): nested_ is put before the type of items deeper than the first of their run.

    A run ends when the type changes or a row that reaches the list test is no list; rows that do not reach it are passed over.
    """
    w = Window.partitionBy(doc, "reaches_list").orderBy(seq)
    df = df.withColumn("_run", run_id(F.col("list_type"), w))
    base = F.first("level").over(Window.partitionBy(doc, "reaches_list", "_run").orderBy(seq))
    nested = F.col("reaches_list") & F.col("list_type").isNotNull() & (F.col("level") > base)
    return df.withColumn("list_class", F.when(nested, F.concat(F.lit("nested_"), "list_type")).otherwise(F.when(F.col("reaches_list"), F.col("list_type")))).drop("_run")


def renumber(df: DataFrame, doc: str = "doc_id", seq: str = "idx") -> DataFrame:
    """Idx 1..n in order over rows that are not _skip, which get 0."""
    skip = F.col("type") == "_skip"
    w = Window.partitionBy(doc, skip).orderBy(seq)
    return df.withColumn("new_idx", F.when(skip, 0).otherwise(F.row_number().over(w)).cast("bigint"))


def merge_refs(df: DataFrame, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """Adjacent rows of one ref and type, in paragraph, list, note and warning types, become one, contents joined by newlines."""
    w = by(doc, seq)
    mergeable = F.col("ref").isNotNull() & F.col("type").isin("paragraph", "unnumbered_list", "note", "warning")
    key = F.when(mergeable, F.concat_ws("|", F.col("ref").cast("string"), "type")).otherwise(F.concat(F.lit("#"), F.col(seq).cast("string")))
    df = df.withColumn("_run", run_id(key, w))
    return df.groupBy(doc, "_run").agg(F.min(seq).alias(seq), F.min_by("type", seq).alias("type"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, "content"))), lambda x: x.content), "\n").alias("content"), F.count("*").alias("n")).drop("_run")


def list_groups(df: DataFrame, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """Adds list_no to list rows: a new list begins after a row that is no list, on a change of plain kind, and where a nested item is followed by a plain one; dense level 0, 1."""
    w = by(doc, seq)
    plain = F.regexp_replace("type", "^nested_", "")
    is_list = F.col("type").endswith("_list")
    back = F.coalesce(F.lag("type").over(w).startswith("nested_"), F.lit(False)) & ~F.col("type").startswith("nested_")
    start = is_list & (~F.coalesce(F.lag(is_list).over(w), F.lit(False)) | (F.lag(plain).over(w) != plain) | back)
    return df.withColumns({"list_no": F.when(is_list, F.sum(start.cast("bigint")).over(upto(w))), "list_level": F.when(is_list, F.col("type").startswith("nested_").cast("bigint"))})


def step_parents(df: DataFrame, is_section: Column, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """parent_seq is the last section above a row that is no section itself; without one rows stand flat (depth 0)."""
    parent = F.last(F.when(is_section, F.col(seq)), ignorenulls=True).over(before(by(doc, seq)))
    return df.withColumns({"parent_seq": F.when(~is_section, parent), "depth": F.when(is_section | parent.isNull(), 0).otherwise(1).cast("bigint")})


def group_items(df: DataFrame, is_item: Column, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """Runs of list items attach to the row before them; a run at the start stands for itself. Gives one row a head, with items in order."""
    w = by(doc, seq)
    head = ~is_item | (F.row_number().over(w) == 1)
    df = df.withColumn("_h", F.sum(head.cast("bigint")).over(upto(w)))
    items = F.transform(F.array_sort(F.collect_list(F.struct(seq, "text"))), lambda x: x.text)
    out = df.groupBy(doc, "_h").agg(F.min(seq).alias(seq), items.alias("_all"))
    return out.select(doc, seq, F.col("_all")[0].alias("text"), F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))).alias("items"))
