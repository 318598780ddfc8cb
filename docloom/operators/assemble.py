"""Assembly of structured XML from element rows. All text is escaped on construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import col


def esc(x: Column | str) -> Column:
    t = F.coalesce(col(x), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def tag(name: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))


def table_xml(rows: Column, title: Column | None = None) -> Column:
    """Rows (array of arrays of text) as a table; the first row is the head, short rows are padded to the widest; '' for none."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))

    def row(r: Column) -> Column:
        cells = F.transform(F.sequence(F.lit(1), width), lambda i: tag("entry", tag("para", esc(F.coalesce(F.try_element_at(r, i), F.lit(""))))))
        return tag("row", F.array_join(cells, ""))

    body = F.array_join(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), row), "")
    group = F.concat(F.lit('<tgroup cols="'), width.cast("string"), F.lit('">'), tag("thead", row(rows[0])), F.when(body != "", tag("tbody", body)).otherwise(""), F.lit("</tgroup>"))
    head = F.lit("") if title is None else F.when(F.coalesce(title, F.lit("")) != "", tag("title", esc(title))).otherwise("")
    return F.when((F.size(rows) > 0) & (width > 0), tag("table", F.concat(head, group))).otherwise("")


def list_xml(items: Column, prefix: str = "pf02") -> Column:
    """Items as a list; '' for none."""
    body = F.array_join(F.transform(items, lambda i: tag("listItem", tag("para", esc(i)))), "")
    return F.when(F.size(items) > 0, F.concat(F.lit(f'<randomList listItemPrefix="{prefix}">'), body, F.lit("</randomList>"))).otherwise("")


def element_xml(kind: Column | str, text: Column | str) -> Column:
    """One fragment a row, by type; list rows are list items, which sections() joins."""
    k, t = col(kind), esc(text)
    para = tag("para", t)
    return (
        F.when(k.isin("header", "numbered_paragraph_header", "heading"), tag("title", t))
        .when(k == "warning", tag("warning", tag("warningAndCautionPara", t)))
        .when(k == "caution", tag("caution", tag("warningAndCautionPara", t)))
        .when(k == "note", tag("note", tag("notePara", t)))
        .when(k.isin("illustration", "figure"), F.concat(F.lit("<figure>"), tag("title", t), F.lit("</figure>")))
        .when(k.endswith("_list"), tag("listItem", para))
        .otherwise(para)
    )


def bucket(kind: Column | str) -> Column:
    """Place of a type in its section: title, warnings, cautions, the rest."""
    k = col(kind)
    return F.when(k.isin("header", "numbered_paragraph_header", "heading"), 0).when(k == "warning", 1).when(k == "caution", 2).otherwise(3)


def sections(elements: DataFrame) -> DataFrame:
    """Rows (doc_id, seq, type, content) to one levelledPara a section, in order: a header opens a section, runs of list rows become lists, safety texts move before
    the rest where there are any. (doc_id, section, xml)
    """
    w = Window.partitionBy("doc_id").orderBy("seq")
    head = bucket("type") == 0
    listed = F.col("type").endswith("_list")
    df = elements.where("type NOT IN ('_skip', '_extra_pdf', '_unmatched_xml')").withColumn("section", F.sum(head.cast("bigint")).over(w))
    starts = ~listed | ~F.coalesce(F.lag(listed).over(w), F.lit(False)) | (F.lag("section").over(w) != F.col("section"))
    df = df.withColumns({"_run": F.sum(starts.cast("int")).over(w), "_x": element_xml("type", "content"), "_b": bucket("type"), "_l": listed})
    runs = df.groupBy("doc_id", "section", "_run").agg(F.min("seq").alias("seq"), F.min("_b").alias("_b"), F.bool_or("_l").alias("_l"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_x"))), lambda x: x["_x"]), "").alias("_x"))
    body = F.when(F.col("_l"), tag("para", tag("randomList", F.col("_x")))).otherwise(F.col("_x"))
    out = runs.groupBy("doc_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "seq", body.alias("x")))), lambda x: x.x), "").alias("_body"))
    return out.select("doc_id", "section", tag("levelledPara", F.col("_body")).alias("xml"))


def modules(parts: DataFrame) -> DataFrame:
    """K1: sections (doc_id, section, xml) to one descriptive module a document."""
    out = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "xml"))), lambda x: x.xml), "").alias("_b"))
    return out.select("doc_id", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><dmodule><content><description>'), F.col("_b"), F.lit("</description></content></dmodule>")).alias("xml"))


def table_titles(rows: DataFrame) -> DataFrame:
    """A title row (is_title) names the next table (is_table) only. Adds table_title."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = rows.withColumn("_n", F.coalesce(F.sum(F.col("is_table").cast("int")).over(before), F.lit(0)))
    own = Window.partitionBy("doc_id", "_n").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("table_title", F.when(F.col("is_table"), F.last(F.when(F.col("is_title"), F.col("text")), ignorenulls=True).over(own))).drop("_n")


def procedure_xml(steps: DataFrame) -> DataFrame:
    """Steps (doc_id, seq, parent_seq, text, and items, an array, if there are any), at most two deep, to one mainProcedure a document; ids run in pre-order."""
    top = F.coalesce("parent_seq", "seq")
    w = Window.partitionBy("doc_id").orderBy(top, F.col("parent_seq").isNotNull(), "seq")
    df = steps.withColumns({"_top": top, "_id": F.concat(F.lit("stp-"), F.lpad(F.row_number().over(w).cast("string"), 5, "0"))})
    opening = F.concat(F.lit('<proceduralStep id="'), F.col("_id"), F.lit('">'), tag("para", F.concat(esc("text"), list_xml(F.col("items"))) if "items" in steps.columns else esc("text")))
    sub = F.when(F.col("parent_seq").isNotNull(), F.struct("seq", F.concat(opening, F.lit("</proceduralStep>")).alias("x")))
    out = df.groupBy("doc_id", "_top").agg(F.max(F.when(F.col("parent_seq").isNull(), opening)).alias("_o"), F.array_join(F.transform(F.array_sort(F.collect_list(sub)), lambda s: s.x), "").alias("_s"))
    whole = F.concat(F.coalesce("_o", F.lit("<proceduralStep>")), "_s", F.lit("</proceduralStep>"))
    done = out.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_top", whole.alias("x")))), lambda s: s.x), "").alias("_b"))
    return done.select("doc_id", tag("mainProcedure", F.col("_b")).alias("xml"))


def entities(refs: DataFrame) -> DataFrame:
    """K1's doctype: sorted distinct graphics of a document. (doc_id, doctype)"""
    names = F.array_sort(F.collect_set("name"))
    lines = F.transform(names, lambda n: F.concat(F.lit("<!ENTITY "), n, F.lit(' SYSTEM "'), n, F.lit('.jpg" NDATA jpg>')))
    return refs.groupBy("doc_id").agg(F.concat(F.lit("<!DOCTYPE dmodule ["), F.array_join(lines, ""), F.lit("]>")).alias("doctype"))


def publication_entries(refs: DataFrame) -> DataFrame:
    """The entries of the publication module over all module references (system_code, sub_key, k, first_pos, x), ordered by these columns; a row each, so no row holds them all."""
    from docloom.operators.reports import contents

    entry = F.concat(F.lit("<pmEntry><pmEntryTitle>"), esc(F.concat_ws(" ", "name", "entry")), F.lit("</pmEntryTitle>"), F.array_join(F.transform("dmcs", lambda d: F.concat(F.lit("<dmRef>"), d, F.lit("</dmRef>"))), ""), F.lit("</pmEntry>"))
    return contents(refs).select("system_code", "sub_key", (F.col("kind") != "direct").alias("k"), "first_pos", entry.alias("x"))


def publication(refs: DataFrame) -> DataFrame:
    """The publication module as one row, for references that fit one."""
    return publication_entries(refs).agg(F.concat(F.lit("<pm><content>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("system_code", "sub_key", "k", "first_pos", "x"))), lambda r: r.x), ""), F.lit("</content></pm>")).alias("xml"))


def sidecar_json(elements: DataFrame) -> DataFrame:
    """K4: (doc_id, seq, stable_id, type, text_start) to one JSON document each."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "stable_id", "type", "text_start")))
    return elements.groupBy("doc_id").agg(F.to_json(F.struct(rows.alias("element_map"))).alias("json"))


def upsert(store: DataFrame, changes: DataFrame, key: str = "dmc") -> DataFrame:
    """K5: rows of changes replace those of their key; created_at of an existing key stays. A change with deleted = true removes its key."""
    old = store.select(F.col(key).alias("_k"), F.col("created_at").alias("_c"))
    new = changes.join(old, changes[key] == F.col("_k"), "left").withColumn("created_at", F.coalesce("_c", "created_at")).drop("_k", "_c")
    return store.join(changes.select(key), key, "left_anti").unionByName(new.where(~F.coalesce("deleted", F.lit(False))).drop("deleted"))


def report(elements: DataFrame, preview: int = 100) -> DataFrame:
    """K7: one text line an element: position, type and the first characters."""
    text = F.substring(F.replace("content", F.lit("\n"), F.lit(" ")), 1, preview)
    return elements.select("doc_id", "seq", F.format_string("%05d %s: %s", "seq", "type", text).alias("line"))
