"""Documents as HTML with headings, nested lists, tables with spans and pictures.

Which lists are open at a paragraph follows from the last paragraph of each level in its run of list items: a window a level, and no walk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import like, pytrim
from docloom.operators import assemble as A
from docloom.operators.sequence import before, by, upto

#: Levels of lists that a document can have. Fixed value.
LEVELS = 9
#: Styles that are lists of level 0 without numbering. Fixed values.
STYLES = {"ul": ["List Paragraph", "List Bullet", "List Bullet 2"], "ol": ["List Number", "List Number 2"]}
#: A paragraph that a dash makes a list item. Fixed value.
DASH = r"(?Us)^[-\u2013\u2014\u2212]\s*(?=.)"


def dashed(x: Column, text: Column, was: Column, then: Column) -> Column:
    """A paragraph x with its plain text, as an item if a dash opens it; was and then: whether its neighbours are such items."""
    item = F.concat(F.when(was, "").otherwise('<ul class="dash-list">'), A.tag("li", F.regexp_replace(x, DASH, "")), F.when(then, "").otherwise("</ul>"))
    return F.when(like(text, DASH), item).otherwise(A.tag("p", x))


def spans(cells: DataFrame) -> DataFrame:
    """(doc_id, pos, row_no, col_no, text, rowspan, colspan) of cells (doc_id, pos, cell, row_no, col_no, text) that are given once for each place they take."""
    out = cells.groupBy("doc_id", "pos", "cell").agg(
        F.min("row_no").alias("row_no"), F.min("col_no").alias("col_no"), F.min_by("text", F.struct("row_no", "col_no")).alias("text"),
        (F.max("row_no") - F.min("row_no") + 1).alias("rowspan"), (F.max("col_no") - F.min("col_no") + 1).alias("colspan"),
    )
    return out.drop("cell")


def tables(cells: DataFrame) -> DataFrame:
    """(doc_id, pos, xml): tables as HTML. A row of which all places belong to cells above is an empty row."""
    number = lambda name: F.when(F.col(name) > 1, F.concat(F.lit(f' {name}="'), F.col(name).cast("string"), F.lit('"'))).otherwise("")
    paras = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), pytrim), lambda x: x != "")
    dash = lambda i: like(F.coalesce(F.get(paras, i), F.lit("")), DASH)
    body = F.array_join(F.transform(paras, lambda x, i: dashed(A.esc(x), x, dash(i - 1), dash(i + 1))), "")
    one = spans(cells).withColumn("_x", F.concat(F.lit("<td"), number("colspan"), number("rowspan"), F.lit(">"), body, F.lit("</td>")))
    rows = one.groupBy("doc_id", "pos", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "_x"))), lambda r: r["_x"]), "").alias("_x"))
    every = cells.groupBy("doc_id", "pos").agg(F.explode(F.sequence(F.lit(0), F.max("row_no").cast("int"))).alias("row_no"))
    rows = every.join(rows, ["doc_id", "pos", "row_no"], "left").groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct("row_no", F.coalesce("_x", F.lit("")).alias("x")))).alias("_r"))
    return rows.select("doc_id", "pos", A.tag("table", F.array_join(F.transform("_r", lambda r: A.tag("tr", r.x)), "")).alias("table"))


def pictures(images: DataFrame) -> DataFrame:
    """(doc_id, pos, picture): images (doc_id, pos, no, content_type, data) of a paragraph as data addresses."""
    one = F.concat(F.lit('<img src="data:'), F.col("content_type"), F.lit(";base64,"), F.base64("data"), F.lit('" />'))
    one = F.regexp_replace(one, "\\s*[\r\n]+", "")
    return images.groupBy("doc_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", one.alias("x")))), lambda r: r.x), "").alias("picture"))


def rendered(rows: DataFrame, cells: DataFrame | None = None, numbers: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """(doc_id, html) of rows (doc_id, pos, kind, text, style, num_id, ilvl): body parts in order, a table being one row.

    numbers (doc_id, num_id, ilvl, ordered) tells ordered lists of the numbering; others are unordered. Headings count sections. A paragraph without text and
    picture is left out, and does not part a list. Paragraphs that begin with a dash become a list of their own. Levels beyond the ninth count as the ninth, a null
    level as the first; a table without cells shows its text in one.
    """
    df = rows.select("doc_id", "pos", "kind", F.coalesce("text", F.lit("")).alias("text"), "style", F.col("num_id").cast("bigint").alias("num_id"), F.least(F.greatest(F.coalesce(F.col("ilvl"), F.lit(0)), F.lit(0)), F.lit(LEVELS - 1)).cast("int").alias("ilvl"))
    for extra, name in ((None if cells is None else tables(cells), "table"), (None if images is None else pictures(images), "picture")):
        df = df.withColumn(name, F.lit(None).cast("string")) if extra is None else df.join(extra, ["doc_id", "pos"], "left")
    if numbers is None:
        df = df.withColumn("ordered", F.lit(False))
    else:
        known = numbers.groupBy("doc_id", F.col("num_id").cast("bigint").alias("num_id"), F.col("ilvl").cast("int").alias("ilvl")).agg(F.max("ordered").alias("ordered"))
        df = df.join(known, ["doc_id", "num_id", "ilvl"], "left").withColumn("ordered", F.coalesce("ordered", F.lit(False)))
    text = A.esc(pytrim("text"))
    df = df.where((F.col("kind") == "table") | (pytrim("text") != "") | F.col("picture").isNotNull()).repartition("doc_id")
    heading = F.when(F.col("kind") == "table", "").otherwise(F.regexp_extract(F.coalesce("style", F.lit("")), "^Heading ([1-6])$", 1))
    styled = reduce(lambda c, kv: c.when(F.col("style").isin(kv[1]), kv[0]), STYLES.items(), F.when(F.lit(False), ""))
    plain = (F.col("kind") != "table") & (heading == "")
    item = F.when(plain & F.col("num_id").isNotNull(), F.when(F.col("ordered"), "ol").otherwise("ul")).when(plain, styled)
    df = df.withColumns({"item": item, "level": F.when(F.col("num_id").isNotNull(), F.col("ilvl")).otherwise(0), "heading": heading})
    w = by("doc_id", "pos")
    starts = ~F.col("item").isNotNull().eqNullSafe(F.lag(F.col("item").isNotNull()).over(w))
    df = df.withColumn("_run", F.sum(starts.cast("int")).over(w))
    v = Window.partitionBy("doc_id", "_run").orderBy("pos")
    # The kind of the list that is open on each level, before a paragraph and after it: a lower level's paragraph closes it, one that was skipped is unordered.
    at = [F.when(F.col("level") == j, F.col("item")).when(F.col("level") < j, "ul") for j in range(LEVELS)]
    df = df.withColumns({f"_b{j}": F.coalesce(F.last(x, ignorenulls=True).over(before(v)), F.lit("ul")) for j, x in enumerate(at)} | {f"_a{j}": F.coalesce(F.last(x, ignorenulls=True).over(upto(v)), F.lit("ul")) for j, x in enumerate(at)})
    df = df.withColumns({"_was": F.coalesce(F.lag("level").over(v), F.lit(-1)), "_last": F.lead("pos").over(v).isNull()})
    was, level, kind = F.col("_was"), F.col("level"), F.col("item")
    down = F.concat(*[F.when((was >= j) & (level < j), F.concat(F.lit("</li></"), F.col(f"_b{j}"), F.lit(">"))).otherwise("") for j in range(LEVELS - 1, 0, -1)])
    open_ = F.concat(F.lit("<"), kind, F.lit("><li>"))
    here = reduce(lambda c, j: c.when(level == j, F.col(f"_b{j}")), range(LEVELS), F.when(F.lit(False), ""))
    turn = F.when(level > was, F.concat(F.repeat(F.lit("<ul><li>"), level - was - 1), open_)).when(here == kind, "</li><li>").otherwise(F.concat(F.lit("</li></"), here, F.lit(">"), open_))
    close = F.concat(*[F.when(F.col("_last") & (level >= j), F.concat(F.lit("</li></"), F.col(f"_a{j}"), F.lit(">"))).otherwise("") for j in range(LEVELS - 1, -1, -1)])
    told = F.concat(text, F.coalesce("picture", F.lit("")))
    dash = lambda c: F.coalesce(c, F.lit(False))
    df = df.withColumn("_dash", plain & kind.isNull() & like(pytrim("text"), DASH))
    section = F.sum((heading != "").cast("int")).over(w)
    out = (
        F.when(F.col("kind") == "table", F.coalesce("table", F.concat(F.lit("<table><tr><td>"), F.when(text != "", A.tag("p", text)).otherwise(""), F.lit("</td></tr></table>"))))
        .when(heading != "", F.concat(F.lit("<h"), heading, F.lit(' data-section-id="docx-sec-'), section.cast("string"), F.lit('">'), told, F.lit("</h"), heading, F.lit(">")))
        .when(kind.isNotNull(), F.concat(down, turn, told, close))
        .otherwise(dashed(told, pytrim("text"), dash(F.lag("_dash").over(w)), dash(F.lead("_dash").over(w))))
    )
    whole = df.select("doc_id", "pos", out.alias("_x")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_x"))), lambda r: r["_x"]), "").alias("_h"))
    return whole.select("doc_id", F.concat(F.lit('<div class="docx-content">'), "_h", F.lit("</div>")).alias("html"))
