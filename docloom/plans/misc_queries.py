"""Queries of the remaining operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import predicates as P, text as X
from docloom.operators import classify as C, importing as imp, layout as L, matching as M, pages, sequence as S, tables, votes
from docloom.plans import duck as D
from docloom.plans.registry import query
from docloom.streaming import ingest


@query("j11_pages", "left_elements", "blocks")
def page_match(left: DataFrame, blocks: DataFrame) -> DataFrame:
    return pages.match(left, blocks.withColumn("is_table", F.col("in_table")))


@query("j11_unmatched", "left_elements", "blocks", sql="SELECT doc_id, count(*) AS n FROM {left_elements} GROUP BY doc_id")
def page_elements(left: DataFrame, blocks: DataFrame) -> DataFrame:
    """J11 keeps every element: matched, or as a sentinel."""
    out = pages.match(left, blocks.withColumn("is_table", F.col("in_table")))
    return out.where("source_idx IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("g5_parse_blocks", "pages", sql=r"SELECT page_id, unnest(range(1, len(t) + 1)) AS anno_idx, unnest(t) AS tag FROM (SELECT page_id, list_transform(regexp_extract_all(html, '(?i)<(h[1-6]|p|ul|ol|table|img)[\s>/]', 1), lambda x: lower(x)) AS t FROM {pages})")
def parse_blocks(pages_: DataFrame) -> DataFrame:
    """The table function called from SQL for every page."""
    tables.register(pages_.sparkSession)
    return pages_.sparkSession.sql("SELECT page_id, b.anno_idx, b.tag FROM {p}, LATERAL parse_blocks(html) b", p=pages_)


@query("g5_classify_document", "paras")
def classify_document(paras: DataFrame) -> DataFrame:
    """P17 as a table function over documents, each in order."""
    tables.register(paras.sparkSession)
    return paras.sparkSession.sql("SELECT * FROM classify_document(TABLE({p}) PARTITION BY doc_id ORDER BY para_idx)", p=C.flags(paras))


@query("j18_numbering", "paras", sql="SELECT doc_id, para_idx, CASE WHEN num_id IS NULL THEN NULL WHEN num_id = 1 THEN 'numbered_list' WHEN num_id = 2 THEN 'unnumbered_list' ELSE 'unnumbered_list' END AS kind FROM {paras}")
def numbering(paras: DataFrame) -> DataFrame:
    """Numbering definitions by id; a missing one is unnumbered. The definitions of a document are few, AQE picks the join."""
    defs = paras.select("doc_id", "num_id").where("num_id < 3").distinct().withColumn("level_text", F.when(F.col("num_id") == 1, "%1.").otherwise("•"))
    kind = F.when(F.col("num_id").isNull(), F.lit(None).cast("string")).when(F.contains(F.coalesce("level_text", F.lit("")), F.lit("%")), "numbered_list").otherwise("unnumbered_list")
    return paras.join(defs, ["doc_id", "num_id"], "left").select("doc_id", "para_idx", kind.alias("kind"))


@query("j29_figures_to_graphics", "figures", sql="SELECT doc_id, seq, regexp_extract(content, 'Рисунок ([0-9]+)', 1)::bigint - 1 AS graphic FROM {figures} WHERE type = 'illustration' AND regexp_extract(content, 'Рисунок ([0-9]+)', 1)::bigint > 0")
def graphics(figures: DataFrame) -> DataFrame:
    """Figure n shows graphic n - 1."""
    n = F.regexp_extract("content", r"(?U)Рисунок (\d+)", 1).try_cast("bigint")
    return figures.where("type = 'illustration'").select("doc_id", "seq", (n - 1).alias("graphic")).where("graphic >= 0")


@query("j28_ordinal", "left_elements", "right_elements", sql="SELECT l.doc_id, l.idx AS l, r.idx AS r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY idx) AS k FROM {left_elements}) l JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY idx) AS k FROM {right_elements}) r ON l.doc_id = r.doc_id AND l.type = r.type AND l.k = r.k")
def ordinal(left: DataFrame, right: DataFrame) -> DataFrame:
    """J28's fallback: the k-th element of a type with the k-th of the other side."""
    w = Window.partitionBy("doc_id", "type").orderBy("idx")
    a = left.select("doc_id", "type", F.col("idx").alias("l"), F.row_number().over(w).alias("k"))
    b = right.select("doc_id", "type", F.col("idx").alias("r"), F.row_number().over(w).alias("k"))
    return a.join(b, ["doc_id", "type", "k"]).select("doc_id", "l", "r")


@query("a3_converged", "left_elements", sql="SELECT doc_id, count(*) % 100 >= 95 AS converged FROM {left_elements} GROUP BY doc_id")
def converged(left: DataFrame) -> DataFrame:
    return left.groupBy("doc_id").agg(M.converged(F.count("*") % 100 / 100.0).alias("converged"))


@query("a14_table_letters", "raw_docs", sql="SELECT sys, sub, comp, count(*) AS tables FROM {raw_docs} WHERE special_type = 'table' GROUP BY ALL")
def table_letters(docs: DataFrame) -> DataFrame:
    """Every table of a component gets a module 040 of its own letter."""
    df = imp.build_modules(docs).join(docs.where("special_type = 'table'").select("seq"), "seq", "left_semi")
    return df.groupBy("sys", "sub", "comp").agg(F.count_distinct("variant").alias("tables"))


@query("w7_list_ends", "typed", sql="SELECT doc_id, list_no, max(seq) AS end_seq FROM (SELECT doc_id, seq, l, sum(CASE WHEN l AND NOT p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS list_no FROM (SELECT doc_id, seq, type = 'unnumbered_list' AS l, coalesce(lag(type = 'unnumbered_list') OVER (PARTITION BY doc_id ORDER BY seq), false) AS p FROM {typed})) WHERE l GROUP BY ALL")
def list_ends(typed: DataFrame) -> DataFrame:
    """The last row of each run of plain list items."""
    w = S.by("doc_id", "seq")
    listed = F.col("type") == "unnumbered_list"
    start = listed & ~F.coalesce(F.lag(listed).over(w), F.lit(False))
    df = typed.withColumn("list_no", F.sum(start.cast("bigint")).over(w)).where(listed)
    return df.groupBy("doc_id", "list_no").agg(F.max("seq").alias("end_seq"))


@query("w21_previous", "typed", sql="SELECT doc_id, seq, lag(type) OVER w AS previous_type, right(lag(content) OVER w, 1) AS ending FROM {typed} WINDOW w AS (PARTITION BY doc_id ORDER BY seq)")
def previous(typed: DataFrame) -> DataFrame:
    w = S.by("doc_id", "seq")
    return typed.select("doc_id", "seq", F.lag("type").over(w).alias("previous_type"), F.right(F.lag("content").over(w), F.lit(1)).alias("ending"))


@query("f9_forms", "paras", sql=rf"SELECT doc_id, para_idx, {D.sub(D.sub(D.trim('text'), r'^\d+(?:\.\d+)*[.)]*\s*'), r'^[–•-]\s*')} AS stripped FROM {{paras}}")
def list_forms(paras: DataFrame) -> DataFrame:
    return paras.select("doc_id", "para_idx", X.strip_list_prefix("text").alias("stripped"))


@query("f22_json", "left_elements", sql="SELECT doc_id, idx, type, span FROM {left_elements}")
def as_json(left: DataFrame) -> DataFrame:
    """A row as JSON and back."""
    j = F.to_json(F.struct("idx", "type", "span"))
    back = F.from_json(j, "idx bigint, type string, span bigint")
    return left.select("doc_id", F.explode(F.array(back)).alias("_b")).select("doc_id", "_b.idx", "_b.type", "_b.span")


@query("f23_defaults", "folders", sql="SELECT folder_seq, CASE WHEN starts_with(folder_name, '[') THEN regexp_extract(folder_name, '^.([A-Z0-9]+)-', 1) ELSE 'S5' END AS model FROM {folders}")
def defaults(folders: DataFrame) -> DataFrame:
    """Constructors with defaults."""
    from docloom.functions.codes import dm_code

    return folders.select("folder_seq", F.coalesce(dm_code("folder_name").modelIdentCode, F.lit("S5")).alias("model"))


@query("f26_prompts", "typed", sql="SELECT doc_id, seq, 'Классифицируйте элемент документа.' || chr(10) || 'Стиль: ' || type || chr(10) || 'Предыдущий элемент: ' || 'x' || chr(10) || 'Текст: ' || content AS prompt FROM {typed}")
def prompts(typed: DataFrame) -> DataFrame:
    return typed.select("doc_id", "seq", votes.prompt("content", F.lit("x"), "type").alias("prompt"))


@query("f27_answers", "typed", sql="SELECT doc_id, seq, CASE seq % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'list_item' END AS type, CASE seq % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 END::double AS confidence FROM {typed}")
def answers(typed: DataFrame) -> DataFrame:
    k = F.col("seq") % 4
    said = F.when(k == 0, 'Sure: {"type": "HEADER", "confidence": 0.9} ok').when(k == 1, '{"type": "odd"}').when(k == 2, '{"type": "list_item", "reasoning": "x"}').otherwise("no idea")
    a = votes.parse_answer(said)
    return typed.select("doc_id", "seq", F.explode(F.array(a)).alias("_a")).select("doc_id", "seq", "_a.type", "_a.confidence")


@query("f28_body", "pages", sql="SELECT page_id, length(regexp_extract(html, '(?s)<body[^>]*>(.*)</body>', 1))::bigint AS n FROM {pages}")
def body(html: DataFrame) -> DataFrame:
    return html.select("page_id", F.length(F.regexp_extract("html", r"(?s)<body[^>]*>(.*)</body>", 1)).cast("bigint").alias("n"))


@query("g1_votes", "typed", sql="SELECT doc_id, seq, CASE WHEN seq % 5 = 0 THEN 'heuristic' ELSE 'default' END AS source, CASE WHEN seq % 5 = 0 THEN 'header' ELSE 'paragraph' END AS type FROM {typed}")
def vote(typed: DataFrame) -> DataFrame:
    rows = typed.select("doc_id", "seq", F.col("content").alias("text"), F.lit("paragraph.").alias("previous"), F.lit("Normal").alias("style"))
    df = votes.classify(rows, heuristic=F.when(F.col("seq") % 5 == 0, "header"))
    return df.select("doc_id", "seq", "vote.source", "vote.type")


@query("p26_mode", "folders", sql="SELECT folder_seq, CASE folder_seq % 5 WHEN 0 THEN 'graphics' WHEN 1 THEN 'desc' WHEN 2 THEN 'tech' WHEN 3 THEN 'component' END AS role, folder_seq % 5 < 3 AS used FROM {folders}")
def mode(folders: DataFrame) -> DataFrame:
    k = F.col("folder_seq") % 5
    name = F.when(k == 0, "Рисунки описание").when(k == 1, "Описания").when(k == 2, "Технология").when(k == 3, "012.00.00").otherwise("прочее")
    return imp.mode(folders.select("folder_seq", name.alias("name"))).select("folder_seq", "role", "used")


@query("p51_categories", "dm_refs", sql="SELECT pos, dmc, CASE info_code WHEN '071' THEN 'Нормы расхода запасных частей и материалов' WHEN '075' THEN 'Нормы расхода материалов' ELSE 'general' END AS category FROM {dm_refs}")
def categories(refs: DataFrame) -> DataFrame:
    """P51."""
    kind = F.when(F.col("info_code") == "071", "Нормы расхода запасных частей и материалов").when(F.col("info_code") == "075", "Нормы расхода материалов").otherwise("general")
    return refs.select("pos", "dmc", kind.alias("category"))


@query("p54_by_name", "typed", sql="SELECT doc_id, seq FROM {typed} WHERE type = 'table'")
def by_name(typed: DataFrame) -> DataFrame:
    return typed.where("type = 'table'").select("doc_id", "seq")


@query("p19_heading_kinds", "paras", sql=f"SELECT doc_id, para_idx, CASE WHEN {D.any_of('lower(text)', ['общие сведения', 'назначение', 'общее описание', '1.', '1 '])} THEN 'purpose' WHEN {D.any_of('lower(text)', ['состав', 'составные', 'оборудование', '2.', '2 '])} THEN 'description' WHEN {D.any_of('lower(text)', ['информационный', 'принцип действия', 'работы', '3.', '3 '])} THEN 'operation' END AS kind FROM {{paras}} WHERE style = 'Heading 1'")
def heading_kinds(paras: DataFrame) -> DataFrame:
    return paras.where("style = 'Heading 1'").select("doc_id", "para_idx", C.section_kind("text").alias("kind"))


@query("o1_sorted_keys", "dm_refs", sql="SELECT system_code, string_agg(sub_key, ',' ORDER BY sub_key) AS subs FROM (SELECT DISTINCT system_code, sub_key FROM {dm_refs}) GROUP BY system_code")
def sorted_keys(refs: DataFrame) -> DataFrame:
    return refs.groupBy("system_code").agg(F.array_join(F.array_sort(F.collect_set("sub_key")), ",").alias("subs"))


@query("o5_block_order", "blocks", sql="SELECT doc_id, blk_seq, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, y0, blk_seq) AS place FROM {blocks}")
def block_order(blocks: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("page_num", "y0", "blk_seq")
    return blocks.select("doc_id", "blk_seq", F.row_number().over(w).alias("place"))


@query("o6_first_best", "left_elements", sql="SELECT doc_id, arg_max(idx, length(text_start) * 100000 - idx) AS idx FROM {left_elements} GROUP BY doc_id")
def first_best(left: DataFrame) -> DataFrame:
    """The first of equal scores."""
    return left.groupBy("doc_id").agg(F.max_by("idx", F.struct(F.length("text_start"), -F.col("idx"))).alias("idx"))


@query("o8_exists", "left_elements", "right_elements", sql="SELECT doc_id, idx FROM {left_elements} l WHERE EXISTS (SELECT 1 FROM {right_elements} r WHERE r.doc_id = l.doc_id AND r.text_start = l.text_start)")
def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("doc_id", "text_start"), ["doc_id", "text_start"], "left_semi").select("doc_id", "idx")


@query("u4_bag_union", "left_elements", "right_elements", sql="SELECT doc_id, idx, 'left' AS side FROM {left_elements} UNION ALL SELECT doc_id, idx, 'right' FROM {right_elements}")
def bag_union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("doc_id", "idx", F.lit("left").alias("side")).unionByName(right.select("doc_id", "idx", F.lit("right").alias("side")))


@query("e7_block_classes", "blocks", sql=f"WITH f AS (SELECT doc_id, list_sort(list(max_font_size))[(count(*) // 2) + 1] AS m FROM {{blocks}} GROUP BY doc_id) SELECT doc_id, blk_seq, CASE WHEN max_font_size > m * 1.3 THEN 'header' WHEN {D.has(D.trim('text'), rf'^(?:[-–—−•●○]|[0-9]+[.)]{D.WS})')} THEN 'unnumbered_list' ELSE 'paragraph' END AS type FROM {{blocks}} JOIN f USING (doc_id)")
def block_classes(blocks: DataFrame) -> DataFrame:
    """Classes of blocks by font against the document's upper median."""
    stats = L.font_stats(blocks, "doc_id").select("doc_id", "median_font")
    return blocks.join(stats, "doc_id").select("doc_id", "blk_seq", P.font_class("max_font_size", "text", "median_font").alias("type"))


@query("t1_event_windows", "events", sql="SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM {events} GROUP BY ALL")
def event_windows(events: DataFrame) -> DataFrame:
    """The streaming aggregation on a bounded table."""
    return ingest.counts_by_window(events)


@query("s28_counts", "paras", sql="SELECT doc_id, count(*) FILTER (has_image) AS images, count(*) FILTER (text <> '') AS texts, count(*) FILTER (kind = 'table') AS tables FROM {paras} GROUP BY doc_id")
def content_counts(paras: DataFrame) -> DataFrame:
    return paras.groupBy("doc_id").agg(F.count_if("has_image").alias("images"), F.count_if(F.col("text") != "").alias("texts"), F.count_if(F.col("kind") == "table").alias("tables"))


@query("s31_mention_order", "figures", sql="SELECT doc_id, num, min(seq) AS first_seq FROM (SELECT doc_id, seq, regexp_extract(content, 'Рисунок ([0-9]+)', 1) AS num FROM {figures}) WHERE num <> '' GROUP BY ALL")
def mention_order(figures: DataFrame) -> DataFrame:
    n = F.regexp_extract("content", r"(?U)Рисунок (\d+)", 1)
    return figures.select("doc_id", "seq", n.alias("num")).where("num <> ''").groupBy("doc_id", "num").agg(F.min("seq").alias("first_seq"))


@query("s26_organization", "paras", sql="SELECT doc_id, coalesce(nullif(regexp_extract(string_agg(text, ' ' ORDER BY para_idx), '(ОБЩИЕ СВЕДЕНИЯ [0-9])', 1), ''), 'Разработчик') AS organization FROM {paras} GROUP BY doc_id")
def organization(paras: DataFrame) -> DataFrame:
    """A pattern over the joined texts, a constant by default."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "text"))), lambda x: x.text), " ")
    found = F.nullif(F.regexp_extract(texts, "(ОБЩИЕ СВЕДЕНИЯ [0-9])", 1), F.lit(""))
    return paras.groupBy("doc_id").agg(F.coalesce(found, F.lit("Разработчик")).alias("organization"))
