"""Queries of whole documents: conversion, rendering, verification, and what belongs to them."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import codes, predicates as P, rules
from docloom.operators import assemble as A, assembly, convert as Cv, importing as imp, marking, rendering, sequence as S, votes
from docloom.plans import duck as D
from docloom.plans.document_queries import ESC
from docloom.plans.registry import query
from docloom.sources import files, markup as Mk
from docloom.sources.store import shared

#: The types that the assembly queries give to paragraphs, in both engines.
TYPED = "CASE WHEN style = 'Heading 1' THEN 'header' WHEN starts_with({t}, '• ') THEN 'unnumbered_list' WHEN style = '07. Внимание для п.1' THEN 'warning' WHEN style = '07. Примеч. для 1.2' THEN 'note' ELSE 'paragraph' END"
T = D.trim("text")


def elements(paras: DataFrame) -> DataFrame:
    t = P.pytrim("text")
    kind = F.when(F.col("style") == "Heading 1", "header").when(t.startswith("• "), "unnumbered_list").when(F.col("style") == "07. Внимание для п.1", "warning").when(F.col("style") == "07. Примеч. для 1.2", "note").otherwise("paragraph")
    return paras.where(t != "").select("doc_id", F.col("para_idx").alias("seq"), kind.alias("type"), t.alias("content"))


ELEMENTS = f"SELECT doc_id, para_idx AS seq, {TYPED.format(t=T)} AS type, {T} AS content FROM {{paras}} WHERE {T} <> ''"
#: Sections and buckets of these elements; runs of list items within a section.
PLACED = f"""e AS ({ELEMENTS}), s AS (SELECT *, sum((type = 'header')::int) OVER (PARTITION BY doc_id ORDER BY seq) AS section, CASE type WHEN 'header' THEN 0 WHEN 'warning' THEN 1 ELSE 3 END AS b FROM e),
r AS (SELECT *, sum(CASE WHEN type <> 'unnumbered_list' OR p IS DISTINCT FROM 'unnumbered_list' OR ps <> section THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM (SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY seq) AS p, lag(section) OVER (PARTITION BY doc_id ORDER BY seq) AS ps FROM s))"""
BODY = f"""x AS (SELECT doc_id, section, run, min(seq) AS seq, min(b) AS b, CASE WHEN min(type) = 'unnumbered_list' THEN '<para><randomList>' || string_agg('<listItem><para>' || {ESC.format('content')} || '</para></listItem>', '' ORDER BY seq) || '</randomList></para>'
  WHEN min(type) = 'header' THEN '<title>' || min({ESC.format('content')}) || '</title>' WHEN min(type) = 'warning' THEN '<warning><warningAndCautionPara>' || min({ESC.format('content')}) || '</warningAndCautionPara></warning>'
  WHEN min(type) = 'note' THEN '<note><notePara>' || min({ESC.format('content')}) || '</notePara></note>' ELSE '<para>' || min({ESC.format('content')}) || '</para>' END AS xml FROM r GROUP BY ALL),
y AS (SELECT doc_id, section, '<levelledPara>' || string_agg(xml, '' ORDER BY b, seq) || '</levelledPara>' AS xml FROM x GROUP BY ALL)"""


@query("x3_sections_xml", "paras", sql=f"WITH {PLACED}, {BODY} SELECT doc_id, section, xml FROM y")
def section_xml(paras: DataFrame) -> DataFrame:
    """X1 to X3 as whole texts: sections, their order, lists and safety texts."""
    return A.sections(elements(paras))


#: What a walk over the modules of these elements finds.
MODULE_ROWS = f"WITH {PLACED} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section, b, seq) AS idx, CASE type WHEN 'header' THEN 'heading' WHEN 'paragraph' THEN 'para' ELSE type END AS type, substring({D.squeeze('content')}, 1, 60) AS text_start, right({D.squeeze('content')}, 40) AS text_end FROM s"


@query("s16_module_rows", "paras", sql=MODULE_ROWS)
def module_rows(paras: DataFrame) -> DataFrame:
    """S16 on K1: assembled modules walked again, every element with its type and text."""
    return Mk.read_modules(A.modules(A.sections(elements(paras)))).select("doc_id", "idx", "type", "text_start", "text_end")


@query("k2_module_files", "paras", sql=MODULE_ROWS)
def module_files(paras: DataFrame) -> DataFrame:
    """Modules written as files of their own in the shared folder, read back by partitioned readers and walked."""
    spark = paras.sparkSession
    folder = f"{shared(spark)}/modules-{uuid4().hex}"
    made = A.modules(A.sections(elements(paras)))
    files.write(made.select(F.format_string("doc-%d.xml", "doc_id").alias("file"), F.col("xml").alias("content")), folder, spread=True)
    found = files.read(spark, folder, spread=True).select(F.regexp_extract("file", r"-(-?\d+)", 1).cast("bigint").alias("doc_id"), F.col("content").alias("xml"))
    return Mk.read_modules(found).select("doc_id", "idx", "type", "text_start", "text_end")


@query("x4_procedure_xml", "paras", sql=f"""WITH p AS (SELECT doc_id, para_idx, text, style = 'Heading 1' AS h, max(CASE WHEN style = 'Heading 1' THEN para_idx END) OVER (PARTITION BY doc_id ORDER BY para_idx) AS g, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS n FROM {{paras}}),
q AS (SELECT doc_id, para_idx, CASE WHEN h OR g IS NULL THEN para_idx ELSE g END AS top, '<proceduralStep id="stp-' || lpad(n::varchar, 5, '0') || '"><para>' || {ESC.format('text')} || '</para>' AS o FROM p),
r AS (SELECT doc_id, top, min(CASE WHEN top = para_idx THEN o END) || coalesce(string_agg(CASE WHEN top <> para_idx THEN o || '</proceduralStep>' END, '' ORDER BY para_idx), '') || '</proceduralStep>' AS x FROM q GROUP BY ALL)
SELECT doc_id, '<mainProcedure>' || string_agg(x, '' ORDER BY top) || '</mainProcedure>' AS xml FROM r GROUP BY doc_id""")
def procedure_xml(paras: DataFrame) -> DataFrame:
    """X4 as whole texts: nesting, ids in pre-order, order."""
    steps = S.step_parents(paras, F.col("style") == "Heading 1", seq="para_idx").select("doc_id", F.col("para_idx").alias("seq"), "parent_seq", "text")
    return A.procedure_xml(steps)


def _sql_list(items: str, outer: str, group: str, each: str, ids: str, none: str) -> str:
    row = f"""'<{each} id="{ids}-' || lpad((i - 1)::varchar, 4, '0') || '"><name>' || {ESC.format(f'{items}[i]')} || '</name><identNumber><manufacturerCode/></identNumber><reqQuantity>По требованию</reqQuantity></{each}>'"""
    return f"'<{outer}>' || CASE WHEN len({items}) > 0 THEN '<{group}>' || array_to_string(list_transform(range(1, len({items}) + 1), lambda i: {row}), '') || '</{group}>' ELSE '<{none}/>' END || '</{outer}>'"


def _sql_texts(items: str, outer: str, inner: str) -> str:
    return f"array_to_string(list_transform({items}, lambda x: '<{outer}><{inner}>' || {ESC.format('x')} || '</{inner}></{outer}>'), '')"


def _texts_where(test: str) -> str:
    return f"coalesce(list({T} ORDER BY para_idx) FILTER ({test}), [])"


SAFE = " || ".join(_sql_texts(a, t, p) for a, t, p in (("w", "warning", "warningAndCautionPara"), ("c", "caution", "warningAndCautionPara"), ("n", "note", "notePara")))


@query("x5_preliminary", "paras", sql=f"""SELECT doc_id, '<preliminaryRqmts><reqCondGroup><noConds/></reqCondGroup>' || {_sql_list('e', 'reqSupportEquips', 'supportEquipDescrGroup', 'supportEquipDescr', 'seq', 'noSupportEquips')} || {_sql_list('s', 'reqSupplies', 'supplyDescrGroup', 'supplyDescr', 'sup', 'noSupplies')}
  || '<reqSpares><noSpares/></reqSpares><reqSafety>' || CASE WHEN len(w) + len(c) + len(n) > 0 THEN '<safetyRqmts>' || {SAFE} || '</safetyRqmts>' ELSE '<noSafety/>' END || '</reqSafety></preliminaryRqmts>' AS xml
FROM (SELECT doc_id, {_texts_where("para_idx % 9 = 2")} AS e, {_texts_where("para_idx % 11 = 3")} AS s, {_texts_where("style = '07. Внимание для п.1'")} AS w, {_texts_where("kind = 'table'")} AS c, {_texts_where("style = '07. Примеч. для 1.2'")} AS n FROM {{paras}} GROUP BY doc_id)""")
def preliminary(paras: DataFrame) -> DataFrame:
    """Preliminary requirements with their marks for what is absent."""

    def texts(test: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("para_idx", P.pytrim("text").alias("t"))))), lambda x: x.t)

    tests = [F.col("para_idx") % 9 == 2, F.col("para_idx") % 11 == 3, F.col("style") == "07. Внимание для п.1", F.col("kind") == "table", F.col("style") == "07. Примеч. для 1.2"]
    df = paras.groupBy("doc_id").agg(*[texts(x).alias(f"_{i}") for i, x in enumerate(tests)])
    return df.select("doc_id", Cv.preliminary(*[F.col(f"_{i}") for i in range(5)]).alias("xml"))


@query("x9_identification", "dm_refs", sql=f"""SELECT pos, '<identAndStatusSection><dmAddress><dmIdent><dmCode modelIdentCode="S5" systemDiffCode="A" systemCode="' || system_code || '" subSystemCode="1" subSubSystemCode="2" assyCode="' || assy || '" disassyCode="00" disassyCodeVariant="A" infoCode="' || info_code || '" infoCodeVariant="A" itemLocationCode="A"/>'
  || '<language languageIsoCode="ru" countryIsoCode="RU"/><issueInfo issueNumber="001" inWork="00"/></dmIdent><dmAddressItems><issueDate year="2024" month="0' || (pos % 9 + 1) || '" day="05"/><dmTitle><techName>' || {ESC.format('tech_name')} || '</techName><infoName>' || {ESC.format('info_name')} || '</infoName></dmTitle></dmAddressItems></dmAddress>'
  || '<dmStatus issueType="new"><security securityClassification="01"/><logo><symbol infoEntityIdent="PUBLICATION_LOGO"/></logo><responsiblePartnerCompany enterpriseCode="00000"><enterpriseName>Организация не задана</enterpriseName></responsiblePartnerCompany><originator enterpriseCode="00000"><enterpriseName>Организация не задана</enterpriseName></originator>'
  || '<applic><displayText><simplePara>Все</simplePara></displayText></applic><techStandard><techPubBase>AECMA 1000D / AC 1.1.S1000DR-2007</techPubBase><authorityExceptions/><authorityNotes/></techStandard><brexDmRef><dmRef><dmRefIdent><dmCode modelIdentCode="S5" systemDiffCode="A" systemCode="00" subSystemCode="0" subSubSystemCode="0" assyCode="00" disassyCode="00" disassyCodeVariant="A" infoCode="022" infoCodeVariant="A" itemLocationCode="D"/></dmRefIdent></dmRef></brexDmRef>'
  || '<qualityAssurance><unverified/></qualityAssurance></dmStatus></identAndStatusSection>' AS xml FROM {{dm_refs}}""")
def identification(refs: DataFrame) -> DataFrame:
    """X9."""
    code = dict(zip(codes.PARTS, [F.lit("S5"), F.lit("A"), F.col("system_code"), F.lit("1"), F.lit("2"), F.col("assy"), F.lit("00"), F.lit("A"), F.col("info_code"), F.lit("A"), F.lit("A")]))
    day = F.make_date(F.lit(2024), (F.col("pos") % 9 + 1).cast("int"), F.lit(5))
    return refs.select("pos", Cv.identification(F.struct(*[v.alias(k) for k, v in code.items()]), F.col("tech_name"), F.col("info_name"), day).alias("xml"))


def heads(paras: DataFrame) -> DataFrame:
    """A head for every document; even ones are descriptive, odd ones procedures."""
    parts = dict(zip(codes.PARTS, ["S5", "A", "029", "1", "1", "00", "00", "A", "040", "A", "A"]))
    code = F.struct(*[(F.when(F.col("doc_id") % 2 == 0, v).otherwise("520") if k == "infoCode" else F.lit(v)).alias(k) for k, v in parts.items()])
    return paras.select("doc_id").distinct().select("doc_id", code.alias("dm_code"), F.concat(F.lit("Изделие "), F.col("doc_id").cast("string")).alias("tech_name"), F.lit("Описание").alias("info_name"), F.lit("2024-05-01").cast("date").alias("issued"), F.array(F.concat(F.lit("G-"), F.col("doc_id").cast("string"))).alias("graphics"))


@query("x10_modules", "paras", "left_elements")
def converted(paras: DataFrame, refs: DataFrame) -> DataFrame:
    """Paragraphs to module files, with reference markup."""
    return Cv.convert(paras, heads(paras), refs)[1]


@query("x1_descriptions", "paras")
def descriptions(paras: DataFrame) -> DataFrame:
    """Descriptions with tables and their titles, figures of several sheets, nested lists, cut paragraphs and warnings after content."""
    k = (F.col("doc_id") + F.col("para_idx")) % 14
    kinds = ["header", "paragraph", "unnumbered_list", "nested_unnumbered_list", "numbered_paragraph_header", "warning", "note", "illustration", "table", "caution", "numbered_list", "nested_numbered_list", "illustration_reference", "paragraph"]
    kind = F.when(F.col("para_idx") % 37 == 36, "title").otherwise(F.element_at(F.array(*map(F.lit, kinds)), (k + 1).cast("int")))
    words = F.split(F.col("text"), " ")
    cells = F.when((kind == "table") & (F.col("para_idx") % 2 == 0), F.array(F.slice(words, 1, 3), F.slice(words, 4, 2)))
    rows = paras.select("doc_id", F.col("para_idx").alias("seq"), kind.alias("type"), F.col("text").alias("content"), cells.alias("rows"), F.when(k == 13, F.array(F.lit(40), F.lit(12))).alias("splits"), F.when(k == 7, (F.col("para_idx") % 3).cast("int")).alias("sheets"), F.floor(F.col("para_idx") / 2).alias("ref_idx"), F.lit("GS5").alias("graphic_prefix"))
    return assembly.described(rows)


@query("j6_marked", "left_elements", "paras")
def marked(refs: DataFrame, paras: DataFrame) -> DataFrame:
    """J5 to J9 as one: every element with its type after the markup, by whom and in which phase."""
    kind = F.when(F.col("para_idx") % 13 == 5, "illustration").otherwise("paragraph")
    rows = refs.withColumn("type", F.when(F.col("idx") % 17 == 3, "_skip").when(F.col("idx") % 19 == 4, "_extra_pdf").otherwise(F.col("type")))
    return marking.marked(rows, paras.select("doc_id", F.col("para_idx").alias("seq"), kind.alias("type"), F.col("text").alias("content")))


@query("v4_verify", "paras", "left_elements")
def verified(paras: DataFrame, refs: DataFrame) -> DataFrame:
    """V4."""
    return Cv.verify(paras, heads(paras), refs)


@query("r3_pages", "paras")
def pages(paras: DataFrame) -> DataFrame:
    """Pages with sections, nested lists of both kinds, dash lists and tables with spans."""
    rows = paras.select("doc_id", F.col("para_idx").alias("pos"), "kind", "text", "style", "num_id", "ilvl")
    words = F.slice(F.split("text", " "), 1, 6)
    cells = paras.where("kind = 'table'").select("doc_id", F.col("para_idx").alias("pos"), F.posexplode(words).alias("n", "text"))
    # Six places in two rows; the first cell takes two of them.
    cells = cells.select("doc_id", "pos", F.greatest(F.col("n") - 1, F.lit(0)).alias("cell"), F.floor(F.col("n") / 3).alias("row_no"), (F.col("n") % 3).alias("col_no"), "text")
    numbers = paras.where("num_id IS NOT NULL").select("doc_id", "num_id", "ilvl", (F.col("num_id") % 2 == 0).alias("ordered")).distinct()
    return rendering.rendered(rows, cells, numbers)


@query("r3_document_html", "paras", sql=f"""SELECT doc_id, coalesce(string_agg(CASE WHEN t = '' THEN NULL WHEN kind = 'table' THEN '<table><tr><td>' || t || '</td></tr></table>' WHEN style = 'Heading 1' THEN '<h1>' || t || '</h1>' ELSE '<p>' || t || '</p>' END, '' ORDER BY para_idx), '') AS html
FROM (SELECT *, {ESC.format(T)} AS t FROM {{paras}}) GROUP BY doc_id""")
def document_html(paras: DataFrame) -> DataFrame:
    """R3."""
    return Cv.document_html(paras)


@query("s18_document_blocks", "paras", sql=f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS anno_idx, CASE WHEN kind = 'table' THEN 'table' WHEN style = 'Heading 1' THEN 'h1' ELSE 'p' END AS tag, CASE WHEN kind = 'table' THEN 'table' WHEN style = 'Heading 1' THEN 'heading' ELSE 'para' END AS anno_type FROM {{paras}} WHERE {T} <> ''""")
def document_blocks(paras: DataFrame) -> DataFrame:
    """A document as HTML, its blocks numbered and typed."""
    df = Cv.document_html(paras).select("doc_id", F.explode(Mk.annotate_blocks("html")).alias("_a"))
    return df.select("doc_id", "_a.anno_idx", "_a.tag", "_a.anno_type")


@query("r4_module_html", "paras", sql=f"""WITH {PLACED}, g AS (SELECT doc_id, section, run, min(seq) AS seq, min(b) AS b, min(type) AS type, list({ESC.format('content')} ORDER BY seq) AS ts FROM r GROUP BY doc_id, section, run),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, b, seq) AS n, dense_rank() OVER (PARTITION BY doc_id ORDER BY section) AS sec, row_number() OVER (PARTITION BY doc_id, section ORDER BY b, seq) AS k, min(b) OVER (PARTITION BY doc_id, section) AS lead FROM g),
m AS (SELECT *, CASE WHEN type = 'header' OR (k = 1 AND type = 'paragraph' AND lead > 0) THEN '<h2 data-anno-idx="' || n || '" data-anno-type="heading" data-section-id="s1000d-sec-' || sec || '">' || ts[1] || '</h2>'
  WHEN type = 'unnumbered_list' THEN '<ul class="random-list" data-anno-idx="' || n || '" data-anno-type="unnumbered_list">' || array_to_string(list_transform(ts, lambda x: '<li>' || x || '</li>'), '') || '</ul>'
  WHEN type IN ('warning', 'note') THEN '<div class="' || type || '" data-anno-idx="' || n || '" data-anno-type="' || type || '"><p>' || ts[1] || '</p></div>' ELSE '<p data-anno-idx="' || n || '" data-anno-type="para">' || ts[1] || '</p>' END AS x FROM h),
o AS (SELECT doc_id, sec, '<div class="levelled-para level-2" data-section-id="s1000d-sec-' || sec || '">' || string_agg(x, '' ORDER BY n) || '</div>' AS x FROM m GROUP BY doc_id, sec)
SELECT doc_id, '<div class="s1000d-content">' || string_agg(x, '<div class="page-spacer"></div>' ORDER BY sec) || '</div>' AS html FROM o GROUP BY doc_id""")
def module_html(paras: DataFrame) -> DataFrame:
    """R4 on K1."""
    return Cv.module_html(A.modules(A.sections(elements(paras))))


@query("p8_loose_list", "paras", sql=f"""SELECT doc_id, para_idx, CASE WHEN {D.starts_any('text', rules.LIST_MARKERS)} OR ends_with(t, ';') OR ends_with(t, '.') OR c THEN 'unnumbered_list' END AS type FROM (SELECT doc_id, para_idx, text, t,
  coalesce(max(CASE WHEN ends_with(t, ':') THEN para_idx END) OVER w > coalesce(max(CASE WHEN t = '' THEN para_idx END) OVER w, -1), false) AND t <> '' AND NOT ends_with(t, ':') AS c FROM (SELECT doc_id, para_idx, text, {T} AS t FROM {{paras}}) WINDOW w AS (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def loose_list(paras: DataFrame) -> DataFrame:
    return S.after_colon(paras, seq="para_idx").select("doc_id", "para_idx", P.loose_list("text", "in_colon_list").alias("type"))


@query("p50_refreshable", "dm_refs", sql="SELECT DISTINCT dmc, s AS source FROM (SELECT dmc, CASE pos % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'auto_hybrid' WHEN 2 THEN 'xml_derived' ELSE 'manual' END AS s FROM {dm_refs}) WHERE s IN ('auto', 'auto_hybrid') AND dmc IN (SELECT dmc FROM {dm_refs} WHERE pos % 5 <> 0)")
def refreshable(refs: DataFrame) -> DataFrame:
    source = F.element_at(F.array(*[F.lit(x) for x in ("auto", "auto_hybrid", "xml_derived", "manual")]), (F.col("pos") % 4 + 1).cast("int"))
    return Cv.refreshable(refs.select("dmc", source.alias("source")).distinct(), refs.where("pos % 5 <> 0"))


@query("p52_work_name", "paras", sql=rf"SELECT doc_id, para_idx, {D.trim(r'''regexp_extract(CASE para_idx % 3 WHEN 0 THEN 'Карта Наименование работы  ' || text || ' Трудоемкость 3' WHEN 1 THEN 'наименование' || chr(10) || 'работы ' || text || chr(10) || 'ещё' ELSE text END, '(?s)[Нн]аименование\s+работы\s*(.+?)(?:[Тт]рудо[её]мкость|$)', 1)''')} AS name FROM {{paras}}")
def work_name(paras: DataFrame) -> DataFrame:
    k = F.col("para_idx") % 3
    text = F.when(k == 0, F.concat(F.lit("Карта Наименование работы  "), "text", F.lit(" Трудоемкость 3"))).when(k == 1, F.concat(F.lit("наименование\nработы "), "text", F.lit("\nещё"))).otherwise(F.col("text"))
    return paras.select("doc_id", "para_idx", imp.work_name(text).alias("name"))


@query("k8_placeholders", "figures", sql="SELECT DISTINCT file, 4 AS bytes FROM (SELECT 'G' || (seq % 40) || '.jpg' AS file FROM {figures} WHERE type = 'illustration') WHERE file NOT IN (SELECT 'G' || (seq % 40) || '.jpg' FROM {figures} WHERE seq % 7 = 0)")
def placeholders(figures: DataFrame) -> DataFrame:
    name = F.concat(F.lit("G"), (F.col("seq") % 40).cast("string"), F.lit(".jpg")).alias("file")
    return Cv.placeholders(figures.where("type = 'illustration'").select(name), figures.where("seq % 7 = 0").select(name), b"\xff\xd8\xff\xd9").select("file", F.octet_length("image").alias("bytes"))


@query("k10_cache", "typed", sql="WITH old AS (SELECT DISTINCT seq % 50 AS key, 'paragraph' AS type, 0.5::double AS confidence FROM {typed}), new AS (SELECT seq % 60 AS key, arg_min(type, type) AS type, 0.9::double AS confidence FROM {typed} WHERE seq % 3 = 0 GROUP BY ALL) SELECT key::varchar AS key, type, confidence FROM old WHERE key NOT IN (SELECT key FROM new) UNION ALL SELECT key::varchar, type, confidence FROM new")
def cache(typed: DataFrame) -> DataFrame:
    old = typed.select((F.col("seq") % 50).cast("string").alias("key"), F.lit("paragraph").alias("type"), F.lit(0.5).alias("confidence")).distinct()
    return votes.remember(old, typed.where("seq % 3 = 0").select((F.col("seq") % 60).cast("string").alias("key"), "type", F.lit(0.9).alias("confidence")))


@query("a19_stats", "typed", sql="SELECT false AS llm_enabled, false AS llm_available, count(DISTINCT seq) AS cache_size, 0.7::double AS confidence_threshold FROM {typed}")
def stats(typed: DataFrame) -> DataFrame:
    return votes.stats(typed.select("seq").distinct())


@query("k4_sidecar_json", "left_elements", sql="""SELECT doc_id, to_json({'element_map': list({'seq': idx, 'stable_id': stable_id, 'type': type, 'text_start': text_start} ORDER BY idx)})::varchar AS json FROM {left_elements} GROUP BY doc_id""")
def sidecar_json(left: DataFrame) -> DataFrame:
    """K4 as whole texts."""
    return A.sidecar_json(left.withColumnRenamed("idx", "seq"))


@query("f12_loud_titles", "paras", sql=rf"""SELECT doc_id, para_idx, CASE WHEN length(t) > 5 THEN upper(left(t, 1)) || substring(lower(t), 2) ELSE t END AS title FROM (SELECT doc_id, para_idx, {D.squeeze(D.trim(r"regexp_replace(upper(replace(text, 'ß', 's')), '[^\p{Lu} ]', '', 'g')"))} AS t FROM {{paras}}) WHERE t <> ''""")
def loud_titles(paras: DataFrame) -> DataFrame:
    """F12 on titles in capitals, which get sentence case."""
    from docloom.functions import text as X

    loud = X.squeeze(P.pytrim(F.regexp_replace(F.upper(F.replace("text", F.lit("ß"), F.lit("s"))), r"[^\p{Lu} ]", "")))
    return paras.select("doc_id", "para_idx", loud.alias("_t")).where("_t <> ''").select("doc_id", "para_idx", X.clean_title("_t").alias("title"))
