"""Queries of row predicates and scalar functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import codes, predicates as P, rules, text as X
from docloom.plans import duck as D
from docloom.plans.registry import query

KEY = "doc_id, para_idx"
Q = "{paras}"


def on_paras(name: str, sql: str, made: Callable[[], dict[str, Column]]) -> None:
    """A query that adds columns to the keys of paragraphs. The columns are made when it runs, so that importing needs no session."""

    def run(paras: DataFrame) -> DataFrame:
        return paras.select("doc_id", "para_idx", *[c.alias(k) for k, c in made().items()])

    query(name, "paras", sql=f"SELECT {KEY}, {sql} FROM {Q}")(run)


t = "text"
on_paras("p1_main_header", f"{D.main_header('text')} AS hit", lambda: dict(hit=P.main_header(t)))
on_paras("p2_numbered_item", f"{D.numbered_item('text')} AS hit", lambda: dict(hit=P.numbered_item(t)))
on_paras("p3_likely_by_text", f"{D.likely('text')} AS hit", lambda: dict(hit=P.likely_by_text(t)))
on_paras("p10_list_level", "coalesce(ilvl, nullif(left_indent, 0), nullif(style_indent, 0), 0) AS level", lambda: dict(level=F.coalesce("ilvl", F.nullif(F.col("left_indent"), F.lit(0)), F.nullif(F.col("style_indent"), F.lit(0)), F.lit(0)).cast("bigint")))
on_paras("p11_warning", f"{D.has('text', D.word(rules.WARNING_WORDS))} AS hit", lambda: dict(hit=P.is_warning(t)))
on_paras("p12_styles", f"{D.has('style', '(?i)вниман')} AS warning, {D.has('style', '(?i)примеч|замеч')} AS note", lambda: dict(warning=P.warning_style("style"), note=P.note_style("style")))
on_paras("p13_note", f"{D.has('text', rf'(?i)^{D.WS}*примечани[ея]([.:–-]|{D.WS})')} AS hit", lambda: dict(hit=P.is_note(t)))
on_paras("p14_item_style", r"CASE WHEN regexp_matches(style, '(?i)ПУНКТ\s+\d') THEN len(string_split(regexp_extract(style, '(?i)ПУНКТ\s+(\d+(?:\.\d+)*)', 1), '.'))::bigint END AS level", lambda: dict(level=P.item_style_level("style").cast("bigint")))
on_paras("p40_page_footer", f"({D.has('text', r'Стр[.]' + D.WS + '*[0-9]')} AND length(text) < 200) OR {D.has(D.trim('text'), '^[0-9]{1,4}$')} AS hit", lambda: dict(hit=P.page_footer(t)))
on_paras("p42_list_start", f"{D.has(D.trim('text'), rf'^(?:[-–—−•●○‣▪▫⁃]|[0-9]+[.)]{D.WS}|[0-9]+(?:[.][0-9]+)+{D.WS})')} AS hit", lambda: dict(hit=P.list_start(t)))
on_paras("p47_section_number", rf"CASE WHEN {D.has('text', rf'^{D.WS}*\d+(?:\.\d+)*\.?{D.WS}+')} AND coalesce({D.upper_share(D.sub('text', rf'^{D.WS}*\d+(?:\.\d+)*\.?{D.WS}+'))}, 1.0) >= 0.7 THEN regexp_extract(text, '^{D.WS}*(\d+(?:\.\d+)*)\.?{D.WS}+', 1) END AS num", lambda: dict(num=P.section_number(t)))
on_paras("p38_content_item", f"({D.has(D.trim('text'), rf'^[-–—−•●○‣▪▫⁃]{D.WS}+')} OR (ends_with({D.trim('text')}, ';') AND length({D.trim('text')}) < 120)) AS hit", lambda: dict(hit=P.content_item(F.lit("paragraph"), t)))
on_paras("p37_imperative", f"(lower(regexp_extract(text, '^{D.WS}*([^ ]+)', 1)) IN ('снимите', 'проверьте')) AS hit", lambda: dict(hit=P.imperative(t)))
on_paras("p43_font_class", f"CASE WHEN para_idx % 7 * 5 > 12 * 1.3 THEN 'header' WHEN {D.has(D.trim('text'), rf'^(?:[-–—−•●○]|[0-9]+[.)]{D.WS})')} THEN 'unnumbered_list' ELSE 'paragraph' END AS type", lambda: dict(type=P.font_class(F.col("para_idx") % 7 * 5, t, F.lit(12))))
on_paras("p44_context_factor", f"CASE WHEN {D.any_of('lower(text)', P.SAFETY_WORDS)} THEN 1.0::double ELSE 0.1::double END AS factor", lambda: dict(factor=P.context_factor(F.lit("note"), t, F.lit(""))))
on_paras("p41_service_block", f"(length({D.trim('text')}) <= 2 OR {D.has(D.trim('text'), '(?i)^(?:Контр|чел[.])')}) AS hit", lambda: dict(hit=P.service_block(t)))
on_paras("f6_norm_text", f"{D.norm_text('text')} AS norm", lambda: dict(norm=X.norm_text(t)))
on_paras("f8_norm_procedure", rf"{D.sub(D.sub(D.squeeze('lower(' + D.trim('text') + ')'), r'^(?:[\d.]+\s+)+'), r'^[-–—•]\s*')} AS norm", lambda: dict(norm=X.norm_procedure(t)))
on_paras("f10_forms", rf"substring({D.sub('lower(text)', r'[^\p{L}\p{N}]+')}, 1, 80) AS heavy, substring({D.squeeze('lower(' + D.trim('text') + ')')}, 1, 80) AS light", lambda: dict(heavy=X.heavy_form(t), light=X.light_form(t)))
on_paras("f11_norm_name", rf"{D.sub(D.squeeze('lower(' + D.trim('text') + ')'), r'\.+$')} AS norm", lambda: dict(norm=X.norm_name(t)))
on_paras("f14_clean_item", f"{D.trim(D.sub(D.trim('text'), '^[•◦▪▫⁃·–—*†‡§-]'))} AS bullet, {D.trim(D.sub(D.trim('text'), r'^\d+(?:\.|\)|\s+[.)])\s*'))} AS num", lambda: dict(bullet=X.clean_item(t, F.lit("unnumbered_list")), num=F.when(X.like(X.pytrim(t), r"^\d+(?:\.|\)|\s+[.)])"), X.clean_item(t, F.lit("numbered_list"))).otherwise(X.pytrim(t))))
on_paras("f15_safety_text", rf"{D.trim(D.sub(D.trim('text'), '(?i)^(?:ВНИМАНИЕ|ОСТОРОЖНО|ПРЕДУПРЕЖДЕНИЕ)[!:]?'))} AS safety, {D.trim('regexp_extract(text, ' + chr(39) + r'(?s)^[Пп]римечани[ея]\s*[.:–-]\s*(.+)' + chr(39) + ', 1)')} AS note", lambda: dict(safety=X.clean_safety(t), note=X.note_body(t)))
on_paras("f16_sanitize", f"{D.trim(D.sub('text', '[<>:\"/|?*' + chr(92) + chr(92) + r'\x00-\x1f]'))} AS name", lambda: dict(name=X.sanitize(t)))
on_paras("f19_ids", f"""substring(sha256(para_idx::varchar || '|' || style || '|' || lower({D.head('text', 80)})), 1, 12) AS stable_id,
  substring(sha256(ilvl_or::varchar || '|' || (round_even(para_idx * 5.0, -1))::int::varchar || '|' || lower({D.head('text', 30)})), 1, 12) AS element_id,
  substring(md5(para_idx::varchar || '|' || style || '|' || substring(text, 1, 60)), 1, 12) AS procedure_id""".replace("ilvl_or", "coalesce(ilvl, 0)"), lambda: dict(stable_id=X.stable_id("para_idx", "style", "text"), element_id=X.element_id(F.coalesce("ilvl", F.lit(0)), F.col("para_idx") * F.lit(5.0), "text"), procedure_id=X.procedure_id("para_idx", "style", "text")))  # fmt: skip
on_paras("f20_snippets", "substring(text, 1, 60) AS text_start, right(text, 40) AS text_end, CASE WHEN length(text) > 40 THEN right(text, 40) ELSE '' END AS procedure_end", lambda: dict(text_start=F.substring("text", 1, 60), text_end=F.right("text", F.lit(40)), procedure_end=F.when(F.length("text") > 40, F.right("text", F.lit(40))).otherwise("")))
on_paras("f21_local_tag", "list_extract(string_split('{urn:x}' || style, '}'), -1) AS tag", lambda: dict(tag=X.local_tag(F.concat(F.lit("{urn:x}"), "style"))))
on_paras("f24_figure_numbers", r"array_to_string(regexp_extract_all(text, '(?i)(?:рисунок|рис\.|figure)\s*(\d+)', 1), ',') AS numbers", lambda: dict(numbers=F.array_join(F.regexp_extract_all("text", F.lit(r"(?iuU)(?:рисунок|рис\.|figure)\s*(\d+)"), F.lit(1)), ",")))
on_paras("f1_prefix_score", f"round_even({D.prefix_score('style', 'text')}, 6) AS score, round_even({D.prefix_score('substring(text, 1, 50)', 'text')}, 6) AS own", lambda: dict(score=F.bround(X.prefix_score("style", "text"), 6), own=F.bround(X.prefix_score(F.substring("text", 1, 50), "text"), 6)))
on_paras("f7_norm_match_spaced", f"CASE WHEN text LIKE '  П р и%' THEN starts_with({D.squeeze('lower(text)')}, ' п р и м е ч а н и е') END AS closed", lambda: dict(closed=F.when(F.col(t).like("  П р и%"), X.norm_match(t).startswith("примечание:"))))


@query("f2_combined_score", "left_elements", "right_elements", sql=f"""SELECT l.doc_id, l.idx, round_even(CASE WHEN {D.trim('coalesce(r.text_end, chr(32))')} = '' THEN {D.prefix_score('r.text_start', D.head('l.text_start'))} ELSE 0.7 * {D.prefix_score('r.text_start', D.head('l.text_start'))} + 0.3 * {D.prefix_score('r.text_end', D.tail('l.text_start'))} END, 6) AS score FROM {{left_elements}} l JOIN {{right_elements}} r ON l.doc_id = r.doc_id AND l.idx = r.idx""")
def combined(left: DataFrame, right: DataFrame) -> DataFrame:
    """F2 of the elements at equal positions."""
    l, r = left.alias("l"), right.alias("r")
    score = X.combined_score("r.text_start", "r.text_end", "l.text_start")
    return l.join(r, ["doc_id", "idx"]).select("doc_id", "idx", F.bround(score, 6).alias("score"))


@query("f3_prefix_score_no_floor", "left_elements", "right_elements", sql=f"SELECT l.doc_id, l.idx, round_even({D.prefix_score('r.text_start', 'l.text_start', 0)}, 6) AS score FROM {{left_elements}} l JOIN {{right_elements}} r ON l.doc_id = r.doc_id AND l.idx = r.idx")
def no_floor(left: DataFrame, right: DataFrame) -> DataFrame:
    score = X.prefix_score("r.text_start", "l.text_start", floor=0)
    return left.alias("l").join(right.alias("r"), ["doc_id", "idx"]).select("doc_id", "idx", F.bround(score, 6).alias("score"))


def _kinds() -> str:
    parts = []
    for k, p in P.REFERENCES:
        pattern = p.replace(r"\b", "", 1) if p.startswith(r"\b") else p
        pattern = pattern.replace(r".*?\b", ".*?(?:[^0-9A-Za-z_]|$)")
        lead = r"(?:^|[^\p{L}\p{N}_])" if p.startswith(r"\b") else ""
        parts.append(f"list_transform(regexp_extract_all(text, '(?i){lead}{pattern}', 1), lambda n: '{k}:' || n)")
    return "list_concat(" * (len(parts) - 1) + parts[0] + "".join(f", {p})" for p in parts[1:])


@query("p15_references", "paras", sql=f"SELECT doc_id, para_idx, array_to_string({_kinds()}, ',') AS refs FROM {{paras}}")
def references(paras: DataFrame) -> DataFrame:
    refs = F.array_join(F.transform(P.references("text"), lambda r: F.concat(r.kind, F.lit(":"), r.number)), ",")
    return paras.select("doc_id", "para_idx", refs.alias("refs"))


@query("p45_types", "left_elements", "right_elements", sql=f"SELECT l.doc_id, l.idx, {D.type_class('l.type')} AS class, ({D.type_class('l.type')} = {D.type_class('r.type')} OR ({D.type_class('l.type')} IN ('list', 'heading') AND {D.type_class('r.type')} IN ('list', 'heading'))) AS compatible FROM {{left_elements}} l JOIN {{right_elements}} r ON l.doc_id = r.doc_id AND l.idx = r.idx")
def types(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.alias("l").join(right.alias("r"), ["doc_id", "idx"]).select("doc_id", "idx", P.type_class("l.type").alias("class"), P.types_compatible("l.type", "r.type").alias("compatible"))


@query("p46_sentinels", "left_elements", sql="SELECT doc_id, idx, type FROM (SELECT doc_id, idx, CASE idx % 9 WHEN 1 THEN '_skip' WHEN 2 THEN '_extra_pdf' ELSE type END AS type FROM {left_elements}) WHERE type NOT IN ('_skip', '_extra_pdf', '_unmatched_xml')")
def sentinels(left: DataFrame) -> DataFrame:
    marked = F.when(F.col("idx") % 9 == 1, "_skip").when(F.col("idx") % 9 == 2, "_extra_pdf").otherwise(F.col("type"))
    return left.select("doc_id", "idx", marked.alias("type")).where(~F.col("type").isin(rules.SENTINELS))


@query("p49_inside", "blocks", sql="SELECT doc_id, blk_seq FROM {blocks} WHERE (x0 + x1) / 2 BETWEEN 60 AND 200 AND (y0 + y1) / 2 BETWEEN 100 AND 500")
def inside(blocks: DataFrame) -> DataFrame:
    rect = F.struct(F.lit(60.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(500.0).alias("y1"))
    return blocks.where(P.inside(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), rect)).select("doc_id", "blk_seq")


# -- coded names -------------------------------------------------------------------------------------------------------------

NAMES = "['" + "', '".join([*codes.PARTS, "title"]) + "']"
PARSED = rf"SELECT *, CASE WHEN regexp_matches(folder_name, '{codes.CODE}') THEN regexp_extract(folder_name, '{codes.CODE}', {NAMES}) END AS c FROM {{folders}}"


@query("m0_folder_kinds", "folders", sql=f"""SELECT c.systemCode AS system, c.subSystemCode || c.subSubSystemCode AS subsystem, CASE WHEN c IS NULL THEN 'unparsed' WHEN c.infoCode::int < 100 THEN 'descriptive' ELSE 'procedure' END AS kind,
  CASE WHEN c IS NULL THEN 'name' WHEN NOT has_docx AND NOT has_doc THEN 'no document' END AS skip_reason, count(*) AS n FROM ({PARSED}) GROUP BY ALL""")
def folder_kinds(folders: DataFrame) -> DataFrame:
    """Coded folders by system, kind of module and reason to skip: the flagship query."""
    folders, code = codes.with_code(folders, "folder_name"), F.col("dm_code")
    kind = F.when(code.isNull(), "unparsed").when(codes.is_descriptive(code.infoCode), "descriptive").otherwise("procedure")
    skip = F.when(code.isNull(), "name").when(~F.col("has_docx") & ~F.col("has_doc"), "no document")
    df = folders.select(code.systemCode.alias("system"), F.concat(code.subSystemCode, code.subSubSystemCode).alias("subsystem"), kind.alias("kind"), skip.alias("skip_reason"))
    return df.groupBy("system", "subsystem", "kind", "skip_reason").agg(F.count("*").alias("n"))


@query("p29_parse_code", "folders", sql=f"SELECT folder_seq, {', '.join(f'c.{p} AS {p}' for p in codes.PARTS)}, {D.trim('c.title')} AS title FROM ({PARSED})")
def parse_code(folders: DataFrame) -> DataFrame:
    df = codes.with_code(folders, "folder_name")
    return df.select("folder_seq", *[F.col(f"dm_code.{p}") for p in codes.PARTS], F.col("dm_title").alias("title"))


@query("p30_title_parts", "folders", sql=rf"SELECT folder_seq, {D.trim(chr(39) * 2 + ' || regexp_extract(t, ' + chr(39) + '^(.*?)(?:[.]' + D.WS + '+(.*))?$' + chr(39) + ', 1)')} AS tech_name, {D.trim('regexp_extract(t, ' + chr(39) + '^(.*?)(?:[.]' + D.WS + '+(.*))?$' + chr(39) + ', 2)')} AS info_name FROM (SELECT folder_seq, {D.trim('c.title')} AS t FROM ({PARSED})) WHERE t IS NOT NULL")
def split_titles(folders: DataFrame) -> DataFrame:
    parts = codes.title_parts("dm_title")
    return codes.with_code(folders, "folder_name").select("folder_seq", parts.tech_name.alias("tech_name"), parts.info_name.alias("info_name")).where("tech_name IS NOT NULL")


@query("p31_module_kind", "folders", sql=f"SELECT folder_seq, coalesce(c.infoCode::int BETWEEN 0 AND 99, false) AS descriptive, coalesce(c.infoCode::int >= 100, false) AS procedure FROM ({PARSED})")
def module_kind(folders: DataFrame) -> DataFrame:
    folders, code = codes.with_code(folders, "folder_name"), F.col("dm_code.infoCode")
    return folders.select("folder_seq", codes.is_descriptive(code).alias("descriptive"), codes.is_procedure(code).alias("procedure"))


@query("p35_folder_dmc", "folders", sql=r"SELECT folder_seq, nullif(regexp_extract(folder_name, '\[([A-Z0-9]+-[A-Z]-\d{2,3}-\d{2}-\d{2}-\d{2}[A-Z]-\d{3}[A-Z]-[A-Z])\]', 1), '') AS dmc FROM {folders}")
def folder_dmc(folders: DataFrame) -> DataFrame:
    return folders.select("folder_seq", codes.folder_dmc("folder_name").alias("dmc"))


@query("f17_code_strings", "folders", sql=f"""SELECT folder_seq, 'DMC-' || c.modelIdentCode || '-' || c.systemDiffCode || '-' || c.systemCode || '-' || c.subSystemCode || c.subSubSystemCode || '-' || c.assyCode || '-' || c.disassyCode || c.disassyCodeVariant || '-' || c.infoCode || c.infoCodeVariant || '-' || c.itemLocationCode || '_001' AS dmc,
  'G' || c.modelIdentCode || '-' || c.systemDiffCode || '-' || c.systemCode || '-' || c.subSystemCode || c.subSubSystemCode || '-' || c.assyCode || '-' || c.disassyCode || c.disassyCodeVariant || '-' || c.infoCode || c.infoCodeVariant || '-' || c.itemLocationCode || '_001_RU-RU' AS graphic FROM ({PARSED}) WHERE c IS NOT NULL""")
def code_strings(folders: DataFrame) -> DataFrame:
    df = codes.with_code(folders, "folder_name").select("folder_seq", F.col("dm_code").alias("c")).where("c IS NOT NULL")
    return df.select("folder_seq", codes.code_string(F.col("c")).alias("dmc"), codes.graphic_prefix(F.col("c")).alias("graphic"))


@query("f18_folder_names", "folders", sql=f"SELECT folder_seq, CASE WHEN contains(subsystem_group, ' - ') THEN {D.trim('regexp_replace(subsystem_group, ' + chr(39) + '^.*? - ' + chr(39) + ', ' + chr(39) * 2 + ')')} ELSE '' END AS l1_name, {D.trim('regexp_extract(folder_name, ' + chr(39) + chr(92) + ']' + D.WS + '*(.+)$' + chr(39) + ', 1)')} AS l2_title FROM {{folders}}")
def folder_names(folders: DataFrame) -> DataFrame:
    """names after ' - ' of group folders ('' without it) and titles after the code."""
    l1 = F.coalesce(X.pytrim(F.get(F.split("subsystem_group", " - ", 2), F.lit(1))), F.lit(""))
    return folders.select("folder_seq", l1.alias("l1_name"), X.pytrim(F.regexp_extract("folder_name", r"(?U)\]\s*(.+)$", 1)).alias("l2_title"))


@query("p34_self_describing", "raw_docs", sql=f"SELECT seq, {D.any_of('lower(title)', rules.SELF_DESCRIBING)} AS hit FROM {{raw_docs}}")
def self_describing(raw: DataFrame) -> DataFrame:
    return raw.select("seq", codes.self_describing("title").alias("hit"))


RULES_SQL = "(VALUES " + ", ".join(f"({n}, {req}, {exc if exc else '[]::varchar[]'}, '{c}', '{v}', {p})" for n, (req, exc, c, v, p) in enumerate(rules.INFO_CODE_RULES)) + ") AS r(n, req, exc, code, variant, pri)"
MATCHED = f"""SELECT d.*, m.code, m.variant FROM {{raw_docs}} d LEFT JOIN (SELECT seq, arg_max(code, pri * 100 - n) AS code, arg_max(variant, pri * 100 - n) AS variant FROM {{raw_docs}}, {RULES_SQL}
  WHERE len(list_filter(req, lambda w: NOT contains(lower(title), w))) = 0 AND len(list_filter(exc, lambda w: contains(lower(title), w))) = 0 GROUP BY seq) m USING (seq)"""


@query("p32_info_code", "raw_docs", sql=f"SELECT seq, code, variant FROM ({MATCHED})")
def info_code(raw: DataFrame) -> DataFrame:
    return codes.info_code(raw).select("seq", "code", "variant")


@query("p33_override", "raw_docs", sql=f"SELECT seq, CASE WHEN sys = '029' AND sub = '30' AND comp = '05' AND coalesce(code, '040') = '040' THEN '042' WHEN sys = '029' AND sub = '12' AND comp = '02' AND code = '920' THEN '922' WHEN sys = '029' AND sub = '30' AND code = '341' THEN '320' ELSE coalesce(code, '040') END AS code FROM ({MATCHED})")
def overrides(raw: DataFrame) -> DataFrame:
    df = codes.info_code(raw)
    return df.select("seq", codes.override("sys", "sub", "comp", F.coalesce("code", F.lit("040"))).alias("code"))


@query("f25_multi_sheet", "figures", sql=r"""SELECT doc_id, figure_number, len(sheets)::bigint AS sheet_count, array_to_string(sheets, ',') AS sheets, content FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, figure_number ORDER BY seq) AS rn FROM (
    SELECT doc_id, seq, content, regexp_extract(content, '(?i)рисунок\s*(\d+)\s*[–-]\s*.', 1)::bigint AS figure_number, regexp_extract_all(content, '(?i)лист\s*(\d+)', 1) AS sheets
    FROM {figures} WHERE regexp_matches(content, '(?i)рисунок\s*\d+\s*[–-]\s*.')) WHERE len(sheets) > 1) WHERE rn = 1""")
def multi_sheet(figures: DataFrame) -> DataFrame:
    from docloom.operators.figures import multi_sheet_figures

    return multi_sheet_figures(figures).select("doc_id", "figure_number", "sheet_count", F.array_join(F.col("sheets").cast("array<string>"), ",").alias("sheets"), "content")
