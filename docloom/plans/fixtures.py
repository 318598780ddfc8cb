"""Derived tables: documents, parts and line items decorated by arithmetic so that they exercise the document operators."""

from docloom.plans.registry import DERIVED, SPELLED

SPELLED["doc_lines"] = (
    r"SELECT doc_id, CAST(pos AS bigint) AS para_idx, col AS line FROM (SELECT doc_id, posexplode(split(text, '\n', -1)) FROM {documents})",
    "SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS bigint) AS para_idx, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)",
)

#: Paragraphs: each line decorated by k = (doc_id + para_idx) % 14.
DERIVED["paras"] = """
SELECT doc_id, para_idx, CASE WHEN (doc_id + para_idx) % 29 = 5 THEN 'table' ELSE 'p' END AS kind,
  CASE (doc_id + para_idx) % 14
    WHEN 0 THEN CAST(para_idx % 9 + 1 AS string) || ' ОБЩИЕ СВЕДЕНИЯ ' || CAST(doc_id % 7 AS string)
    WHEN 1 THEN '1.' || CAST(para_idx % 5 + 1 AS string) || ' ' || line
    WHEN 2 THEN '• ' || line
    WHEN 3 THEN substring(line, 1, 80) || ';'
    WHEN 4 THEN substring(line, 1, 80) || ':'
    WHEN 5 THEN 'Внимание! ' || line
    WHEN 6 THEN 'Примечание: ' || line
    WHEN 7 THEN 'Рисунок ' || CAST(para_idx % 4 + 1 AS string) || ' – ' || substring(line, 1, 50)
    WHEN 8 THEN 'См. таблица ' || CAST(para_idx % 6 + 1 AS string) || ', рис. ' || CAST(doc_id % 5 AS string) || ' ' || line
    WHEN 9 THEN ''
    WHEN 10 THEN '- ' || line
    WHEN 11 THEN '2) ' || line || ';'
    WHEN 12 THEN '  П р и м е ч а н и е : ' || substring(line, 1, 30) || '  '
    ELSE line END AS text,
  CASE (doc_id + para_idx) % 14 WHEN 0 THEN 'Heading 1' WHEN 1 THEN '08. ПУНКТ 1.2' WHEN 4 THEN '16. пункт 1.2.3' WHEN 5 THEN '07. Внимание для п.1' WHEN 6 THEN '07. Примеч. для 1.2' WHEN 13 THEN '01. ПУНКТ 1' ELSE 'Normal' END AS style,
  CASE WHEN (doc_id + para_idx) % 14 IN (0, 2, 3) THEN CAST(doc_id % 3 + 1 AS bigint) END AS num_id,
  CASE WHEN (doc_id + para_idx) % 14 IN (0, 2, 3) THEN CAST(para_idx % 3 AS bigint) END AS ilvl,
  CAST(CASE WHEN para_idx % 4 = 3 THEN 539750 ELSE (para_idx % 4) * 1000 END AS bigint) AS left_indent,
  CAST((doc_id % 2) * 360000 AS bigint) AS style_indent,
  (doc_id + para_idx) % 28 = 7 AS has_image
FROM {doc_lines}"""

#: Coded folder names; every tenth is malformed.
DERIVED["folders"] = """
SELECT CAST(l_orderkey * 10 + l_linenumber AS bigint) AS folder_seq,
  CASE WHEN (l_orderkey + l_linenumber) % 10 = 0 THEN 'Папка ' || p_name ELSE
    '[S5-A-' || lpad(CAST(l_suppkey % 40 AS string), 3, '0') || '-' || lpad(CAST(l_linenumber * 6 % 31 AS string), 2, '0') || '-' || lpad(CAST(l_partkey % 5 AS string), 2, '0')
    || '-00A-' || lpad(CAST((l_partkey * 37 + l_orderkey) % 400 AS string), 3, '0') || 'A-A] ' || p_name || CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '. Общие данные' ELSE '.  Описание. Работа' END || CASE WHEN l_partkey % 2 = 0 THEN '_001_ru-RU' ELSE '' END END AS folder_name,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE lpad(CAST(l_suppkey % 40 AS string), 3, '0') || '-' || lpad(CAST(l_linenumber * 6 % 31 AS string), 2, '0') || ' - Система ' || CAST(l_suppkey % 7 AS string) END AS subsystem_group,
  l_partkey % 3 <> 0 AS has_docx, l_suppkey % 2 = 0 AS has_doc
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""

#: Raw file names by kind. The folder's role is desc, tech, graphics, root or a component.
DERIVED["raw_files"] = """
SELECT file_seq, CASE WHEN k IN (0, 1, 2, 3) THEN 'desc' WHEN k IN (4, 5, 6) THEN 'tech' WHEN k IN (7, 8) THEN 'graphics' ELSE 'root' END AS role,
  CASE k
    WHEN 0 THEN code || ' описание ' || p_name || ' !.doc'
    WHEN 1 THEN code || ' описание ' || p_name || ' !.docx'
    WHEN 2 THEN code || ' Обратный клапан ' || p_name || '.docx'
    WHEN 3 THEN 'ПИУН ' || CAST(sys AS string) || '.doc'
    WHEN 4 THEN code || ' ТК ' || CAST(file_seq % 30 AS string) || ' ' || CASE file_seq % 7 WHEN 0 THEN 'демонтаж и монтаж' WHEN 1 THEN 'Визуальный осмотр' WHEN 2 THEN 'слив рабочей жидкости' WHEN 3 THEN 'слив фильтра' WHEN 4 THEN 'Удаление воздуха' WHEN 5 THEN 'проверка работоспособности фильтроэлемента' ELSE p_name END || ' !.doc'
    WHEN 5 THEN dots || ' ТК ТО ' || p_name || '.doc'
    WHEN 6 THEN '~$' || code || ' ТК 1.doc'
    WHEN 7 THEN code || ' рис ' || CAST(file_seq % 12 AS string) || ' ' || p_name || '.jpg'
    WHEN 8 THEN code || ' ПИУН рис ' || CAST(101 + file_seq % 5 AS string) || ' .png'
    WHEN 9 THEN code || ' Перечень сокращений.doc'
    WHEN 10 THEN code || CASE file_seq % 4 WHEN 0 THEN ' ЛРВИ' WHEN 1 THEN ' лри' WHEN 2 THEN ' ПДС' ELSE ' Содержание' END || ' ' || p_name || '.pdf'
    ELSE 'Thumbs.db' END AS filename
FROM (SELECT *, lpad(CAST(sys AS string), 3, '0') || '.' || lpad(CAST(sub AS string), 2, '0') || '.' || lpad(CAST(comp AS string), 2, '0') AS dots,
        lpad(CAST(sys AS string), 3, '0') || CASE WHEN k % 2 = 0 THEN '.' ELSE '-' END || lpad(CAST(sub AS string), 2, '0') || CASE WHEN k % 2 = 0 THEN '.' ELSE '-' END || lpad(CAST(comp AS string), 2, '0') AS code
      FROM (SELECT p_partkey AS file_seq, p_name, CAST(p_partkey % 12 AS bigint) AS k, CAST(27 + p_partkey % 3 AS bigint) AS sys, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 11 WHEN 2 THEN 12 ELSE 30 END AS sub, CAST(p_partkey % 6 AS bigint) AS comp FROM {part}))"""

#: Classified source records, as a raw scan gives them.
DERIVED["raw_docs"] = """
SELECT p_partkey AS seq, 'f' || CAST(p_partkey AS string) || CASE WHEN p_partkey % 2 = 0 THEN '.doc' ELSE '.docx' END AS filename,
  CASE WHEN p_partkey % 3 = 0 THEN '029' ELSE '028' END AS sys, lpad(CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 11 WHEN 2 THEN 12 ELSE 30 END AS string), 2, '0') AS sub, lpad(CAST(p_partkey % 7 AS string), 2, '0') AS comp,
  CASE WHEN p_partkey % 9 < 3 THEN 'description' WHEN p_partkey % 9 < 6 THEN 'tk' WHEN p_partkey % 9 = 6 THEN 'tk_to' WHEN p_partkey % 9 = 7 THEN 'piun' ELSE 'special' END AS doc_type,
  CASE WHEN p_partkey % 9 = 8 THEN CASE WHEN p_partkey % 2 = 0 THEN 'table' ELSE 'abbreviations' END END AS special_type,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 9 < 3 THEN CASE WHEN p_partkey % 5 = 0 THEN 'Общие указания' ELSE p_name END
    ELSE CASE p_partkey % 6 WHEN 0 THEN 'Демонтаж' WHEN 1 THEN 'Визуальный осмотр' WHEN 2 THEN 'Слив рабочей жидкости' WHEN 3 THEN 'Смазка фильтроэлемента' WHEN 4 THEN 'Проверка работоспособности' ELSE p_name END END AS title
FROM {part}"""

#: Elements of a document, and a perturbed copy.
DERIVED["left_elements"] = """
SELECT doc_id, para_idx + 1 AS idx, CASE (doc_id + para_idx) % 6 WHEN 0 THEN 'heading' WHEN 1 THEN 'unnumbered_list' WHEN 2 THEN 'figure' WHEN 3 THEN 'warning' ELSE 'para' END AS type,
  substring(line, 1, 60) AS text_start, right(line, 40) AS text_end, para_idx % 3 AS span, 'id' || CAST(CASE WHEN para_idx % 4 = 0 THEN para_idx % 8 ELSE para_idx END AS string) AS stable_id
FROM {doc_lines}"""
DERIVED["right_elements"] = """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS idx, CASE WHEN idx % 11 = 0 THEN 'note' WHEN type = 'unnumbered_list' THEN 'numbered_list' ELSE type END AS type,
  CASE WHEN idx % 5 = 0 THEN substring(text_start, 1, 20) WHEN idx % 13 = 0 THEN 'zz ' || substring(text_start, 1, 50) ELSE text_start END AS text_start, CASE WHEN idx % 6 = 0 THEN '' ELSE text_end END AS text_end, span,
  CASE WHEN idx % 3 = 0 THEN '' ELSE stable_id END AS stable_id
FROM {left_elements} WHERE (doc_id + idx) % 7 <> 0"""

#: Positioned blocks of pages of 14 lines.
DERIVED["blocks"] = """
SELECT doc_id, CAST(floor(para_idx / 14) + 1 AS bigint) AS page_num, para_idx AS blk_seq, CAST(50 + CASE WHEN para_idx % 5 = 3 THEN 30 ELSE 0 END AS double) AS x0, CAST(5 + (para_idx % 14) * 58 + para_idx % 3 AS double) AS y0,
  CAST(50 + CASE WHEN para_idx % 5 = 3 THEN 30 ELSE 0 END + length(line) % 400 AS double) AS x1, CAST(5 + (para_idx % 14) * 58 + para_idx % 3 + 40 AS double) AS y1, line AS text, CAST(1 AS bigint) AS lines,
  CAST(CASE WHEN (doc_id + para_idx) % 9 = 0 THEN 18 ELSE 12 END AS double) AS max_font_size, para_idx % 9 = 0 AS is_bold, para_idx % 7 = 0 AS is_italic, para_idx % 10 IN (4, 5) AS in_table, para_idx % 12 = 8 AS is_image
FROM {doc_lines}"""

#: Coded modules of folders, as a table of contents reads them.
DERIVED["dm_refs"] = """
SELECT folder_seq AS pos, sys AS system_code, sub AS sub_key, comp AS assy, info AS info_code, 'DMC-S5-A-' || sys || '-' || sub || '-' || comp || '-00A-' || info || 'A-A' AS dmc, 'Имя ' || comp AS tech_name, 'Данные ' || info AS info_name, CASE WHEN folder_seq % 3 = 0 THEN NULL ELSE sys || '-' || sub END AS tag
FROM (SELECT CAST(l_orderkey * 10 + l_linenumber AS bigint) AS folder_seq, lpad(CAST(l_suppkey % 4 + 27 AS string), 3, '0') AS sys, lpad(CAST(l_linenumber * 6 % 13 AS string), 2, '0') AS sub, lpad(CAST(l_partkey % 5 AS string), 2, '0') AS comp, lpad(CAST((l_partkey * 37 + l_orderkey) % 400 AS string), 3, '0') AS info FROM {lineitem})"""

#: The same with each row's place in its table, which tells the first of several modules of one pos.
SPELLED["placed_refs"] = tuple(
    DERIVED["dm_refs"].replace("AS tag\n", "AS tag, place\n").replace(" FROM {lineitem}", f", {place} AS place FROM {{lineitem}}") for place in ("struct(_metadata.file_path, _metadata.row_index)", "row_number() OVER ()")
)

#: Cells of small grids, some rows short.
DERIVED["cells"] = """
SELECT p_partkey AS table_idx, r AS row_no, c AS col_no, CASE r WHEN 0 THEN CASE (p_partkey + c) % 4 WHEN 0 THEN 'Оборудование' WHEN 1 THEN 'Материалы' WHEN 2 THEN 'Запасные части' ELSE 'Прочее' END ELSE p_name || ' ' || CAST(r * 3 + c AS string) END AS text
FROM {part} CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) AS a(r)) CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) AS b(c)) WHERE NOT (r = 2 AND c = 2)"""

#: Illustrations and other elements in order, figures running over several sheets.
DERIVED["figures"] = """
SELECT doc_id, para_idx AS seq, CASE WHEN para_idx % 5 < 3 THEN 'illustration' ELSE 'paragraph' END AS type,
  CASE WHEN para_idx % 5 < 3 THEN 'Рисунок ' || CAST(floor(para_idx / 2) AS bigint) || ' – ' || substring(line, 1, 30) || CASE para_idx % 3 WHEN 0 THEN ' (лист 1, лист 2)' WHEN 1 THEN ' лист 1, лист 2, лист 3' ELSE '' END ELSE line END AS content
FROM {doc_lines}"""

#: Elements with types that window operators rewrite.
DERIVED["typed"] = """
SELECT doc_id, para_idx AS seq, CASE (doc_id + para_idx) % 7 WHEN 0 THEN 'illustration_reference' WHEN 3 THEN 'table' WHEN 5 THEN 'unnumbered_list' WHEN 6 THEN 'nested_unnumbered_list' ELSE 'paragraph' END AS type,
  CASE WHEN (doc_id + para_idx) % 7 = 1 AND para_idx % 2 = 0 THEN 'Рисунок ' || CAST(para_idx % 5 AS string) || ' ' || substring(line, 1, 40) WHEN (doc_id + para_idx) % 7 = 2 THEN substring(line, 1, 40) || ' (см. таблица ' || CAST(para_idx % 9 AS string) || '),' ELSE substring(line, 1, 60) END AS content,
  CASE WHEN (doc_id + para_idx) % 5 < 2 THEN CAST(floor(para_idx / 3) AS bigint) END AS ref
FROM {doc_lines}"""
