"""Literal examples, properties against plain models, and edge cases of the operators."""

import io
import random
import zipfile
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import codes, predicates as P, similarity, text as X
from docloom.operators import assemble as A, classify as C, figures, importing as imp, layout as L, matching as M, pages, reports as R, sequence as S, validation as V, votes
from docloom.sources import markup as Mk, office as Of


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,header,item", [("1 МЕРЫ БЕЗОПАСНОСТИ", True, False), ("3.1.2 ОПИСАНИЕ", True, False), ("2. ОБЩИЕ СВЕДЕНИЯ", True, False), ("1. Описание процесса", False, True), ("3.1.2 При монтаже", False, True), ("2) Порядок", False, True), ("3 шт. - описание", False, False), ("", False, False)])
def test_numbers(spark, text, header, item):
    assert one(spark, P.main_header("t"), t=text) is header
    assert one(spark, P.numbered_item("t"), t=text) is item


def test_coded_names(spark):
    name = "[S5-A-029-11-01-00A-028A-A] Гидрокомпенсатор. Общие данные_001_ru-RU"
    code = one(spark, codes.dm_code("t"), t=name)
    assert (code.systemCode, code.subSystemCode, code.subSubSystemCode, code.infoCode) == ("029", "1", "1", "028")
    assert one(spark, codes.title_part("t"), t=name) == "Гидрокомпенсатор. Общие данные"
    parts = one(spark, codes.title_parts("t"), t="Гидрокомпенсатор. Общие данные")
    assert tuple(parts) == ("Гидрокомпенсатор", "Общие данные")
    assert one(spark, codes.dm_code("t"), t="Папка") is None
    assert one(spark, codes.folder_dmc("t"), t=name) == "S5-A-029-11-01-00A-028A-A"
    assert one(spark, codes.is_descriptive("t"), t="x1") is False and one(spark, codes.is_descriptive("t"), t=None) is False


def test_hierarchical_numbers(spark):
    rows = [(1, i, lv) for i, lv in enumerate([1, 2, 2, 1, 2, 3])]
    df = S.numbering(spark.createDataFrame(rows, "doc_id long, seq long, level int"))
    assert [r.number for r in df.orderBy("seq").collect()] == ["1", "1.1", "1.2", "2", "2.1", "2.1.1"]


def test_word_boundaries(spark):
    assert one(spark, P.is_warning("t"), t="ВНИМАНИЕ! Осторожно") is True
    assert one(spark, P.is_warning("t"), t="МЕРЫ БЕЗОПАСНОСТИ") is False
    assert one(spark, P.is_note("t"), t="ПРИМЕЧАНИЕ. Текст") is True


def test_letter_spacing(spark):
    assert one(spark, X.norm_match("t"), t="П р и м е ч а н и е : затяжку") == "примечание: затяжку"
    assert one(spark, X.collapse_spaced("t"), t="П р и м е ч") == "Примеч"
    assert one(spark, X.norm_text("t"), t="Рисунок 3 – Про- мыть") == "промыть"


def test_title_forms(spark):
    assert one(spark, X.clean_title("t"), t="ОБЩИЕ СВЕДЕНИЯ – ОПИСАНИЕ.") == "Общие сведения – Описание"
    assert one(spark, X.title_case("t"), t="бОльшой Насос (НС74)") == "Большой насос (НС74)"
    assert one(spark, X.title_case("t"), t="НАСОС") == "НАСОС"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("abc д", max_size=12), st.text("abc д", max_size=12)), min_size=1, max_size=30))
def test_prefix_score_model(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.s for r in df.select("i", X.prefix_score("a", "b").alias("s")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx(M.prefix(a, b))


def test_multi_sheet(spark):
    rows = [(1, 0, "Рисунок 1 – Схема"), (1, 1, "Рисунок 2 – Схема (лист 1, лист 2)"), (1, 2, "Рисунок 3 – Вид (лист 1, лист 2, лист 3)"), (1, 3, "Рисунок 4 – Вид (лист 1, лист 2, лист 3, лист 4)"), (1, 4, "Рисунок 5 – Вид"), (1, 5, "Рисунок 6 – Вид лист 1, лист 2, лист 3"), (1, 6, None)]
    df = figures.multi_sheet_figures(spark.createDataFrame(rows, "doc_id long, seq long, content string"))
    assert {r.figure_number: list(r.sheets) for r in df.collect()} == {2: [1, 2], 3: [1, 2, 3], 4: [1, 2, 3, 4], 6: [1, 2, 3]}


PARA = "doc_id long, para_idx long, kind string, text string, style string, num_id long, ilvl long, left_indent long, style_indent long, has_image boolean"


def classified(spark, *texts):
    rows = [(1, i, "p", t, s, None, None, None, None, False) for i, (t, s) in enumerate(texts)]
    return [(r.type, r.content) for r in C.classify(spark.createDataFrame(rows, PARA)).orderBy("seq").collect()]


def test_cascade(spark):
    got = classified(spark, ("– первый;", "Normal"), ("– второй:", "Normal"), ("• третий;", "Normal"), ("• последний.", "Normal"))
    assert [t for t, _ in got] == ["unnumbered_list"] * 4
    got = classified(spark, ("ОБЩИЕ СВЕДЕНИЯ", "Heading 1"), ("1. МЕРЫ", "Normal"), ("2. СОСТАВ", "Normal"))
    assert [t for t, _ in got] == ["header", "numbered_paragraph_header", "numbered_paragraph_header"]
    assert classified(spark, ("см. таблица 3 и рис. 4 здесь.", "Normal")) == [("table_reference", "см. таблица 3 и рис. 4 здесь."), ("illustration_reference", "см. таблица 3 и рис. 4 здесь."), ("paragraph", "см. таблица 3 и рис. 4 здесь.")]
    assert classified(spark, ("", "Normal"), (None, "Normal")) == []


def test_greedy_is_one_to_one_and_stable(spark):
    rnd = random.Random(5)
    rows = [(d, i, j, round(rnd.random(), 1)) for d in range(5) for i in range(12) for j in range(12) if rnd.random() < 0.5]
    got = M.greedy(spark.createDataFrame(rows, "doc_id long, l long, r long, sim double")).collect()
    for d in range(5):
        left, right = {x.l: x.sim for x in got if x.doc_id == d}, {x.r: x.sim for x in got if x.doc_id == d}
        assert len(left) == len(right) == sum(x.doc_id == d for x in got)
        assert all(s <= max(left.get(i, -1), right.get(j, -1)) for dd, i, j, s in rows if dd == d)


def test_lcs_is_longest():
    rnd = random.Random(7)
    for _ in range(200):
        a, b = ([rnd.choice("xyz") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = M.lcs(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(p < q for p, q in zip(got, got[1:]))


ELEMENTS = "doc_id long, idx long, type string, text_start string, text_end string, span long, stable_id string"


def test_equal_lists_score_one(spark):
    rows = [(1, i, "para", f"Текст номер {i} абв", f"конец {i}", 1, "") for i in range(1, 6)]
    df = spark.createDataFrame(rows, ELEMENTS)
    matches, report = M.compare(df, df)
    assert report.first().score == 1.0 and {(r.l, r.r) for r in matches.collect()} == {(i, i) for i in range(1, 6)}
    empty = spark.createDataFrame([], ELEMENTS)
    assert M.compare(df, empty)[1].first().score == 0.0
    assert M.compare(empty, empty)[1].count() == 0


def test_ratio(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "a"), ("", "")], "a string, b string")
    got = [r.x for r in df.select(similarity.seq_ratio(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [SequenceMatcher(None, "tide", "diet").ratio(), SequenceMatcher(None, "diet", "tide").ratio(), None, 1.0]


def test_thousandths(spark):
    rnd = random.Random(3)
    xs = [k / 2000 for k in range(2001)] + [k / n for n in range(1, 200) for k in range(n + 1)] + [rnd.random() for _ in range(3000)] + [0.0625, 0.1875]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", similarity.thousandths(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [round(r.x, 3) for r in got] and one(spark, similarity.thousandths(F.col("x")), x=None) is None


def test_office_round_trip(spark):
    data = Of.build([("Заголовок & <x>", "Heading 1"), ("", "Normal")], [["a", "b"], ["1", "2"]])
    got = Of.read(spark.createDataFrame([(1, data), (2, b"no zip")], "doc_id long, content binary")).collect()
    assert [(r.kind, r.text) for r in got if r.doc_id == 1] == [("p", "Заголовок & <x>"), ("p", ""), ("table", "a"), ("table", "b"), ("table", "1"), ("table", "2")]
    assert [r.error.split(":")[0] for r in got if r.doc_id == 2] == ["BadZipFile"]
    tables = Of.tables_with_titles(Of.read(spark.createDataFrame([(1, data)], "doc_id long, content binary"))).first()
    assert tables.id == "tab-1" and list(tables.headers) == ["a", "b"]


def office_file(body, relations=(), parts=()):
    """A document of this body; relations are (id, target, external)."""
    spaces = "".join(f' xmlns:{k}="{n[1:-1]}"' for k, n in (("w", Of.W), ("a", Of.A), ("r", Of.R), ("v", Of.V)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document{spaces}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="{i}" Target="{t}"' + (' TargetMode="External"' if e else "") + "/>" for i, t, e in relations) + "</Relationships>")
        for name, data in parts:
            z.writestr(name, data)
    return out.getvalue()


def paragraph(text, more=""):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r>{more}</w:p>"


def test_merged_cells_and_box_texts():
    """A cell is given for each place that it takes; the line of a paragraph is without the texts of its boxes."""
    wide = f'<w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{paragraph("wide")}</w:tc>'
    tall, below = f'<w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr>{paragraph("tall")}</w:tc>', "<w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc>"
    cell = f"<w:tc>{paragraph('a')}{paragraph('b')}</w:tc>"
    table = f"<w:tbl><w:tr>{tall}{wide}</w:tr><w:tr>{below}{cell}{cell}</w:tr><w:tr>{below}{wide}</w:tr></w:tbl>"
    box = f"<w:r><w:pict><v:shape><v:textbox><w:txbxContent>{paragraph('inside')}</w:txbxContent></v:textbox></v:shape></w:pict></w:r>"
    line = f'<w:p><w:hyperlink><w:r><w:t>link</w:t><w:tab/></w:r></w:hyperlink><w:r><w:t>x</w:t><w:br/><w:br w:type="page"/><w:noBreakHyphen/></w:r>{box}</w:p>'
    got = list(Of.parse(office_file(line + table)))
    assert [(r["kind"], r["text"]) for r in got[:2]] == [("p", "link\tx\n-"), ("box", "inside")]
    assert [(r["row_no"], r["col_no"], r["text"]) for r in got[2:]] == [
        (0, 0, "tall"), (0, 1, "wide"), (0, 2, "wide"), (1, 0, "tall"), (1, 1, "a\nb"), (1, 2, "a\nb"), (2, 0, "tall"), (2, 1, "wide"), (2, 2, "wide"),
    ]


def test_tables_in_boxes_come_before_others(spark):
    both, own = Of.build([], [["own"]], boxed=[["x\n\ny", ""]]), Of.build([], [["own", "z"]])
    rows = [(1, both), (2, own), (3, b"no zip"), (4, None), (5, Of.build([]))]
    got = Of.box_tables(spark.createDataFrame(rows, "doc_id long, content binary")).orderBy("doc_id", "col_no").collect()
    assert [(r.doc_id, r.col_no, r.paragraphs) for r in got if not r.error] == [(1, 0, ["x", "y"]), (1, 1, []), (2, 0, ["own"]), (2, 1, ["z"])]
    assert [r.doc_id for r in got if r.error] == [3, 4]


def test_illustrations_and_positions(spark):
    drawn = '<w:r><w:drawing><a:blip r:embed="{}"/></w:drawing></w:r>'.format
    older = '<w:r><w:pict><v:shape><v:imagedata r:id="r2"/></v:shape></w:pict></w:r>'
    body = paragraph("abc") + f"<w:p><w:r><w:t>de</w:t><w:br/><w:t>fgh</w:t></w:r>{drawn('r1')}</w:p>" + paragraph("", drawn("gone")) + paragraph("", drawn("far")) + paragraph("", drawn("lost"))
    body += f"<w:tbl><w:tr><w:tc>{paragraph('x' * 120, older)}</w:tc></w:tr></w:tbl>"
    file = office_file(body, [("r1", "media/image1.png", False), ("r2", "/word/media/image2.png", False), ("far", "http://h/image.png", True), ("lost", "media/image9.png", False)], [("word/media/image1.png", b"one"), ("word/media/image2.png", b"two")])
    got = Of.illustrations(spark.createDataFrame([(7, file), (8, b"")], "doc_id long, content binary"), "p").orderBy("doc_id", "image_no").collect()
    assert [(r.name, r.kind, r.idx, r.start_line, r.start_char, r.end_line, r.end_char, r.context, bytes(r.image)) for r in got if r.doc_id == 7] == [
        ("p-GRAPHIC0", "p", 1, 1, 3, 2, 3, "de\nfgh", b"one"), ("p-GRAPHIC1", "table", 0, 2, 3, 2, 123, "x" * 100 + "...", b"two"),
    ]
    assert [r.error.split(":")[0] for r in got if r.doc_id == 8] == ["BadZipFile"]


def test_modules_escape_and_walk(spark):
    rows = [(1, 0, "header", "А & Б"), (1, 1, "paragraph", "<b>"), (1, 2, "unnumbered_list", "x"), (1, 3, "unnumbered_list", "y"), (1, 4, "warning", "w")]
    df = A.modules(A.sections(spark.createDataFrame(rows, "doc_id long, seq long, type string, content string")))
    got = Mk.read_modules(df).orderBy("idx").collect()
    assert [(r.type, r.text_start) for r in got] == [("heading", "А & Б"), ("warning", "w"), ("para", "<b>"), ("unnumbered_list", "x"), ("unnumbered_list", "y")]
    assert Mk.read_modules(spark.createDataFrame([(1, "<broken"), (2, None)], "doc_id long, xml string")).count() == 0


def test_merge_lines_rules(spark):
    def line(n, y, text, x=50.0, font=12.0, image=False):
        return (1, 1, n, x, y, x + 100, y + 10, text, 1, font, False, False, False, image)

    rows = [line(0, 0.0, "начало строки"), line(1, 12.0, "продолжение."), line(2, 24.0, "новый абзац"), line(3, 36.0, "– пункт"), line(4, 90.0, "", image=True), line(5, 102.0, "Рисунок 1 – Вид")]
    df = L.merge_lines(spark.createDataFrame(rows, "doc_id long, page_num long, blk_seq long, x0 double, y0 double, x1 double, y1 double, text string, lines long, max_font_size double, is_bold boolean, is_italic boolean, in_table boolean, is_image boolean"))
    assert [r.text for r in df.orderBy("y0").collect()] == ["начало строки продолжение.", "новый абзац", "– пункт", "Рисунок 1 – Вид"]


def test_files_and_dedup(spark):
    rows = [(1, "desc", "029.11.01 описание гидрокомпенсатор !.doc"), (2, "tech", "029.11.01 ТК 12 Демонтаж !.doc"), (3, "root", "thumbs.db"), (4, "graphics", "29.11.01 рис 3 вид.jpg"), (5, "component", "012-00-00.doc"), (6, "desc", None)]
    got = {r.file_seq: r for r in imp.scan_files(spark.createDataFrame(rows, "file_seq long, role string, filename string")).collect()}
    assert {k: v.doc_type for k, v in got.items()} == {1: "description", 2: "tk", 4: "graphic", 5: "description"}
    assert got[4].sys == "029" and got[2].tk_number == 12 and got[1].title == "гидрокомпенсатор"
    files = spark.createDataFrame([(1, "a.docx"), (2, "a.doc"), (3, "a.doc"), (4, "b.docx"), (5, "c.pdf")], "file_seq long, filename string")
    assert {r.file_seq for r in imp.dedup_files(files).collect()} == {3, 4, 5}


def test_sets_and_edits(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "dmc string") for v in ("abb", "bc"))
    assert {r.dmc for r in R.toggle(a, b, "dmc").collect()} == {"a", "c"}
    rows = spark.createDataFrame([(1, 1, "para", "a", "b", 2), (1, 2, "para", "c", "d", 0)], "doc_id long, idx long, type string, text_start string, text_end string, span long")
    merged = R.merge_rows(rows, F.col("idx") == 1).first()
    assert (merged.text_start, merged.text_end, merged.span) == ("a", "d", 3)
    assert R.split_rows(rows).count() == 3
    assert V.order_errors(spark.createDataFrame([(1, 1, 0, "para"), (1, 1, 1, "title")], "doc_id long, section long, seq long, type string")).count() == 1


def test_answers_and_pages(spark):
    assert one(spark, votes.parse_answer("t"), t="x") is None
    e = spark.createDataFrame([(1, 1, "para", "первый абзац текста", ""), (1, 2, "para", "совсем другой текст", "")], "doc_id long, idx long, type string, text_start string, text_end string")
    b = spark.createDataFrame([(1, 1, 0, 50.0, 0.0, 90.0, 10.0, "первый абзац текста", False), (1, 1, 1, 50.0, 100.0, 90.0, 110.0, "посторонний", False)], "doc_id long, page_num long, blk_seq long, x0 double, y0 double, x1 double, y1 double, text string, is_table boolean")
    got = {(r.source_idx, r.type) for r in pages.match(e, b).collect()}
    assert got == {(1, "para"), (2, "_unmatched_xml"), (None, "_extra_pdf")}


def test_streaming_equals_batch(spark, tmp_path):
    from docloom.streaming import ingest

    docs = spark.createDataFrame([(i, f"line {i}\nz") for i in range(20)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = ingest.read_documents(spark, str(tmp_path / "in"), docs.schema, 2)
    ingest.run(stream, lambda b: b.select("doc_id", F.length("text").alias("n")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 20 and got.agg(F.sum("n")).first()[0] == docs.agg(F.sum(F.length("text"))).first()[0]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], PARA)
    assert C.classify(empty).count() == 0 and S.after_colon(empty, seq="para_idx").count() == 0
    assert C.content_sections(empty).count() == 0


def test_settings():
    assert Mk.settings("[a]\nx = 1\ny = 0.5\nz = yes\nw = text") == {"a": {"x": 1, "y": 0.5, "z": True, "w": "text"}}


def test_missing_content_by_similar_words(spark, monkeypatch):
    from docloom.plans import registry

    rnd = random.Random(25)
    words = ["болт", "гайка", "насос", "клапан", "фильтр", "шланг", "корпус", "крышка", "масло", "ось"]
    draw = lambda: " ".join(rnd.sample(words, rnd.randint(4, 10)))
    source = [(d, i, draw()) for d in range(3) for i in range(25)] + [(0, 99, "насос"), (9, 0, "документ без строк вывода")]
    output = [(d, i, draw().upper()) for d in range(3) for i in range(12)]

    def similar(a, b):
        a, b = set(a.lower().split()), set(b.lower().split())
        return bool(a and b) and len(a & b) / len(a | b) >= 0.8

    held = [(d, t.lower()) for d, i, t in output if i % 3 != 1]
    alone = {(d, i) for d, i, t in source if len(t) > 10 and not any(d == e and (t in o or o in t) for e, o in held)}
    want = {(d, i) for d, i, t in source if (d, i) in alone and not any(d == e and similar(t, o) for e, o in held)}
    assert want < alone
    tables = {"typed": spark.createDataFrame(source, "doc_id long, seq long, content string"), "doc_lines": spark.createDataFrame(output, "doc_id long, para_idx long, line string")}
    monkeypatch.setattr(registry, "table", lambda spark, sf_dir, name: tables[name])
    assert {tuple(r) for r in registry.QUERIES["j25_missing_similar"](spark, "").collect()} == want
    assert {tuple(r) for r in registry.QUERIES["j25_missing_content"](spark, "").collect()} == alone
