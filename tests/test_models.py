"""Operators that SQL cannot express against plain models, whole results compared on the smallest tables."""

import re
from collections import defaultdict
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.functions import codes, rules
from docloom.operators import convert as Cv, importing as imp, layout as L, marking, matching as M
from docloom.plans import QUERIES, document_queries
from docloom.plans.registry import table
from docloom.sources import markup as Mk

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def by_doc(df, *order):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return {k: sorted(v, key=lambda r: tuple(r[c] for c in order)) for k, v in out.items()}


@pytest.fixture(scope="module")
def sides(spark):
    left, right = table(spark, DATA, "left_elements"), table(spark, DATA, "right_elements")
    return left, right, by_doc(M.normed(left, "l"), "l"), by_doc(M.normed(right, "r"), "r")


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def test_fuzzy_pairs(spark, sides):
    """Every pair scored without bounds, the best taken first."""
    _, _, left, right = sides
    want = set()
    for doc, ls in left.items():
        scored = []
        for a in ls:
            for b in right.get(doc, []):
                sim = max(ratio(x, y) if x and y else 0.0 for x, y in ((a.ls, b.rs), (a.lf, b.rf)))
                if sim >= 0.35:
                    scored.append((-sim, a.l, b.r))
        used_l, used_r = set(), set()
        for s, a, b in sorted(scored):
            if a not in used_l and b not in used_r:
                used_l.add(a)
                used_r.add(b)
                want.add((doc, a, b, round(-s, 9)))
    got = {(r.doc_id, r.l, r.r, round(r.sim, 9)) for r in QUERIES["j2_fuzzy_pairs"](spark, DATA).collect()}
    assert got == want and len(want) > 500


def test_pairs_in_blocks(spark, sides):
    """Blocks lose no pair and give none twice."""
    left, right = M.normed(sides[0], "l"), M.normed(sides[1], "r")
    whole = left.join(right, "doc_id").select("doc_id", "l", "r")
    cut = M.paired(left, right, 3).select("doc_id", "l", "r")
    assert cut.count() == whole.count() and cut.exceptAll(whole).count() == 0


def test_type_alignment(spark, sides):
    """A full table of subsequence lengths, walked from its end."""
    left, right, _, _ = sides
    ls, rs = by_doc(left, "idx"), by_doc(right, "idx")
    want = set()
    for doc, a in ls.items():
        b = rs.get(doc, [])
        x, y = ([rules.TYPE_CLASS.get(e.type, e.type) for e in side] for side in (a, b))
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                t[i + 1][j + 1] = t[i][j] + 1 if x[i] == y[j] else max(t[i][j + 1], t[i + 1][j])
        i, j = len(x), len(y)
        while i and j:
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                want.add((doc, a[i].idx, b[j].idx))
            elif t[i - 1][j] > t[i][j - 1]:
                i -= 1
            else:
                j -= 1
    assert {(r.doc_id, r.l, r.r) for r in QUERIES["j3_align_types"](spark, DATA).collect()} == want


def test_containment(spark, sides):
    """Each left element against all right ones."""
    _, _, left, right = sides
    want = set()
    for doc, ls in left.items():
        for a in ls:
            if len(a.ls) < 8:
                continue
            best = None
            own = set(a.ls.split())
            for b in right.get(doc, []):
                if not b.rf:
                    continue
                score = None
                if len(a.le) >= 8 and (s := ratio(a.le, b.re) if a.le != b.re else 1.0) >= 0.4:
                    score = s
                share = len(own & set(b.rf.split())) / len(own)
                if len(own) >= 3 and share >= 0.5:
                    score = max(score or 0.0, share)
                if score is not None and (best is None or score > best[0]):
                    best = score, b.r
            if best:
                want.add((doc, a.l, best[1]))
    assert {(r.doc_id, r.l, r.r) for r in QUERIES["j4_contained"](spark, DATA).collect()} == want


def test_ratios(spark, sides):
    """F4 in argument order."""
    left, right, _, _ = sides
    rs = {(r.doc_id, r.idx): r.text_start for r in right.collect()}
    want = {(a.doc_id, a.idx): round(ratio(a.text_start, rs[a.doc_id, a.idx]), 6) for a in left.collect() if (a.doc_id, a.idx) in rs and a.text_start is not None}
    got = {(r.doc_id, r.idx): r.ratio for r in QUERIES["f4_seq_ratio"](spark, DATA).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1.5e-6 for k in want)


def test_names_match(spark):
    """Equal, or one of 15 or more opens the other, or alike enough."""
    from docloom.functions.similarity import names_match

    names = ["", "насос", "насос топливный", "насос топливный нт", "насос топливный нт-2", "блок управления", "управления блок", "блок управлениа", "a", "b"]
    df = spark.createDataFrame([(x, y) for x in names for y in names], "a string, b string")
    for r in df.select("a", "b", names_match(F.col("a"), F.col("b")).alias("m")).collect():
        x, y = (r.a, r.b) if len(r.a) <= len(r.b) else (r.b, r.a)
        opens = r.a == r.b or (len(x) >= 15 and y.startswith(x))
        score = 1.0 if opens else 0.0 if not x else ratio(r.a, r.b)
        assert (r.m.match, round(r.m.score, 9)) == (opens or score >= 0.85, round(score, 9))


# -- reference markup -------------------------------------------------------------------------------------------------------


def opening(a, b):
    a, b = a.strip().lower(), b.strip().lower()
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return n / len(a) if n >= 3 else 0.0


def without_marks(t):
    return re.sub(r"^[–•-]\s*", "", re.sub(r"^\d+(\.\d+)*[.)]*\s*", "", t.strip()))


def joined_letters(t):
    return re.sub(r"(?<!\S)\S(?:\s\S){2,}(?!\S)", lambda m: m[0].replace(" ", ""), t)


def model_marks(refs, elements):
    """One document, phase after phase over plain lists."""
    names = {"heading": "header", "para": "paragraph", "list": "unnumbered_list", "figure": "illustration"}
    texts, types = [e["content"] or "" for e in elements], [e["type"] for e in elements]
    who, phase, splits = [None] * len(texts), [None] * len(texts), [[] for _ in texts]
    refs = [r for r in sorted(refs, key=lambda r: r["idx"]) if r["type"] not in ("_extra_pdf", "_unmatched_xml")]

    def name(r):
        kind = names.get(r["type"], r["type"])
        m = re.match(r"(\d+(?:\.\d+)*)\s", r["start"])
        return "numbered_paragraph_header" if kind in ("numbered_list", "nested_numbered_list") and m and m[1].count(".") < 2 else kind

    def score(r, t):
        head, tail, start = t[:60].strip(), t[-40:].strip(), r["start"]
        s = opening(start, head)
        if without_marks(start) and without_marks(head):
            s = max(s, opening(without_marks(start), without_marks(head)))
        if (c := joined_letters(start)) != start:
            s = max(s, opening(c, head), opening(without_marks(c), without_marks(head) or head) if without_marks(c) else 0.0)
        if not r["end"]:
            return s
        return s * 0.7 + max(opening(r["end"], tail), opening(joined_letters(r["end"]), tail)) * 0.3

    def best(r, near):
        least = 0.2 if len(r["start"]) < 10 else 0.3
        if not r["start"]:
            return None
        for rows in (near, range(len(texts))):
            found, top = None, least
            for i in rows:
                if who[i] is None and (s := score(r, texts[i])) > top + 1e-15:
                    found, top = i, s
            if found is not None:
                return found
        return None

    def put(i, r, kind, step):
        types[i], who[i], phase[i] = kind, r["idx"], step

    def ends(r, t):
        a, b = r["end"], t[-40:].strip()
        return bool(a and b) and max(opening(a, b), opening(without_marks(a), without_marks(b)) if without_marks(a) and without_marks(b) else 0.0) > 0.3

    def ends_or_closes(r, t):
        a, b = (x.lower().replace("\n", " ").replace("\r", " ").strip() for x in (r["end"], t[-40:].strip()))
        n = min(15, len(a), len(b))
        return ends(r, t) or (n >= 8 and a[-n:] == b[-n:])

    cursor, later = 0, []
    for r in [r for r in refs if r["type"] != "_skip"]:
        i = best(r, range(max(0, cursor - 5), min(len(texts), cursor + 50)))
        if i is not None:
            put(i, r, name(r), "match")
            cursor = i + 1
            if r["span"] > 1:
                later.append((i, r))
                cursor = max(cursor, i + r["span"])
    for r in [r for r in refs if r["type"] == "_skip"]:
        i = best(r, range(min(50, len(texts))))
        if i is not None:
            put(i, r, "_skip", "skip")
    for at, r in later:
        for i in range(at + 1, min(len(texts), at + 1 + int(1.5 * r["span"]))):
            if types[i] == "_skip" and who[i] is not None:
                continue
            if who[i] is not None or (types[i] == "illustration" and name(r) != "illustration"):
                break
            put(i, r, "paragraph" if name(r) == "numbered_paragraph_header" else name(r), "span")
            if ends(r, texts[i]):
                break
    place = {w: i for i, w in enumerate(who) if w is not None}
    for r in refs:
        if r["type"] != "_skip" and r["end"] and r["idx"] in place and not ends_or_closes(r, texts[place[r["idx"]]]):
            at = place[r["idx"]]
            for i in range(at + 1, min(len(texts), at + 5)):
                if who[i] is not None:
                    break
                if ends_or_closes(r, texts[i]):
                    for k in range(at + 1, i + 1):
                        put(k, r, types[at], "extend")
                    break
    for r in refs:
        if r["type"] != "_skip" and r["start"] and r["idx"] not in place:
            for i, t in enumerate(texts):
                if who[i] is not None and types[i] != "_skip" and (at := t.lower().find(r["start"][:30].lower())) > 5:
                    splits[i].append((at, names.get(r["type"], r["type"]), r["idx"]))
                    place[r["idx"]] = i
                    break
    return [(types[i], who[i], phase[i], tuple(splits[i])) for i in range(len(texts))]


def rows_of(refs, elements):
    a, b = defaultdict(list), defaultdict(list)
    for r in refs.collect():
        a[r.doc_id].append({"idx": r.idx, "type": r.type, "start": (r.text_start or "").strip(), "end": (r.text_end or "").strip(), "span": r.span or 1})
    for r in elements.orderBy("doc_id", "seq").collect():
        b[r.doc_id].append({"seq": r.seq, "type": r.type, "content": r.content})
    return a, b


def same_marks(refs, elements):
    a, b = rows_of(refs, elements)
    want = {(d, e["seq"]): m for d, es in b.items() for e, m in zip(es, model_marks(a[d], es))}
    got = {(r.doc_id, r.seq): (r.type, r.ref_idx, r.phase, tuple((s.position, s.type, s.ref_idx) for s in r.splits)) for r in marking.marked(refs, elements).collect()}
    assert got == want
    return want


def test_reference_markup(spark):
    """J5 to J9 on the query's tables."""
    paras = table(spark, DATA, "paras")
    refs = table(spark, DATA, "left_elements").withColumn("type", F.when(F.col("idx") % 17 == 3, "_skip").when(F.col("idx") % 19 == 4, "_extra_pdf").otherwise(F.col("type")))
    kind = F.when(F.col("para_idx") % 13 == 5, "illustration").otherwise("paragraph")
    want = same_marks(refs, paras.select("doc_id", F.col("para_idx").alias("seq"), kind.alias("type"), F.col("text").alias("content")))
    assert {p for _, _, p, _ in want.values()} >= {None, "match", "span", "skip"}


def test_reference_markup_phases(spark):
    """A document that needs every phase: spaced letters, bare numbers, a long reference, a skipped row, an end a little ahead, a start inside."""
    texts = ["3 Общие указания", "Снимите крышку блока и проверьте", "его состояние по таблице", "Лишняя строка колонтитула", "затем установите крышку", "Примечание: смотри ниже", "Разъём снят. Затем поверните рукоятку до упора", "рисунок", "последний абзац текста", "с продолжением на новой строке", ""]
    elements = spark.createDataFrame([(1, i, "illustration" if t == "рисунок" else "paragraph", t) for i, t in enumerate(texts)] + [(2, 0, "paragraph", "без разметки")], "doc_id long, seq long, type string, content string")
    refs = [
        (1, 1, "numbered_list", "3 Общие указания", "", 1), (1, 2, "para", "Снимите крышку блока", "установите крышку", 3), (1, 3, "_skip", "Лишняя строка колонтитула", "", 1), (1, 4, "note", "П р и м е ч а н и е : смотри", "ниже", 1),
        (1, 5, "warning", "1.2 Разъём снят. Затем", "", 4), (1, 6, "list", "поверните рукоятку до упора", "", 1), (1, 7, "para", "последний абзац", "продолжением на новой строке", 1), (1, 8, "_unmatched_xml", "Снимите крышку", "", 1), (1, 9, "para", None, None, None),
    ]
    df = spark.createDataFrame(refs, "doc_id long, idx long, type string, text_start string, text_end string, span long")
    got = {k[1]: v for k, v in same_marks(df, elements).items() if k[0] == 1}
    assert got[0][:3] == ("numbered_paragraph_header", 1, "match") and got[3][:3] == ("_skip", 3, "skip") and got[2][2] == "span" and got[9][2] == "extend" and got[6][3] == ((19, "unnumbered_list", 6),)
    assert marking.marked(df.where("1 = 0"), elements).where("phase IS NOT NULL").count() == 0


# -- other cursor joins -------------------------------------------------------------------------------------------------------


def two_ends(start, end, text):
    s = exact_opening(start, text[:60])
    return 0.7 * s + 0.3 * exact_opening(end, text[-40:]) if end else s


def exact_opening(a, b):
    a, b = a.strip(), b.strip()
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return n / len(a) if n >= 3 else 0.0


def first_best(options, score, least):
    found, top = None, least
    for i in options:
        if (s := score(i)) > top:
            found, top = i, s
    return found


def test_blocks_to_elements(spark):
    """J12."""
    blocks, typed = table(spark, DATA, "blocks"), table(spark, DATA, "typed")
    bs, es = by_doc(blocks, "blk_seq"), by_doc(typed, "seq")
    want = set()
    for doc in bs:
        e, used, cursor = es.get(doc, []), set(), 0
        if not e:
            continue
        for b in bs[doc]:
            i, text = None, b.text.strip()
            if b.in_table:
                free = [k for k in range(max(0, cursor - 2), min(len(e), cursor + 10)) if k not in used and e[k].type == "table"]
                i = free[0] if free else None
            elif text:
                start, end = text[:60].strip(), text[-40:].strip()
                least = 0.2 if len(start) < 10 else 0.3
                for rows in (range(max(0, cursor - 5), min(len(e), cursor + 50)), range(len(e))):
                    if i is None:
                        i = first_best([k for k in rows if k not in used], lambda k: two_ends(start, end, e[k].content), least)
            if i is not None:
                used.add(i)
                cursor = i + 1
            want.add((doc, b.blk_seq, None if i is None else e[i].seq))
    assert {(r.doc_id, r.blk_seq, r.seq) for r in QUERIES["j12_blocks_to_elements"](spark, DATA).collect()} >= want


def test_two_passes(spark):
    """J13, on texts in procedure form, which F8's query holds against SQL."""
    from docloom.functions import text as X

    blocks = table(spark, DATA, "blocks").select("doc_id", "blk_seq", X.norm_procedure("text").alias("text"))
    elements = table(spark, DATA, "left_elements").select("doc_id", "idx", X.norm_procedure("text_start").alias("text"))
    bs, es = by_doc(blocks, "blk_seq"), by_doc(elements, "idx")

    def alike(a, b):
        x, y = sorted((a, b), key=len) if len(a) != len(b) else (a, b)
        return 0.0 if not a or not b else 1.0 if len(x) >= 15 and y.startswith(x) else ratio(a, b)

    want = set()
    for doc, e in es.items():
        b = bs.get(doc, [])
        used, at = set(), {}
        for n, x in enumerate(e):
            i = first_best([k for k in range(len(b)) if k not in used], lambda k: alike(x.text, b[k].text), 0.7)
            if i is not None:
                at[n] = i
                used.add(i)
        first = dict(at)
        for n, x in enumerate(e):
            if n not in first:
                low = max([k for k in first if k < n], default=None)
                high = min([k for k in first if k > n], default=None)
                rows = range((first[low] if low is not None else -1) + 1, first[high] if high is not None else len(b))
                i = first_best([k for k in rows if k not in used], lambda k: alike(x.text, b[k].text), 0.6)
                if i is not None:
                    at[n] = i
                    used.add(i)
        want |= {(doc, e[n].idx, b[i].blk_seq) for n, i in at.items()}
    assert {(r.doc_id, r.idx, r.blk_seq) for r in QUERIES["j13_two_pass"](spark, DATA).collect()} == want


def test_sidecar(spark):
    """J22."""
    xs, ss = by_doc(table(spark, DATA, "left_elements"), "idx"), by_doc(table(spark, DATA, "typed"), "seq")
    want = set()
    for doc, x in xs.items():
        s, used = ss.get(doc, []), set()
        for r in x:
            a = (r.text_start or "")[:120]

            def score(k):
                b = (s[k].content or "")[:120]
                return (0.1 if s[k].type == r.type else 0.0) + (ratio(a, b) if a and b else 0.5 if a == b else 0.0)

            i = first_best([k for k in range(len(s)) if k not in used], score, 0.3 - 1e-12)
            if i is not None:
                used.add(i)
                want.add((doc, r.idx, s[i].seq))
    assert {(r.doc_id, r.idx, r.seq) for r in QUERIES["j22_sidecar"](spark, DATA).collect()} == want


# -- import --------------------------------------------------------------------------------------------------------------------


def test_module_codes_are_unique(spark):
    """No code twice, letters only, the first of each as the reference letters it."""
    many = spark.range(2000).select(F.lit("029").alias("sys"), F.lit("11").alias("sub"), F.lit("01").alias("comp"), F.col("id").alias("seq"), F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("filename"), F.when(F.col("id") % 3 == 0, "special").otherwise("description").alias("doc_type"), F.when(F.col("id") % 3 == 0, "table").alias("special_type"), F.lit("Имя").alias("title"))
    for df, n in ((many, 2000), (table(spark, DATA.replace("0.001", "0.01"), "raw_docs"), None)):
        got = imp.build_modules(df).collect()
        assert len({r.dmc for r in got}) == len(got) and all(re.fullmatch("[A-Z]+", r.variant) for r in got) and (n is None or len(got) == n)
    names = [r.x for r in spark.range(20_000).select("id", codes.letters(F.col("id")).alias("x")).orderBy("id").collect()]
    assert names[:3] + names[25:28] + names[701:704] == ["A", "B", "C", "Z", "AA", "AB", "ZZ", "AAA", "AAB"] and len(set(names)) == 20_000


def test_suppressed_names(spark):
    """A22 with the ratio of every pair."""
    pairs = [("Насос", "насос"), ("Насос топливный", "Насос топливный НТ"), ("Блок", ""), ("", "Блок"), ("Пульт управления", "Управление пультом"), ("abcd", "abcx"), ("abc", "abd")] * 3
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, component_name string, info_name string")
    got = {r.i: r.info_name for r in imp.suppress_names(df).collect()}
    assert got == {i: "" if a and b and ratio(a.lower(), b.lower()) > 0.75 else b for i, (a, b) in enumerate(pairs)}


def test_graphics_find_their_modules(spark):
    """J26."""
    modules = imp.build_modules(table(spark, DATA, "raw_docs"))
    drawn = imp.scan_files(table(spark, DATA, "raw_files")).where("doc_type = 'graphic'")
    rows = sorted(modules.collect(), key=lambda m: (m.assy, m.disassy, m.info, m.seq, m.dmc))
    want = defaultdict(list)
    for g in drawn.collect():
        own = [m for m in rows if (m.sys, m.sub, m.comp) == (g.sys, g.sub, g.comp)]
        if g.special_type == "piun_graphic":
            n = re.search(r"рис\s*(\d+)", g.title)
            own = [m for m in own if m.info == "420" and n and m.disassy == str(int(n[1]) - 100).rjust(2, "0")]
        else:
            own = [m for m in own if m.info in ("040", "042")]
        if own:
            want[own[0].sys, own[0].sub, own[0].comp, own[0].dmc].append(g.filename)
    got = {(r.sys, r.sub, r.comp, r.dmc): r.sources for r in imp.attach_graphics(modules, drawn).collect()}
    assert got == {k: sorted(v) for k, v in want.items()}


def test_folder_plan(spark):
    """K6."""
    docs = table(spark, DATA, "raw_docs")
    names = {(r.sys, r.sub, r.comp): r.name for r in imp.component_names(docs).collect()}

    def clean(x):
        return re.sub(r"\s+", " ", re.sub(r'[<>:"/\\|?*]', "", x)).strip()

    got = {(r.dmc, r.seq): r.folder for r in imp.folder_plan(imp.build_modules(docs), imp.component_names(docs)).collect()}
    for m in imp.build_modules(docs).collect():
        several = [k for k in names if k[:2] == (m.sys, m.sub)]
        parts = [f"{m.sys}-{m.sub}-{m.comp} - {names[m.sys, m.sub, m.comp]}", f"[{m.dmc}] {m.component_name}" + (f". {m.info_name}" if m.info_name else "")]
        if m.sub != "00" and len(several) > 1:
            parts.insert(0, f"{m.sys}-{m.sub} - " + (names.get((m.sys, m.sub, "00")) or f"Подсистема {m.sub}"))
        assert [clean(p) for p in got[m.dmc, m.seq].split("/")] == [clean(p) for p in parts]


# -- layout --------------------------------------------------------------------------------------------------------------------------


def test_merged_lines(spark):
    """W11 over pages with collapsed tables: every line joins the block before it or opens one."""
    blocks = table(spark, DATA, "blocks")
    pages = defaultdict(list)
    for r in L.collapse_tables(blocks).collect():
        pages[r.doc_id, r.page_num].append(r.asDict())
    want = []
    for (doc, page), lines in pages.items():
        lines.sort(key=lambda b: (b["y0"], b["blk_seq"]))
        fonts = sorted(b["max_font_size"] for b in lines)
        middle = fonts[len(fonts) // 2]
        above = [b["y0"] - a["y1"] for a, b in zip(lines, lines[1:]) if b["y0"] > a["y1"]]
        gap = 1.6 * min(above) if above else 1.3 * middle
        made = []
        for n, b in enumerate(lines):
            joins = bool(made)
            if joins:
                cur, last = made[-1], lines[n - 1]
                off, back = b["x0"] - cur["anchor"], b["x0"] - last["x0"]
                size = b["max_font_size"] / cur["max_font_size"] if cur["max_font_size"] > 0 else 1.0
                apart = any(x["is_table"] or x["is_image"] for x in (cur, b)) or b["y0"] - cur["y1"] > gap or not -3 <= off <= 1.1 * middle or not 0.8 <= size <= 1.25 or (abs(off) < 3 and back < -3)
                apart = apart or (abs(off) < 3 and re.search(r"[.!?;][»\"')\]]*$", last["text"].rstrip())) or re.match(r"[-–—−•●○‣▪▫⁃]|\d+[.)]\s|\d+(\.\d+)+\s", b["text"].strip())
                joins = not apart
            if joins:
                cur["text"] += " " + b["text"]
                cur["lines"] += b["lines"]
                for k in ("x1", "y1", "max_font_size", "is_bold", "is_italic"):
                    cur[k] = max(cur[k], b[k])
                cur["x0"] = min(cur["x0"], b["x0"])
            else:
                made.append(dict(b, anchor=b["x0"]))
        gone = set()
        for i, b in enumerate(made):
            if i in gone:
                continue
            if b["is_image"]:
                near = [j for j in range(i + 1, min(i + 4, len(made))) if j not in gone and not made[j]["is_image"] and re.match(r"[Рр]исунок\s*\d+", made[j]["text"])]
                if near:
                    c = made[near[0]]
                    gone.add(near[0])
                    b = dict(b, x0=min(b["x0"], c["x0"]), x1=max(b["x1"], c["x1"]), y1=max(b["y1"], c["y1"]), text=c["text"], lines=c["lines"], max_font_size=c["max_font_size"])
                if not b["text"]:
                    continue
            want.append((doc, page, b["blk_seq"], b["x0"], b["y0"], b["x1"], b["y1"], b["text"], b["lines"], b["max_font_size"], b["is_bold"], b["is_italic"], b["is_table"]))
    got = [(r.doc_id, r.page_num, r.blk_seq, r.x0, r.y0, r.x1, r.y1, r.text, r.lines, r.max_font_size, r.is_bold, r.is_italic, r.is_table) for r in QUERIES["w11_merge_lines"](spark, DATA).collect()]
    assert sorted(got) == sorted(want)


# -- whole documents ---------------------------------------------------------------------------------------------------------------------


def test_modules_are_well_formed_and_complete(spark):
    """Files of both kinds parse, carry their code, and hold every element's text; HTML of each numbers its elements from 1."""
    import xml.etree.ElementTree as ET

    modules = QUERIES["x10_modules"](spark, DATA)
    rows = modules.collect()
    assert len(rows) == table(spark, DATA, "paras").select("doc_id").distinct().count()
    for r in rows:
        code = "040" if r.doc_id % 2 == 0 else "520"
        assert r.file == f"DMC-S5-A-029-11-00-00A-{code}A-A_001_ru-RU.xml" and f'<!ENTITY G-{r.doc_id} SYSTEM "G-{r.doc_id}.jpg" NDATA jpg>' in r.xml
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^\[]*\[[^\]]*\]>", "", r.xml).encode())
        assert root.find(".//dmIdent/dmCode").get("infoCode") == code and root.findtext(".//techName") == f"Изделие {r.doc_id}"
        body = root.find("content")[0]
        assert body.tag == ("description" if code == "040" else "procedure")
        if body.tag == "procedure":
            assert [x.tag for x in body] == ["preliminaryRqmts", "mainProcedure", "closeRqmts"] and len(body.find("mainProcedure")) >= 1
            ids = [x.get("id") for x in body.iter("proceduralStep")]
            assert ids == [f"stp-{n:05}" for n in range(1, len(ids) + 1)]
    for r in Cv.module_html(modules).collect():
        marks = [int(x) for x in re.findall(r'data-anno-idx="(\d+)"', r.html)]
        assert marks == list(range(1, len(marks) + 1))


def test_html_of_steps_tables_and_nested_lists(spark):
    xml = (
        "<dmodule><content><procedure><mainProcedure><proceduralStep><para>Снять <emphasis>блок</emphasis> &amp; крышку</para><proceduralStep><para>Отвернуть<randomList listItemPrefix=\"pf01\"><listItem><para>болт<sequentialList><listItem><para>M6</para></listItem></sequentialList></para></listItem></randomList></para></proceduralStep>"
        "<table id=\"t1\"><title>Состав</title><tgroup cols=\"1\"><thead><row><entry><para>Имя</para></entry></row></thead><tbody><row><entry>x</entry></row></tbody></tgroup></table></proceduralStep></mainProcedure></procedure></content></dmodule>"
    )
    df = spark.createDataFrame([(1, xml), (2, "<broken"), (3, None), (4, "<dmodule/>")], "doc_id long, xml string")
    got = {r.doc_id: r.html for r in Cv.module_html(df).collect()}
    assert got[2] is None and got[3] is None and got[4] == '<div class="s1000d-content"><p>No content found</p></div>'
    assert '<h3 class="step-title" data-anno-idx="1" data-anno-type="heading"><span class="step-number">1</span> Снять <strong>блок</strong> &amp; крышку</h3>' in got[1]
    assert '<span class="step-number">1.1</span> Отвернуть</p><ol class="random-list numbered" data-anno-idx="3" data-anno-type="numbered_list"><li>болт<ol class="sequential-list"><li>M6</li></ol></li></ol>' in got[1]
    assert '<table class="s1000d-table" data-anno-idx="4" data-anno-type="table" id="t1"><caption>Состав</caption><thead><tr><th>Имя</th></tr></thead><tbody><tr><td>x</td></tr></tbody></table>' in got[1]


def test_verification_of_equal_texts(spark):
    """A document whose markup agrees converges; progress counts documents."""
    from pyspark.sql import Observation

    from docloom.plans.convert_queries import heads

    paras = spark.createDataFrame([(2, i, "p", t, "Heading 1" if i == 0 else "Normal", None, None, None, None, False) for i, t in enumerate(["ОБЩИЕ СВЕДЕНИЯ", "Первый абзац этого документа без списков", "Второй абзац, также обычный и длинный"])], "doc_id long, para_idx long, kind string, text string, style string, num_id long, ilvl long, left_indent long, style_indent long, has_image boolean")
    refs = paras.select("doc_id", (F.col("para_idx") + 1).alias("idx"), F.when(F.col("para_idx") == 0, "heading").otherwise("para").alias("type"), F.substring("text", 1, 60).alias("text_start"), F.right("text", F.lit(40)).alias("text_end"), F.lit(1).cast("bigint").alias("span"))
    seen = Observation("verified")
    got = Cv.verify(paras, heads(paras), refs, progress=seen).collect()
    assert [(r.doc_id, r.left_count, r.right_count, r.matched, r.converged, r.errors) for r in got] == [(2, 3, 3, 3, True, 0)]
    assert seen.get == {"verified": 1, "converged": 1}
    assert Cv.verify(paras, heads(paras), refs.where("1 = 0")).count() == 0


def test_module_headers_beyond_long_declarations(spark):
    """A declaration of 10,000 characters hides no code; the module's own code is read, not a reference's."""
    from docloom.sources import markup as Mk

    xml = "<!DOCTYPE dmodule [" + "".join(f'<!ENTITY G{i} SYSTEM "G{i}.jpg" NDATA jpg>' for i in range(300)) + ']><dmodule><dmCode modelIdentCode="S5" systemCode="029" subSystemCode="1" assyCode="00" infoCode="040"/><techName>Насос</techName><dmRef><dmCode systemCode="000" infoCode="022"/></dmRef></dmodule>'
    got = Mk.module_headers(spark.createDataFrame([(1, xml)], "doc_id long, xml string")).first()
    assert (got.modelIdentCode, got.systemCode, got.infoCode, got.tech_name) == ("S5", "029", "040", "Насос") and "G1" in got.entities and len(got.entities) < 300


def test_annotated_pages(spark):
    """Tag and text events listed first, each annotated element then read up to the event that ends it."""
    from html.parser import HTMLParser

    class Events(HTMLParser):
        def handle_starttag(self, tag, attrs):
            listed.append(("open", dict(attrs)))

        def handle_endtag(self, tag):
            listed.append(("close", None))

        def handle_data(self, data):
            listed.append(("text", data))

    first, second = set(), set()
    pages = document_queries.with_annotations(table(spark, DATA, "pages"))
    for r in pages.collect():
        listed = []
        Events().feed(r.html or "")
        starts = [i for i, (k, a) in enumerate(listed) if k == "open" and "data-anno-idx" in a]
        for pos, i in enumerate(starts):
            depth, texts = 1, []
            for k, x in listed[i + 1 : (starts + [len(listed)])[pos + 1]]:
                depth += {"open": 1, "close": -1, "text": 0}[k]
                if depth == 0:
                    break
                if k == "text":
                    texts.append(x)
            a, whole = listed[i][1], " ".join(x.strip() for x in texts if x.strip())
            first.add((r.doc_id, int(a["data-anno-idx"]), a["data-anno-type"], whole[:60], whole[-40:], a["data-element-id"]))
            second.add((r.doc_id, pos, int(a["data-anno-idx"]), a["data-anno-type"], " ".join(texts).strip()[:120]))
    got = QUERIES["s17_annotated"](spark, DATA).select("doc_id", "idx", "type", "text_start", "text_end", "stable_id")
    assert {tuple(r) for r in got.collect()} == first and len(first) > 500
    assert {tuple(r) for r in QUERIES["s17_rendered"](spark, DATA).collect()} == second


def test_annotated_ends(spark):
    """Inner elements end outer ones, a tag without end keeps an element open, null and odd numbers mark nothing."""
    html = '<div data-anno-idx="2" data-element-id="a">x <b> y</b>z<p data-anno-idx="1" data-anno-type="p">in</p>lost</div>'
    rows = [(1, html), (2, '<p data-anno-idx="1">a<br>b</p>c<p data-anno-idx="x">d</p>'), (3, None), (4, "")]
    pages = spark.createDataFrame(rows, "doc_id long, html string")
    got = [(r.doc_id, r.idx, r.type, r.text_start, r.stable_id) for r in Mk.read_annotated(pages).collect()]
    assert sorted(got) == [(1, 1, "p", "in", ""), (1, 2, "para", "x y z", "a"), (2, 1, "para", "a b c d", "")]
    assert sorted((r.doc_id, r.pos, r.idx, r.text) for r in Mk.read_rendered(pages).collect()) == [(1, 0, 2, "x   y z"), (1, 1, 1, "in"), (2, 0, 1, "a b c d")]


def test_comparison(spark, sides):
    """A2: the phases one after the other on plain lists, then the similarity of each match and the score of each document."""
    l_rows, r_rows, left, right = sides
    ids = [by_doc(x.where("stable_id <> ''"), "idx") for x in (l_rows, r_rows)]
    exact = lambda x, y: ratio(x, y) if x and y else 0.0
    want = {}
    for doc in left.keys() | right.keys():
        ls, rs = left.get(doc, []), right.get(doc, [])
        pairs, places = [], ({}, {})
        for side, own in enumerate(ids):
            for e in own.get(doc, []):
                places[side].setdefault(e.stable_id, []).append(e.idx)
        for key, found in places[0].items():
            pairs += zip(found, places[1].get(key, []))
        free = lambda: ([a for a in ls if a.l not in {p[0] for p in pairs}], [b for b in rs if b.r not in {p[1] for p in pairs}])
        rest_l, rest_r = free()
        scored = sorted((-s, a.l, b.r) for a in rest_l for b in rest_r if (s := max(exact(a.ls, b.rs), exact(a.lf, b.rf))) >= 0.35)
        used = set(), set()
        for _, l, r in scored:
            if l not in used[0] and r not in used[1]:
                used[0].add(l)
                used[1].add(r)
                pairs.append((l, r))
        rest_l, rest_r = free()
        x, y = ([rules.TYPE_CLASS.get(t, t) for t in kinds] for kinds in ([a.lt for a in rest_l], [b.rt for b in rest_r]))
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                t[i + 1][j + 1] = t[i][j] + 1 if x[i] == y[j] else max(t[i][j + 1], t[i + 1][j])
        i, j = len(x), len(y)
        while i and j:
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                pairs.append((rest_l[i].l, rest_r[j].r))
            elif t[i - 1][j] > t[i][j - 1]:
                i -= 1
            else:
                j -= 1
        for a in free()[0]:
            own, best = set(a.ls.split()), None
            for b in rs if len(a.ls) >= 8 else []:
                s = ratio(a.le, b.re) if b.rf and len(a.le) >= 8 else 0.0
                share = len(own & set(b.rf.split())) / len(own) if len(own) >= 3 and b.rf else 0.0
                s = max(s if s >= 0.4 else 0.0, share if share >= 0.5 else 0.0)
                if s and (best is None or s > best[0]):
                    best = s, b.r
            pairs += [(a.l, best[1])] if best else []
        at_l, at_r = {a.l: a for a in ls}, {b.r: b for b in rs}
        sims, fit = [], 0
        for l, r in pairs:
            a, b = at_l[l], at_r[r]
            s, e, both = exact(a.ls, b.rs), exact(a.le, b.re), exact(f"{a.ls} {a.le}".strip(), f"{b.rs} {b.re}".strip())
            sims.append(round(max(both, (s + e) / 2 if s > 0 and e > 0 else max(s, e), max(s, e) if max(s, e) >= 0.98 else 0.0), 3))
            kinds = {rules.TYPE_CLASS.get(a.lt, a.lt), rules.TYPE_CLASS.get(b.rt, b.rt)}
            fit += len(kinds) == 1 or kinds == {"list", "heading"}
        over = [s for s in sims if s > 0]
        score = 0.0 if not ls or not rs else 0.4 * len(pairs) / max(len(ls), len(rs)) + 0.3 * (fit / len(pairs) if pairs else 0.0) + 0.3 * (sum(over) / len(over) if over else 0.0)
        want[doc] = len(ls), len(rs), len(pairs), score
    got = {r.doc_id: r for r in QUERIES["a2_comparison"](spark, DATA).collect()}
    assert {d: (r.left_count, r.right_count, r.matched) for d, r in got.items()} == {d: w[:3] for d, w in want.items()}
    assert all(abs(r.score - want[d][3]) <= 0.0005 + 1e-9 and r.converged == (r.score >= 0.95) for d, r in got.items())
    assert {r.converged for r in got.values()} == {True, False}
