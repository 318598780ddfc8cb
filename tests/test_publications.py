"""Publication modules against a plain model of the whole text."""

import datetime
import random
from pathlib import Path
from xml.etree import ElementTree as ET

from docloom.functions.codes import PARTS
from docloom.operators import publications as Pu

CODE = ", ".join(f"{p}: string" for p in PARTS)
HEADS = "publication string, model_ident string, issuer string, number string, volume string, title string, enterprise string, originator string, issued date"
REFS = f"publication string, pos long, dm_code struct<{CODE}>, tech_name string, info_name string, subsystem_name string"


def of(parent, tag, text=None, **attributes):
    e = ET.SubElement(parent, tag, attributes)
    e.text = text
    return e


def reference(parent, code, tech, info, **attributes):
    r = of(parent, "dmRef", **attributes)
    i = of(r, "dmRefIdent")
    of(i, "dmCode", **code)
    of(i, "issueInfo", issueNumber="001", inWork="00")
    of(i, "language", languageIsoCode="ru", countryIsoCode="RU")
    t = of(of(r, "dmRefAddressItems"), "dmTitle")
    of(t, "techName", tech)
    of(t, "infoName", info)


def code_of(given, model):
    usual = dict(zip(PARTS, [model, "A", "00", "0", "0", "00", "00", "A", "000", "A", "A"]))
    return {p: usual[p] if given is None or given[i] is None else given[i] for i, p in enumerate(PARTS)}


def content(model, title, refs):
    """The content element: references in order, nested by subsystem and component."""
    root = ET.Element("content")
    main = of(root, "pmEntry")
    of(main, "pmEntryTitle", title)
    refs = sorted(refs, key=lambda r: (r[1] is not None, r[1] or 0))
    tree = {}
    for _, _, code, tech, info, told in refs:
        full = code_of(code, model)
        if code is None:
            reference(main, full, tech or "", info or "")
            continue
        sub = tree.setdefault(full["subSystemCode"] + full["subSubSystemCode"], {"system": full["systemCode"], "names": [], "told": [], "direct": [], "parts": {}})
        sub["told"].append(told or "")
        row = (full, tech or "", info or "")
        if full["assyCode"] == "00":
            sub["names"].append(tech or "")
            sub["direct"].append(row)
        else:
            sub["parts"].setdefault(full["assyCode"], []).append(row)
    for key, sub in sorted(tree.items()):
        e = of(main, "pmEntry")
        first = next((n for n in [*sub["names"], *sub["told"]] if n), "")
        of(e, "pmEntryTitle", f"{sub['system']}-{key} {first}".strip())
        for row in sub["direct"]:
            reference(e, *row)
        for assy, rows in sub["parts"].items():
            c = of(e, "pmEntry")
            of(c, "pmEntryTitle", f"{sub['system']}-{key}-{assy} {rows[0][1]}".strip())
            for row in rows:
                reference(c, *row)
    shared = dict(zip(PARTS, [model, "A", "00", "0", "0", "00", "00", "A", "022", "A", "D"]))
    reference(main, shared, "", "Business rules exchange data module", id="tgbExt-0000")
    reference(main, shared | {"infoCode": "0A2"}, "", "Applicability common information repository", id="tgbExt-0001")
    return root


def flat(e):
    return (e.tag, tuple(sorted(e.attrib.items())), e.text.strip() if e.text else "", tuple(map(flat, e)))


def case(seed=5, n=120):
    r = random.Random(seed)
    names = [None, "", "Насос", "A & <b>", '"q"', "  x "]
    heads = [("p0", "M&1", "I", "N", "V", "T <1>", "E", "O", datetime.date(2024, 3, 9)), ("p1", *[None] * 8), ("empty", *[None] * 8), (None, *[None] * 8)]
    refs = []
    for k in range(n):
        code = None if r.random() < 0.15 else tuple(r.choice([None, v]) for v in ["ZZ", "B", r.choice(["01", "02"]), r.choice("12"), r.choice("13"), r.choice(["00", "05", "07"]), "01", "C", "040", "B", "D"])
        refs.append((r.choice(["p0", "p1", "gone", None]), None if k == 7 else k * 3, code, r.choice(names), r.choice(names), r.choice(names)))
    return heads, refs


def test_whole_publications_equal_model(spark, tmp_path):
    heads, refs = case()
    graphics = [("p0", 2, "G2", "a/b/z.jpg"), ("p0", 1, "G1", "y.jpg"), ("p0", 3, "G2", "a/b/z.jpg"), ("gone", 1, "G", "g.jpg"), ("p1", 1, None, "n.jpg")]
    shuffled = random.Random(1).sample(refs, len(refs))
    extra = spark.createDataFrame([(*x, "clash") for x in shuffled], REFS + ", xml string")
    made = Pu.pieces(spark.createDataFrame(heads, HEADS), extra, spark.createDataFrame(graphics, "publication string, pos long, ident string, file string"))
    got = {r.publication: r.xml for r in Pu.texts(made).collect()}
    assert set(got) == {"p0", "p1", "empty"}
    for pub, model, title in (("p0", "M&1", "PMC-M&1-I-N-V_001-ru-RU"), ("p1", "S5", "PMC-S5-SFX44-ETP05-00_001-ru-RU"), ("empty", "S5", "PMC-S5-SFX44-ETP05-00_001-ru-RU")):
        root = ET.fromstring(got[pub].encode())
        assert flat(root.find("content")) == flat(content(model, title, [x for x in refs if x[0] == pub]))
    lines = got["p0"].split("\n")
    assert [x for x in lines if x.startswith("<!ENTITY G")] == ['<!ENTITY G1 SYSTEM "y.jpg" NDATA jpg>', '<!ENTITY G2 SYSTEM "z.jpg" NDATA jpg>', '<!ENTITY G2 SYSTEM "z.jpg" NDATA jpg>']
    root = ET.fromstring(got["p0"].encode())
    assert root.find(".//pmCode").attrib == {"modelIdentCode": "M&1", "pmIssuer": "I", "pmNumber": "N", "pmVolume": "V"}
    assert root.find(".//issueDate").attrib == {"year": "2024", "month": "03", "day": "09"} and root.findtext(".//pmTitle") == "T <1>"
    assert [e.text for e in root.iter("enterpriseName")] == ["E", "O"] and [e.tag for e in root.find(".//pmStatus")][-2:] == ["brexDmRef", "qualityAssurance"]
    assert [e.text for e in ET.fromstring(got["p1"].encode()).iter("enterpriseName")] == [Pu.HEAD["enterprise"]] * 2
    Pu.write(made, str(tmp_path / "out"))
    for pub, text in got.items():
        files = sorted(Path(tmp_path / "out" / f"publication={pub}").glob("part-*"))
        assert "".join(f.read_text() for f in files) == text + "\n"


def test_no_publications(spark):
    assert Pu.pieces(spark.createDataFrame([], HEADS), spark.createDataFrame(case()[1], REFS)).count() == 0
    assert Pu.pieces(spark.createDataFrame([case()[0][1]], HEADS), spark.createDataFrame([], REFS)).count() == 3


def test_first_of_equal_positions_names_entries(spark):
    """The first row of the table names an entry, not the smallest name; without places the smallest does, so reruns agree."""
    code = tuple({"systemCode": "27", "subSystemCode": "1", "subSubSystemCode": "2", "assyCode": "03"}.get(p) for p in PARTS)
    head = [("p", *[None] * 8)]
    refs = [("p", 5, code, "b", "", ""), ("p", 5, code, "c", "", ""), ("p", 5, code, "a", "", ""), ("p", 7, code, "0", "", "")]

    def titles(rows, schema):
        made = Pu.pieces(spark.createDataFrame(head, HEADS), spark.createDataFrame(rows, schema).repartition(3)).where("xml LIKE '%27-12-03%'")
        return [r.xml for r in made.collect()]

    assert titles([(*r, (i // 2, i)) for i, r in enumerate(refs)], REFS + ", place struct<file: int, row: int>") == ["<pmEntry><pmEntryTitle>27-12-03 b</pmEntryTitle>"]
    assert titles(refs, REFS) == ["<pmEntry><pmEntryTitle>27-12-03 a</pmEntryTitle>"]


def test_query_takes_the_first_row_of_equal_positions(spark, tmp_path):
    """The query equals its SQL where the first row of the lowest position has not the smallest name."""
    import duckdb

    from docloom.plans import ORACLES, QUERIES

    con, path = duckdb.connect(), f"{tmp_path}/lineitem.parquet"
    con.sql(f"COPY (SELECT 0::bigint AS l_orderkey, 13::bigint + 5 * v AS l_partkey, 1::bigint AS l_suppkey, 1 AS l_linenumber FROM (VALUES (7), (3), (9), (1)) AS x(v)) TO '{path}'")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    got = QUERIES["k3_publication_rows"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['k3_publication_rows']})").fetchall())
