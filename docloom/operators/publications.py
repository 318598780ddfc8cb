"""Publication modules (A11, K3, X9): identification, table of contents and references as ordered pieces of text, never one row for all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.codes import PARTS
from docloom.functions.text import pytrim
from docloom.operators.assemble import esc, tag
from docloom.sources.store import broadcast_if_small, stored

#: What a reference's code has where a part is missing, the model aside. Fixed values.
CODE = {
    "systemDiffCode": "A", "systemCode": "00", "subSystemCode": "0", "subSubSystemCode": "0", "assyCode": "00", "disassyCode": "00", "disassyCodeVariant": "A",
    "infoCode": "000", "infoCodeVariant": "A", "itemLocationCode": "A",
}
#: What a publication has where its head says nothing. Fixed values.
HEAD = {"issuer": "SFX44", "number": "ETP05", "volume": "00", "title": "Publication Module", "enterprise": "Организация не задана", "originator": "Организация не задана"}
#: Texts that all publications share. Fixed values.
DOCTYPE = '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE pm [\n<!NOTATION jpg PUBLIC "+//ISBN 0-7923-9432-1::Graphic Notation//NOTATION Joint Photographic Experts Group Raster//EN">\n<!ENTITY PUBLICATION_LOGO SYSTEM "publication_logo.JPG" NDATA jpg>'
ROOT = '<pm xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:xlink="http://www.w3.org/1999/xlink" xsi:noNamespaceSchemaLocation="http://www.s1000d.org/S1000D_4-1/xml_schema_flat/pm.xsd">'
ISSUE, LANGUAGE = '<issueInfo issueNumber="001" inWork="00"/>', '<language languageIsoCode="ru" countryIsoCode="RU"/>'
#: The references that close every publication: id, information code, name. Fixed values.
SHARED = [("tgbExt-0000", "022", "Business rules exchange data module"), ("tgbExt-0001", "0A2", "Applicability common information repository")]
#: Order of a publication's pieces: its part, then subsystem, place in it, component by first reference, place in that, position.
ORDER = ["part", "sub", "place", "first_pos", "assy", "leaf", "pos"]
OPENING, ENTITIES, TOP, LOOSE, SUBSYSTEMS, END = range(6)
OPEN, DIRECT, COMPONENTS, CLOSE = range(4)


def code_xml(parts: dict[str, Column]) -> Column:
    return F.concat(F.lit("<dmCode"), *[F.concat(F.lit(f' {n}="'), esc(parts[n]), F.lit('"')) for n in PARTS], F.lit("/>"))


def shared_code(model: Column, info: str) -> dict[str, Column]:
    return {"modelIdentCode": model} | {n: F.lit(v) for n, v in (CODE | {"infoCode": info, "itemLocationCode": "D"}).items()}


def reference_xml(code: Column, tech: Column, info: Column, own_id: str = "") -> Column:
    """One reference to a module."""
    names = tag("dmRefAddressItems", tag("dmTitle", F.concat(tag("techName", esc(tech)), tag("infoName", esc(info)))))
    opening = F.lit(f'<dmRef id="{own_id}">' if own_id else "<dmRef>")
    return F.concat(opening, tag("dmRefIdent", F.concat(code, F.lit(ISSUE + LANGUAGE))), names, F.lit("</dmRef>"))


def _head(name: str) -> Column:
    return F.coalesce(name, F.lit(HEAD[name]))


def name(model: Column) -> Column:
    """Name of a publication's file without its ending; it is the title of the outermost entry, too."""
    return F.concat(F.lit("PMC-"), model, *[F.concat(F.lit("-"), _head(n)) for n in ("issuer", "number", "volume")], F.lit("_001-ru-RU"))


def identification(model: Column) -> Column:
    """Identification and status of a publication."""
    code = F.concat(F.lit('<pmCode modelIdentCode="'), esc(model), *[F.concat(F.lit(f'" pm{n.title()}="'), esc(_head(n))) for n in ("issuer", "number", "volume")], F.lit('"/>'))
    date = [F.coalesce(F.date_format("issued", p), F.lit("")) for p in ("yyyy", "MM", "dd")]
    issued = F.concat(F.lit('<issueDate year="'), date[0], F.lit('" month="'), date[1], F.lit('" day="'), date[2], F.lit('"/>'))
    firms = [F.concat(F.lit(f'<{t} enterpriseCode="00000">'), tag("enterpriseName", esc(_head(c))), F.lit(f"</{t}>")) for t, c in (("responsiblePartnerCompany", "enterprise"), ("originator", "originator"))]
    status = F.concat(
        F.lit('<security securityClassification="01"/><logo><symbol infoEntityIdent="PUBLICATION_LOGO"/></logo>'), *firms, F.lit("<applic><displayText><simplePara>Все</simplePara></displayText></applic>"),
        tag("brexDmRef", tag("dmRef", tag("dmRefIdent", code_xml(shared_code(model, SHARED[0][1]))))), F.lit("<qualityAssurance><unverified/></qualityAssurance>"),
    )
    address = F.concat(tag("pmIdent", F.concat(code, F.lit(LANGUAGE + ISSUE))), tag("pmAddressItems", F.concat(issued, tag("pmTitle", esc(_head("title"))))))
    return tag("identAndStatusSection", F.concat(tag("pmAddress", address), tag("pmStatus", status)))


def _entry(title: Column) -> Column:
    return F.concat(F.lit("<pmEntry>"), tag("pmEntryTitle", esc(title)))


def entries(df: DataFrame, title: Column, opens: int, closes: int) -> DataFrame:
    """An entry's opening and its end, two pieces (_at, _x) a row."""
    ends = [F.struct(F.lit(at).alias("_at"), x.alias("_x")) for at, x in ((opens, _entry(title)), (closes, F.lit("</pmEntry>")))]
    return df.select("*", F.inline(F.array(*ends)))


def _pieces(df: DataFrame, xml: Column, **at: int | str | Column) -> DataFrame:
    """(publication, ORDER, xml): pieces at one place; what is not given is empty."""
    kinds = {"sub": "string", "assy": "string", "first_pos": "bigint", "pos": "bigint"}
    given = {c: at.get(c, "" if kinds.get(c) == "string" else 0) for c in ORDER}
    return df.select("publication", *[(v if isinstance(v, Column) else F.lit(v)).cast(kinds.get(c, "int")).alias(c) for c, v in given.items()], xml.alias("xml"))


def pieces(heads: DataFrame, refs: DataFrame, graphics: DataFrame | None = None, model: str = "S5") -> DataFrame:
    """Publications as (publication, ORDER, xml), whose pieces in ORDER are the text of its file.

    heads: publication, model_ident, issuer, number, volume, title, enterprise, originator, issued; one row a publication, nulls take defaults. refs: publication,
    pos, dm_code (struct of PARTS or null), tech_name, info_name, subsystem_name and, if it is known, place, the row's own in its table, by which the first of
    several rows of one pos is told; without it their smallest name is taken. graphics: publication, pos, ident, file.
    References without a code stand first, then subsystems in order of their key with their direct references and, by first reference, their components; equal
    rows stay, as do repeated graphics, each in order of pos (null first). A subsystem is named by the first name of a direct reference, else by the first
    subsystem_name; its system is that of its first reference. Rows whose publication has no head make no file; a head without references makes one without entries.

    Entries come from aggregates, which combine before they shuffle, and join back to references for the component's place only; no task holds a publication.
    Heads are stored, and broadcast if they are few; else AQE splits a publication that holds many of the references.
    """
    told = F.coalesce("model_ident", F.lit(model))
    heads = heads.where("publication IS NOT NULL").select("publication", told.alias("model_ident"), *[n for n in (*HEAD, "issued")])
    part = {n: F.coalesce(F.col("dm_code")[n], F.lit(v)) for n, v in CODE.items()}
    code = code_xml({"modelIdentCode": F.coalesce(F.col("dm_code")["modelIdentCode"], "model_ident")} | part)
    text = reference_xml(code, F.col("tech_name"), F.col("info_name"))
    heads = stored(heads)
    known = broadcast_if_small(heads.select("publication", "model_ident"), row_bytes=256)
    place = ["place"] if "place" in refs.columns else []
    rows = refs.select("publication", "pos", *place, "dm_code", "tech_name", "info_name", "subsystem_name").join(known, "publication")
    rows = rows.select(
        "publication", "pos", *place, F.col("dm_code").isNotNull().alias("coded"), part["systemCode"].alias("system"), F.concat(part["subSystemCode"], part["subSubSystemCode"]).alias("sub"), part["assyCode"].alias("assy"),
        F.coalesce("tech_name", F.lit("")).alias("tech"), F.coalesce("subsystem_name", F.lit("")).alias("told"), text.alias("xml"),
    )
    coded, direct = rows.where("coded"), F.col("assy") == "00"
    # Nulls of pos come first, as in the order of pieces.
    nth = F.struct(F.col("pos").isNotNull(), "pos", *place).alias("nth")
    subs = coded.groupBy("publication", "sub").agg(
        F.min(F.struct(nth, "system")).alias("_s"), F.min(F.when(direct & (F.col("tech") != ""), F.struct(nth, "tech"))).alias("_n"), F.min(F.when(F.col("told") != "", F.struct(nth, "told"))).alias("_t")
    )
    subs = subs.select("publication", "sub", F.concat(F.col("_s.system"), F.lit("-"), "sub").alias("key"), F.coalesce("_n.tech", "_t.told", F.lit("")).alias("name"))
    parts = coded.where(~direct).groupBy("publication", "sub", "assy").agg(F.min(F.struct(nth, "tech")).alias("_n"))
    parts = parts.select("publication", "sub", "assy", F.col("_n.nth.pos").alias("first_pos"), F.col("_n.tech").alias("name"))
    titled = parts.join(subs.select("publication", "sub", "key"), ["publication", "sub"])
    # One pass over all references: those of a component find its place, the others have theirs from their own columns.
    own = parts.select("publication", "sub", "assy", F.lit(True).alias("coded"), F.col("first_pos").alias("_f"), F.lit(True).alias("_in"))
    placed = rows.drop(*place).join(own, ["publication", "sub", "assy", "coded"], "left")
    inside = F.coalesce("_in", F.lit(False))
    at = {"part": F.when(F.col("coded"), SUBSYSTEMS).otherwise(LOOSE), "sub": F.when(F.col("coded"), F.col("sub")).otherwise(""), "place": F.when(inside, COMPONENTS).when(F.col("coded"), DIRECT).otherwise(0)}
    at |= {"first_pos": F.when(inside, F.col("_f")).otherwise(0), "assy": F.when(inside, F.col("assy")).otherwise(""), "leaf": inside.cast("int"), "pos": F.col("pos")}
    ends = F.concat(*[reference_xml(code_xml(shared_code(F.col("model_ident"), info)), F.lit(""), F.lit(n), i) for i, info, n in SHARED], F.lit("</pmEntry></content></pm>"))
    out = [
        _pieces(heads, F.lit(DOCTYPE), part=OPENING),
        _pieces(heads, F.concat(F.lit("]>\n" + ROOT), identification(F.col("model_ident")), F.lit("<content>"), _entry(name(F.col("model_ident")))), part=TOP),
        _pieces(placed, F.col("xml"), **at),
        _pieces(entries(subs, pytrim(F.concat("key", F.lit(" "), "name")), OPEN, CLOSE), F.col("_x"), part=SUBSYSTEMS, sub=F.col("sub"), place=F.col("_at")),
        _pieces(entries(titled, pytrim(F.concat("key", F.lit("-"), "assy", F.lit(" "), "name")), 0, 2), F.col("_x"), part=SUBSYSTEMS, sub=F.col("sub"), place=COMPONENTS, first_pos=F.col("first_pos"), assy=F.col("assy"), leaf=F.col("_at")),
        _pieces(heads, ends, part=END),
    ]
    if graphics is not None:
        entity = F.concat(F.lit("<!ENTITY "), "ident", F.lit(' SYSTEM "'), F.element_at(F.split("file", "/"), -1), F.lit('" NDATA jpg>'))
        drawn = graphics.where("ident IS NOT NULL AND file IS NOT NULL").select("publication", "pos", "ident", "file").join(heads.select("publication"), "publication", "left_semi")
        out.insert(1, _pieces(drawn, entity, part=ENTITIES, pos=F.col("pos")))
    return reduce(DataFrame.unionByName, out)


def texts(made: DataFrame) -> DataFrame:
    """(publication, xml): each publication's text in one row, for those that fit one; write() takes any size."""
    rows = F.array_sort(F.collect_list(F.struct(*ORDER, "xml")))
    return made.groupBy("publication").agg(F.array_join(F.transform(rows, lambda r: r.xml), "\n").alias("xml"))


def write(made: DataFrame, path: str) -> None:
    """Publications as text: a folder each, whose files in order of their names are its text, a piece a line. Ranges are cut by order within a publication, so several tasks write a large one."""
    keys = ["publication", *ORDER]
    made.select(*keys, "xml").repartitionByRange(*keys).sortWithinPartitions(*keys).select("publication", "xml").write.partitionBy("publication").text(path)
