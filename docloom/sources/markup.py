"""Structured XML modules, annotated HTML, JSON markup, listings and settings."""

from __future__ import annotations

import configparser
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.codes import title_parts, with_code
from docloom.functions.text import col
from docloom.operators.folds import each_row

INFO = "doc_id bigint, idx bigint, type string, text_start string, text_end string, span bigint"


def _tag(x: ET.Element) -> str:
    return x.tag.rsplit("}", 1)[-1] if isinstance(x.tag, str) else ""


def _said(x: ET.Element) -> str:
    return " ".join("".join(x.itertext()).split())


#: What a tag yields as an element, and whether the walk goes on inside.
YIELDS = {"title": ("heading", False), "table": ("table", False), "figure": ("figure", False), "warning": ("warning", False), "caution": ("caution", False), "note": ("note", False)}
LISTS = {"randomList": "unnumbered_list", "sequentialList": "numbered_list"}


def walk(x: ET.Element, nested: bool = False) -> Iterator[tuple[str, str]]:
    """Elements of a module in pre-order: titles, paragraphs (their own text), lists by item, tables, figures, safety texts."""
    for child in x:
        tag = _tag(child)
        if tag in YIELDS:
            yield YIELDS[tag][0], _said(child)
        elif tag == "para":
            own = " ".join(((child.text or "") + "".join((c.tail or "") + ("" if _tag(c) in LISTS else _said(c)) for c in child)).split())
            if own:
                yield "para", own
            yield from walk(child, nested)
        elif tag in LISTS:
            kind = ("nested_" if nested else "") + LISTS[tag]
            for item in child:
                inner = [c for c in item.iter() if _tag(c) in LISTS]
                text = " ".join(_said(p) for p in item if _tag(p) == "para" and not any(_tag(c) in LISTS for c in p.iter()))
                yield kind, text or _said(item)
                if inner:
                    yield from walk(item, True)
        else:
            yield from walk(child, nested)


#: A declaration of graphics and notations as modules have it; it ends at the first closed bracket. Nothing in it is ever expanded.
DECLARED = re.compile(r"<!DOCTYPE\s+\w+\s*\[[^\]]*\]>")


def parsed(xml: str | None) -> ET.Element | None:
    """The root of a module; None for null and broken text. A declaration is left out, so entities beyond the standard five make a text broken."""
    try:
        return ET.fromstring(DECLARED.sub("", xml, count=1).encode("utf-8")) if xml else None
    except ET.ParseError:
        return None


def read_modules(files: DataFrame) -> DataFrame:
    """Rows (doc_id, xml) to INFO, idx from 1. Broken XML gives no elements. Entities are not expanded beyond the standard five."""

    def rows_of(doc: int, xml: str | None) -> Iterator[tuple]:
        root = parsed(xml)
        root = root.find(".//content") if root is not None and root.find(".//content") is not None else root
        for n, (kind, text) in enumerate(walk(root) if root is not None else [], 1):
            yield doc, n, kind, text[:60], text[-40:], 1

    return each_row(files.select(F.col("doc_id").cast("bigint"), "xml"), rows_of, INFO)


class Annotated(HTMLParser):
    """Elements that carry data-anno-idx, in stream order: number, type, stable id and pieces of text.

    An element's text ends where as many tags are closed as were opened since, or where the next annotated element starts; so an inner
    one takes what follows it. A tag without end, such as br, counts as opened. Numbers that are none mark no element.
    """

    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[int, str, str, list[str]]] = []
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        number = (own.get("data-anno-idx") or "").strip()
        if re.fullmatch(r"[+-]?[0-9]{1,18}", number):
            self.found.append((int(number), own.get("data-anno-type") or "para", own.get("data-element-id") or "", []))
            self.depth = 1
        elif self.depth:
            self.depth += 1

    def handle_endtag(self, tag: str) -> None:
        self.depth = max(0, self.depth - 1)

    def handle_data(self, data: str) -> None:
        if self.depth:
            self.found[-1][3].append(data)


def _annotated(pages: DataFrame, rows_of: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    def found(doc: int, html: str | None) -> Iterator[tuple]:
        p = Annotated()
        p.feed(html or "")
        return ((doc, *row) for row in rows_of(p.found))

    return each_row(pages.select(F.col("doc_id").cast("bigint"), "html"), found, schema)


def annotated_rows(found: list) -> list[tuple]:
    """What read_annotated gives of a page, without its id."""
    texts = [(idx, kind, " ".join(t for x in parts if (t := x.strip())), own) for idx, kind, own, parts in found]
    return [(idx, kind, t[:60], t[-40:], 1, own) for idx, kind, t, own in sorted(texts, key=lambda x: x[0])]


def read_annotated(pages: DataFrame) -> DataFrame:
    """S17, first form: rows (doc_id, html) to INFO with stable_id, by idx; pieces of text are stripped and joined by a blank."""
    return _annotated(pages, annotated_rows, INFO + ", stable_id string")


def read_rendered(pages: DataFrame) -> DataFrame:
    """S17, second form: rows (doc_id, html) to (doc_id, pos, idx, type, text) in stream order, pos from 0; the text is cut to 120 characters."""

    def rows_of(found: list) -> list[tuple]:
        return [(n, idx, kind, " ".join(parts).strip()[:120]) for n, (idx, kind, _, parts) in enumerate(found)]

    return _annotated(pages, rows_of, "doc_id bigint, pos bigint, idx bigint, type string, text string")


BLOCK_TAGS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "para", "ul": "unnumbered_list", "ol": "numbered_list", "table": "table", "img": "figure"}


def annotate_blocks(html: Column | str) -> Column:
    """Array of (anno_idx, tag, anno_type) of every opening block tag, nested ones included, in stream order from 1."""
    tags = F.regexp_extract_all(col(html), F.lit(r"(?i)<(h[1-6]|p|ul|ol|table|img)(?=[\s>/])"), F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in BLOCK_TAGS.items() for x in kv])
    return F.transform(tags, lambda t, i: F.struct((i + 1).cast("bigint").alias("anno_idx"), F.lower(t).alias("tag"), F.element_at(table, F.lower(t)).alias("anno_type")))


def dash_lists(blocks: DataFrame) -> DataFrame:
    """R2: rows (doc_id, seq, text): runs of paragraphs that open with a dash become one list, dashes dropped; other paragraphs stand alone."""
    from docloom.operators.sequence import by, run_id

    dash = F.regexp_like("text", F.lit(r"(?U)^\s*[-–—]\s"))
    key = F.when(dash, F.lit("-")).otherwise(F.col("seq").cast("string"))
    df = blocks.withColumns({"_run": run_id(key, by("doc_id", "seq")), "_dash": dash})
    items = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: F.regexp_replace(x.text, r"(?U)^\s*[-–—]\s+", ""))
    return df.groupBy("doc_id", "_run").agg(F.min("seq").alias("seq"), F.when(F.bool_or("_dash"), "list").otherwise("para").alias("type"), items.alias("items")).drop("_run")


BOX = "struct<page:int,x0:double,y0:double,x1:double,y1:double>"
MARKUP = f"dmc_string string, docx_hash string, created_at string, modified_at string, source string, elements array<struct<idx:int,type:string,type_source:string,text_start:string,text_end:string,span:int,element_id:string,stable_id:string,bbox:{BOX},bbox_pages:array<{BOX}>>>"
OVERRIDES = "reclassify_rules array<struct<text_start:string,text_end:string,to_type:string>>, skip_rules array<struct<text_start:string>>, reclassify map<string,string>, skip_elements array<int>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a fixed schema; unknown keys drop, missing ones are null; a missing path gives an empty table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def parse_markup(rows: DataFrame, column: str = "value") -> DataFrame:
    """One row a markup element from JSON texts."""
    return rows.select(F.from_json(column, MARKUP).alias("_m")).select("_m.dmc_string", "_m.source", F.explode("_m.elements").alias("_e")).select("dmc_string", "source", "_e.*")


def module_headers(files: DataFrame) -> DataFrame:
    """Rows (doc_id, xml): code attributes and names from the whole module, entity names from its first 4096 characters, as the reference lists them."""
    head = F.substring("xml", 1, 4096)
    # The module's own code comes first; references to other modules repeat the attributes.
    own = F.regexp_extract("xml", r"<dmCode\b([^>]*)>", 1)

    def attribute(name: str) -> Column:
        return F.regexp_extract(own, rf'\b{name}="([^"]*)"', 1)

    names = ["modelIdentCode", "systemCode", "subSystemCode", "assyCode", "infoCode"]
    return files.select("doc_id", *[attribute(n).alias(n) for n in names], F.regexp_extract("xml", r"<techName>([^<]*)</techName>", 1).alias("tech_name"), F.array_sort(F.array_distinct(F.regexp_extract_all(head, F.lit(r"<!ENTITY\s+(\S+)"), F.lit(1)))).alias("entities"))


def tasks(listing: DataFrame) -> DataFrame:
    """A listing (path of a file, folders above it) to one task a coded folder: its first .docx and .doc by name, temporary files left out, the group folder above, and why it is skipped."""
    # The one-row generator keeps the optimizer from copying path and split into every use.
    parts = listing.select(F.explode(F.array(F.struct("path", F.split("path", "/").alias("parts")))).alias("_l"))
    name, folder, group = F.element_at("_l.parts", -1), F.try_element_at("_l.parts", F.lit(-2)), F.try_element_at("_l.parts", F.lit(-3))
    df = parts.select(name.alias("name"), folder.alias("folder"), group.alias("group"), "_l.path").where(F.col("folder").startswith("[") & ~F.col("name").startswith("~$"))
    out = df.groupBy("folder").agg(F.min(F.when(~F.col("group").startswith("["), F.col("group"))).alias("subsystem_group"), F.min_by("path", F.when(F.lower("name").endswith(".docx"), F.col("name"))).alias("docx_path"), F.max(F.lower("name").endswith(".docx")).alias("_x"), F.min_by("path", F.when(F.lower("name").endswith(".doc"), F.col("name"))).alias("doc_path"), F.max(F.lower("name").endswith(".doc")).alias("_d"))
    out, code = with_code(out, "folder"), F.col("dm_code")
    names = title_parts("dm_title")
    skip = F.when(code.isNull(), "name").when(~F.col("_x") & ~F.col("_d"), "no document")
    return out.select("folder", "subsystem_group", "dm_code", names.tech_name.alias("tech_name"), names.info_name.alias("info_name"), F.when(F.col("_x"), F.col("docx_path")).alias("docx_path"), F.when(F.col("_d"), F.col("doc_path")).alias("doc_path"), (~F.col("_x") & F.col("_d")).alias("needs_conversion"), skip.alias("skip_reason"))


def is_hierarchical(listing: DataFrame) -> DataFrame:
    """One row: whether the first decisive folder in order of name holds coded folders rather than being one."""
    parts = F.split("path", "/")
    verdict = F.when(parts[0].startswith("["), F.lit(False)).when(F.get(parts, F.lit(1)).startswith("["), F.lit(True))
    return listing.agg(F.coalesce(F.min_by(verdict, F.when(verdict.isNotNull(), F.col("path"))), F.lit(False)).alias("hierarchical"))


def first_source(candidates: DataFrame) -> DataFrame:
    """Of candidate rows (doc_id, priority, source) the first per document."""
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("priority", "source"))).where("_n = 1").drop("_n")


def document_title(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, para_idx, text, is_heading): text before the dash of the first plain paragraph with an en dash, else a hyphen, or over 20 characters; else the first heading; else a constant."""
    t = F.col("text")
    hit = ~F.col("is_heading") & (t.contains("–") | t.contains("-") | (F.length(t) > 20))
    before = F.trim(F.when(t.contains("–"), F.substring_index(t, "–", 1)).when(t.contains("-"), F.substring_index(t, "-", 1)).otherwise(t))
    out = rows.groupBy("doc_id").agg(F.min_by(F.struct(before.alias("b")), F.when(hit, F.col("para_idx"))).alias("_a"), F.max(hit).alias("_h"), F.min_by("text", F.when(F.col("is_heading"), F.col("para_idx"))).alias("_b"), F.max("is_heading").alias("_g"))
    return out.select("doc_id", F.coalesce(F.when(F.col("_h"), F.col("_a.b")), F.when(F.col("_g"), F.col("_b")), F.lit("Документ")).alias("title"))


def texts_by_heading(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, seq, text, is_heading): joined text under each heading; a later heading of equal text overwrites; what stands before the first is dropped."""
    from docloom.operators.sequence import by, section_id

    df = rows.withColumn("_s", section_id(F.col("is_heading"), by("doc_id", "seq"))).where("_s > 0")
    texts = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("seq", "text")))), lambda x: x.text)
    out = df.groupBy("doc_id", "_s").agg(F.min_by("text", "seq").alias("heading"), F.array_join(texts, "\n").alias("text"))
    return out.groupBy("doc_id", "heading").agg(F.max_by("text", "_s").alias("text"))


def settings(text: str) -> dict[str, dict[str, str | bool | int | float]]:
    """INI text to typed values; what is no number or flag stays text."""
    p = configparser.ConfigParser()
    p.read_string(text)

    def typed(v: str) -> str | bool | int | float:
        if v.lower() in ("true", "yes", "on", "false", "no", "off"):
            return v.lower() in ("true", "yes", "on")
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                pass
        return v

    return {s: {k: typed(v) for k, v in p[s].items()} for s in p.sections()}


def forward_groups(rows: DataFrame) -> DataFrame:
    """List rows (seq, system, dmc, filename, and the sheet they come from, if there are several): rows with a system and no code open a group,
    the following of the sheet inherit it. Without a column sheet all rows are one list, which is a hand-made one of few rows.
    """
    w = Window.partitionBy(*[c for c in rows.columns if c == "sheet"]).orderBy("seq")
    opens = F.when(F.col("system").isNotNull() & F.col("dmc").isNull(), F.col("system"))
    return rows.withColumn("group", F.last(opens, ignorenulls=True).over(w)).where("dmc IS NOT NULL")
