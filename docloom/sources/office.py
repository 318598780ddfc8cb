"""Word-processing documents (OOXML) read with the standard library: paragraphs, tables, text boxes and images as rows."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterable, Iterator
from itertools import count, groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.folds import each_row, ordered_fold

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
V = "{urn:schemas-microsoft-com:vml}"
ROWS = "doc_id bigint, pos bigint, kind string, para_idx bigint, table_idx bigint, row_no bigint, col_no bigint, cell bigint, text string, style string, num_id bigint, ilvl bigint, left_indent bigint, has_image boolean, image_ref string, error string"


CELLS = "doc_id bigint, table_idx bigint, row_no bigint, col_no bigint, paragraphs array<string>, error string"
IMAGES = "doc_id bigint, image_no bigint, kind string, idx bigint, start_line bigint, start_char bigint, end_line bigint, end_char bigint, context string, image binary, error string"
#: What graphics are named by if nothing else is said. Fixed value.
GRAPHIC_PREFIX = "GS5-A-120-10-00-00A-041A-A_001_RU-RU"
#: Files of an output batch, and rows of one that may hold images.
FILES = 500
#: What is wrong with a file that cannot be read.
BROKEN = (zipfile.BadZipFile, KeyError, ET.ParseError, TypeError, ValueError)


def _runs(p: ET.Element) -> Iterator[ET.Element]:
    """The runs of a paragraph's own line, those of links too; text boxes inside a run are not part of the line."""
    for x in p:
        if x.tag == W + "r":
            yield x
        elif x.tag == W + "hyperlink":
            yield from x.findall(W + "r")


def _text(p: ET.Element) -> str:
    def said(x: ET.Element) -> str:
        if x.tag == W + "t":
            return x.text or ""
        if x.tag == W + "br":
            return "" if x.get(W + "type") in ("page", "column") else "\n"
        return {W + "cr": "\n", W + "tab": "\t", W + "ptab": "\t", W + "noBreakHyphen": "-"}.get(x.tag, "")

    return "".join(said(x) for run in _runs(p) for x in run)


def _number(p: ET.Element, path: str, scale: int = 1) -> int | None:
    x = p.find(path)
    v = None if x is None else x.get(W + ("left" if path.endswith("ind") else "val"))
    return int(float(v) * scale) if v not in (None, "") else None


def _paragraph(p: ET.Element) -> dict:
    style = p.find(f"{W}pPr/{W}pStyle")
    blip = next(p.iter(A + "blip"), None)
    return {
        "text": _text(p), "style": style.get(W + "val") if style is not None else "Normal", "num_id": _number(p, f"{W}pPr/{W}numPr/{W}numId"), "ilvl": _number(p, f"{W}pPr/{W}numPr/{W}ilvl"),
        "left_indent": _number(p, f"{W}pPr/{W}ind", 635), "has_image": blip is not None, "image_ref": blip.get(R + "embed") if blip is not None else None,
    }


def _body(z: zipfile.ZipFile) -> ET.Element:
    body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
    return ET.Element(W + "body") if body is None else body


def _grid(table: ET.Element) -> Iterator[list[ET.Element]]:
    """A table's rows; a cell that spans columns or rows is given once for each place that it takes."""
    above: dict[int, ET.Element] = {}
    for row in table.findall(W + "tr"):
        at, cells, here = _number(row, f"{W}trPr/{W}gridBefore") or 0, [], {}
        for cell in row.findall(W + "tc"):
            merge = cell.find(f"{W}tcPr/{W}vMerge")
            if merge is not None and merge.get(W + "val", "continue") == "continue":
                cell, wide = above.get(at, cell), cell
            else:
                wide = cell
            span = _number(wide, f"{W}tcPr/{W}gridSpan") or 1
            cells += [cell] * span
            here |= {at + i: cell for i in range(span)}
            at += span
        above = here
        yield cells


def parse(data: bytes) -> Iterator[dict]:
    """Body rows in order; a table gives one row a cell; text boxes of a paragraph follow as kind box."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _body(z)
    paras = tables = pos = 0
    for x in body:
        if x.tag == W + "p":
            yield {"pos": pos, "kind": "p", "para_idx": paras} | _paragraph(x)
            for t in x.iter(W + "txbxContent"):
                for p in t.iter(W + "p"):
                    yield {"pos": pos, "kind": "box", "para_idx": paras} | _paragraph(p)
            paras += 1
        elif x.tag == W + "tbl":
            known: dict[int, int] = {}
            for r, row in enumerate(_grid(x)):
                for c, cell in enumerate(row):
                    number = known.setdefault(id(cell), len(known))
                    parts = [_paragraph(p) for p in cell.findall(W + "p")]
                    one = parts[0] if parts else {}
                    yield {"pos": pos, "kind": "table", "table_idx": tables, "row_no": r, "col_no": c, "cell": number} | one | {"text": "\n".join(p["text"] for p in parts), "has_image": any(p["has_image"] for p in parts)}
            tables += 1
        else:
            continue
        pos += 1


def boxed_cells(data: bytes) -> Iterator[dict]:
    """Cells of the tables in floating text boxes; of the document's own tables if there are none."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _body(z)

    def lines(texts: Iterable[str]) -> list[str]:
        return [t.strip() for t in texts if t.strip()]

    floating = body.iterfind(f".//{V}shape//{V}textbox//{W}txbxContent//{W}tbl")
    grids = [[[lines("".join(t.text or "" for t in p.iter(W + "t")) for p in cell.findall(W + "p")) for cell in row.findall(W + "tc")] for row in t.findall(W + "tr")] for t in floating]
    grids = [kept for g in grids if (kept := [row for row in g if row])]
    if not grids:
        grids = [[[lines("\n".join(_text(p) for p in cell.findall(W + "p")).split("\n")) for cell in row] for row in _grid(t)] for t in body.findall(W + "tbl")]
    for i, grid in enumerate(grids):
        for r, row in enumerate(grid):
            for c, parts in enumerate(row):
                yield {"table_idx": i, "row_no": r, "col_no": c, "paragraphs": parts}


def _image_id(p: ET.Element) -> str | None:
    """The relation of a paragraph's first image, the drawings of its runs before older ones."""
    drawn = (b.get(R + "embed") for r in p.findall(W + "r") for b in r.iter(A + "blip"))
    older = (v.get(R + "id") for v in p.iter(V + "imagedata"))
    return next((i for i in (*drawn, *older) if i), None)


def illustrations_of(data: bytes) -> Iterator[dict]:
    """The stored images in order of appearance, in paragraphs and in table cells, with the text positions around them.

    Lines count from 1 over the whole document, characters from the last line break.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body, names = _body(z), set(z.namelist())
        known = ET.fromstring(z.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in names else []
        parts = {x.get("Id"): posixpath.normpath(posixpath.join("/word", x.get("Target", ""))).lstrip("/") for x in known if "image" in x.get("Target", "") and x.get("TargetMode") != "External"}
        places = {W + "p": count(), W + "tbl": count()}
        line, char, found = 1, 0, 0
        for x in body:
            if x.tag not in places:
                continue
            idx, own = next(places[x.tag]), x.tag == W + "p"
            for p in [x] if own else [p for row in _grid(x) for cell in row for p in cell.findall(W + "p")]:
                text, start = _text(p), (line, char)
                line += text.count("\n")
                char = len(text.rsplit("\n", 1)[-1]) + (0 if "\n" in text else char)
                part = parts.get(_image_id(p))
                if part in names:
                    said = text.strip()
                    yield {
                        "image_no": found, "kind": "p" if own else "table", "idx": idx, "start_line": start[0], "start_char": start[1], "end_line": line, "end_char": char,
                        "context": said[:100] + ("..." if len(said) > 100 else ""), "image": z.read(part),
                    }
                    found += 1


def _each(files: DataFrame, rows_of: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    """What rows_of finds in each (doc_id, content). A file that cannot be read gives one row with error and fails nothing else."""

    def one(doc: int, data: bytes) -> list[dict]:
        try:
            return [r | {"doc_id": doc} for r in rows_of(data)]
        except BROKEN as e:
            return [{"doc_id": doc, "error": f"{type(e).__name__}: {e}"}]

    names = T.StructType.fromDDL(schema).fieldNames()
    return each_row(files.select(F.col("doc_id").cast("bigint"), "content"), lambda *file: ([r.get(c) for c in names] for r in one(*file)), schema, rows=FILES)


def read(files: DataFrame) -> DataFrame:
    """Rows (doc_id, content) to ROWS."""
    return _each(files, parse, ROWS)


def box_tables(files: DataFrame) -> DataFrame:
    """Rows (doc_id, content) to CELLS."""
    return _each(files, boxed_cells, CELLS)


def illustrations(files: DataFrame, prefix: str = GRAPHIC_PREFIX) -> DataFrame:
    """Rows (doc_id, content) to IMAGES with the name of each graphic; numbers start at 0 in each document."""
    name = F.concat(F.lit(f"{prefix}-GRAPHIC"), F.col("image_no").cast("string"))
    return _each(files, illustrations_of, IMAGES).withColumn("name", name)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """All .docx files under a folder, temporary ones left out; doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return read(files.where(~name.startswith("~$")).select(F.xxhash64("path").alias("doc_id"), "content"))


def escaped(x: str) -> str:
    return x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _table(rows: list[list[str]]) -> str:
    return "<w:tbl>" + "".join("<w:tr>" + "".join("<w:tc>" + "".join(f'<w:p><w:r><w:t xml:space="preserve">{escaped(t)}</w:t></w:r></w:p>' for t in c.split("\n")) + "</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"


def build(paragraphs: list[tuple[str, str]], table: list[list[str]] | None = None, images: list[bytes | None] | None = None, boxed: list[list[str]] | None = None) -> bytes:
    """A minimal document of (text, style) paragraphs, their images, one table and one in a floating text box, for round trips."""
    images = images or [None] * len(paragraphs)
    drawn = [f'<w:r><w:drawing><a:blip r:embed="rId{i}"/></w:drawing></w:r>' if x is not None else "" for i, x in enumerate(images)]
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{escaped(s)}"/></w:pPr><w:r><w:t xml:space="preserve">{escaped(t)}</w:t></w:r>{d}</w:p>' for (t, s), d in zip(paragraphs, drawn))
    if boxed:
        body += f"<w:p><w:r><w:pict><v:shape><v:textbox><w:txbxContent>{_table(boxed)}</w:txbxContent></v:textbox></v:shape></w:pict></w:r></w:p>"
    if table:
        body += _table(table)
    spaces = "".join(f' xmlns:{k}="{n[1:-1]}"' for k, n in (("w", W), ("a", A), ("r", R), ("v", V)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("word/document.xml"), f'<?xml version="1.0" encoding="UTF-8"?><w:document{spaces}><w:body>{body}</w:body></w:document>')
        held = {i: x for i, x in enumerate(images) if x is not None}
        if held:
            each = "".join(f'<Relationship Id="rId{i}" Type="{R[1:-1]}/image" Target="media/image{i}.jpg"/>' for i in held)
            z.writestr(zipfile.ZipInfo("word/_rels/document.xml.rels"), f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{each}</Relationships>')
            for i, x in held.items():
                z.writestr(zipfile.ZipInfo(f"word/media/image{i}.jpg"), x)
    return out.getvalue()


def _tasks(rows: DataFrame) -> int:
    """Tasks that write documents: dear for their size, so not to be coalesced by it."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def write(paragraphs: DataFrame) -> DataFrame:
    """Rows (doc_id, seq, text, style, and image, if there is such a column) to (doc_id, content), one document each."""
    more = [c for c in paragraphs.columns if c == "image"]

    def one(rows: list) -> Iterator[tuple]:
        images = [r.image for r in rows] if more else None
        yield rows[0].doc_id, build([(r.text or "", r.style or "Normal") for r in rows], images=images)

    return ordered_fold(paragraphs.select("doc_id", "seq", "text", "style", *more), ["doc_id"], ["seq"], one, "doc_id bigint, content binary", _tasks(paragraphs), FILES)


def write_grids(cells: DataFrame) -> DataFrame:
    """Cells (doc_id, row_no, col_no, text, boxed) to (doc_id, content): one table each, in a floating text box or in the document itself."""

    def one(rows: list) -> Iterator[tuple]:
        grid = [[c.text or "" for c in row] for _, row in groupby(rows, lambda c: c.row_no)]
        boxed = bool(rows[0].boxed)
        yield rows[0].doc_id, build([], None if boxed else grid, boxed=grid if boxed else None)

    return ordered_fold(cells.select("doc_id", "row_no", "col_no", "text", "boxed"), ["doc_id"], ["row_no", "col_no"], one, "doc_id bigint, content binary", _tasks(cells), FILES)


#: Titles that name the book and not the document. Fixed values.
BOILERPLATE = ["су-57", "руководство по технической эксплуатации", "руководство по техническому обслуживанию"]


def titles(rows: DataFrame) -> DataFrame:
    """(doc_id, title): the first real paragraph among the first 15: 4 or more characters, neither boilerplate nor numbered."""
    from docloom.functions.text import clean_title, like, pytrim

    t = pytrim("text")
    boilerplate = F.lower(t).isin(*BOILERPLATE)
    ok = rows.where("kind = 'p'").where((F.col("para_idx") < 15) & (F.length(t) >= 4) & ~boilerplate & ~like(t, r"(?U)^\d+[.)]?\s"))
    return ok.groupBy("doc_id").agg(F.min_by(clean_title("text"), "para_idx").alias("title"))


def tables_with_titles(rows: DataFrame) -> DataFrame:
    """One row a table: id tab-n, title from the paragraph right before it, first row as headers, the rest as body."""
    heads = rows.where("kind = 'p'").select("doc_id", (F.col("pos") + 1).alias("pos"), F.regexp_extract("text", r"(?iuU)^\s*таблица\s*\d+\s*[–—-]?\s*(.*)$", 1).alias("title"))
    cells = rows.where("kind = 'table'").groupBy("doc_id", "table_idx", "pos", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda x: x.text).alias("cells"))
    grid = cells.groupBy("doc_id", "table_idx", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda x: x.cells).alias("rows"))
    out = grid.join(heads, ["doc_id", "pos"], "left")
    return out.select("doc_id", F.concat(F.lit("tab-"), (F.col("table_idx") + 1).cast("string")).alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.col("rows")[0].alias("headers"), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))).alias("body"))
