"""Table functions (G5): per-document parsers and folds that SQL calls with LATERAL, or with TABLE(...) PARTITION BY ... ORDER BY."""

from __future__ import annotations

import re
from collections import namedtuple
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from docloom.operators import classify as C
from docloom.sources.markup import BLOCK_TAGS, INFO, Annotated, annotated_rows

TAGS = re.compile(r"<(h[1-6]|p|ul|ol|table|img)(?=[\s>/])", re.IGNORECASE | re.ASCII)


class ParseBlocks:
    """Every opening block tag of a page, nested ones included, in stream order from 1; none for null."""

    def eval(self, html: str) -> Iterator[tuple]:
        for n, m in enumerate(TAGS.finditer(html or ""), 1):
            name = m[1].lower()
            yield n, name, BLOCK_TAGS[name]


class ReadAnnotated:
    """S17, first form: a page's annotated elements, by idx; none for null."""

    def eval(self, html: str) -> Iterator[tuple]:
        page = Annotated()
        page.feed(html or "")
        yield from annotated_rows(page.found)


class ClassifyDocument:
    """Elements of one document from its rows of classify.flags, which the call partitions by doc_id and orders by para_idx.

    A task holds a document of the partition at a time, as classify.classify does; a null doc_id is a document, too.
    """

    def __init__(self) -> None:
        self.rows: list = []
        self.kind = None

    def eval(self, row: Row) -> None:
        if self.kind is None:
            self.kind = namedtuple("Paragraph", row.__fields__)
        self.rows.append(self.kind(*row))

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            yield from C.fold(self.rows)


#: SQL name -> (class, columns of its rows)
FUNCTIONS = {
    "parse_blocks": (ParseBlocks, "anno_idx bigint, tag string, anno_type string"),
    "read_annotated": (ReadAnnotated, INFO.removeprefix("doc_id bigint, ") + ", stable_id string"),
    "classify_document": (ClassifyDocument, C.ELEMENT),
}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL, for instance

    SELECT page_id, b.* FROM pages, LATERAL parse_blocks(html) b
    SELECT * FROM classify_document(TABLE(flags) PARTITION BY doc_id ORDER BY para_idx)
    """
    for name, (kind, columns) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(kind, returnType=columns))
