"""Queries of schema validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import assemble as A, schema
from docloom.plans.convert_queries import ELEMENTS, elements
from docloom.plans.registry import query
from docloom.sources import trees

#: A schema of the modules below: a title, warnings, then notes and paragraphs, then inner sections.
SECTIONS = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
<xs:element name="dmodule"><xs:complexType><xs:sequence><xs:element ref="levelledPara" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element>
<xs:element name="levelledPara"><xs:complexType><xs:sequence><xs:element ref="title" minOccurs="0"/><xs:element ref="warning" minOccurs="0" maxOccurs="unbounded"/><xs:group ref="told" minOccurs="0" maxOccurs="unbounded"/><xs:element ref="levelledPara" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element>
<xs:group name="told"><xs:choice><xs:element ref="note"/><xs:element ref="para"/></xs:choice></xs:group>
<xs:complexType name="text" mixed="true"><xs:sequence/><xs:attribute name="id" type="xs:ID"/></xs:complexType>
<xs:element name="title" type="text"/><xs:element name="warning" type="text"/><xs:element name="para" type="text"/>
<xs:element name="note"><xs:complexType mixed="true"><xs:sequence/><xs:attribute name="noteType" type="noteTypes" use="required"/></xs:complexType></xs:element>
<xs:simpleType name="noteTypes"><xs:restriction base="xs:NMTOKEN"><xs:enumeration value="nt01"/><xs:enumeration value="nt02"/></xs:restriction></xs:simpleType>
</xs:schema>"""


def files(paras: DataFrame) -> DataFrame:
    """Modules whose sections keep the order of the source, with ids and kinds of notes that are partly wrong."""
    tag = F.when(F.col("type") == "header", "title").when(F.col("type").isin("warning", "note"), F.col("type")).otherwise("para")
    mark = F.when(tag == "para", F.format_string(' id="p%d"', F.col("seq") % 50)).when((tag == "note") & (F.col("seq") % 5 > 0), F.format_string(' noteType="nt0%d"', F.col("seq") % 4)).otherwise("")
    rows = elements(paras).withColumn("section", F.sum((F.col("type") == "header").cast("int")).over(Window.partitionBy("doc_id").orderBy("seq")))
    rows = rows.select("doc_id", "section", "seq", F.concat(F.lit("<"), tag, mark, F.lit(">"), A.esc("content"), F.lit("</"), tag, F.lit(">")).alias("x"))
    parts = rows.groupBy("doc_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x"))), lambda r: r.x), "").alias("x"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "x"))), lambda r: A.tag("levelledPara", r.x)), "\n")
    return parts.groupBy("doc_id").agg(F.concat(F.lit("<dmodule>\n"), whole, F.lit("</dmodule>")).alias("xml"))


#: The same rules over the rows: the first warning after a note or paragraph of its section ends what is looked at there.
_ROWS = f"""e AS ({ELEMENTS}), s AS (SELECT *, sum((type = 'header')::int) OVER (PARTITION BY doc_id ORDER BY seq) AS section, CASE type WHEN 'header' THEN 'title' WHEN 'warning' THEN 'warning' WHEN 'note' THEN 'note' ELSE 'para' END AS tag FROM e),
r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY section) + 1 AS line, tag = 'warning' AND coalesce(bool_or(tag IN ('note', 'para')) OVER (PARTITION BY doc_id, section ORDER BY seq), false) AS bad FROM s),
h AS (SELECT *, count(*) FILTER (bad) OVER (PARTITION BY doc_id, section ORDER BY seq) AS k FROM r)"""
_ERRORS = """x AS (SELECT doc_id, line, tag, content, NULL AS attribute, 'Element ''warning'': This element is not expected. Expected is one of ( note, para, levelledPara ).' AS message FROM h WHERE bad AND k = 1
  UNION ALL SELECT doc_id, line, tag, content, 'noteType', CASE WHEN seq % 5 = 0 THEN 'Element ''note'': The attribute ''noteType'' is required but missing.' ELSE 'Element ''note'', attribute ''noteType'': [facet ''enumeration''] The value ''nt0' || (seq % 4) || ''' is not an element of the set {''nt01'', ''nt02''}.' END FROM h WHERE k = 0 AND tag = 'note' AND (seq % 5 = 0 OR seq % 4 IN (0, 3))
  UNION ALL SELECT doc_id, line, tag, content, 'id', 'Element ''para'', attribute ''id'': The ID ''p' || (seq % 50) || ''' is already defined.' FROM (SELECT * FROM h WHERE k = 0 AND tag = 'para' QUALIFY row_number() OVER (PARTITION BY doc_id, seq % 50 ORDER BY seq) > 1))"""


@query("v1_schema_errors", "paras", sql=f"WITH {_ROWS}, {_ERRORS} SELECT doc_id, line, tag, rtrim(substring(content, 1, 60)) AS text, attribute, message FROM x")
def schema_errors(paras: DataFrame) -> DataFrame:
    """V1: every violation, with the element it stands at."""
    found = schema.violations(trees.nodes(files(paras)), schema.compiled({"sections": SECTIONS}), ["dmodule"])
    return found.select("doc_id", "line", "tag", F.rtrim("text").alias("text"), "attribute", "message")


@query("v1_verdicts", "paras", sql=f"WITH {_ROWS}, {_ERRORS}, c AS (SELECT doc_id, count(*) AS errors FROM x GROUP BY doc_id) SELECT doc_id, errors IS NULL AS valid, coalesce(errors, 0) AS errors FROM (SELECT DISTINCT doc_id FROM e) LEFT JOIN c USING (doc_id)")
def schema_verdicts(paras: DataFrame) -> DataFrame:
    """V1: valid or not, and the number of violations, for every document."""
    return schema.verdicts(trees.nodes(files(paras)), schema.compiled({"sections": SECTIONS}), ["dmodule"])
