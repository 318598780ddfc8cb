"""Merkle fixity audit of WARC files and their replicas.

Pages are written as WARC records, one after the other, into files; a file and each replica of it is a string of bytes, read back by its own
headers. Leaves hash records; a node hashes the ordered leaves or nodes of a range of offsets, ranges growing by FAN at each level up to the root of
the file. Replicas are compared at their roots, and only ranges whose hashes differ are descended, so the work of an audit beyond hashing follows
the damage. Where a replica was rewritten without some records, the ranges behind the loss differ as a whole; their records are then told apart
by hash, so that a record which only moved counts as sound.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed, map_rows, maybe_broadcast, numbered_copies, pick, released, small_batches, to_arrow

PAGES = {"page_id": "bigint", "url": "string", "html": "string"}
#: Bytes of the lowest ranges, ranges under a node, and levels below the root.
RANGE, FAN, LEVELS = 1 << 16, 16, 3
#: Page ids in one file, and the bytes beyond which a file is split, and those of a part then.
FILE, FILE_BYTES, PART_BYTES = 512, 32 << 20, 16 << 20
#: Files of the pages without an id, dealt by the record's hash.
LOOSE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD = "file bigint, part bigint, offset bigint, length bigint, id string, hash string"
NEXT = re.compile(rb"\r\n\r\nWARC/1\.[01]\r\n")


def record_texts(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, record), narrow: pages as WARC records. Null html is an empty body, a null url an empty one; the record's id is a hash of page_id and url."""
    df = pick(pages, "page_id", "url", "html", types=PAGES)
    body, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    uuid = F.regexp_replace(F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("~")), url)), r"(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return df.select("page_id", F.concat(head, body, F.lit("\r\n\r\n")).alias("record"))


def digest(record: Column | str) -> Column:
    return F.sha2((F.col(record) if isinstance(record, str) else record).cast("binary"), 256)


def placed(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(file, part, page_id, hash, copy, length, record): where each record belongs. Equal rows are records of their own, told apart by copy.

    FILE ids share a file; pages without an id are dealt to LOOSE negative files. A file of more than FILE_BYTES is split by hash and copy into parts
    of about PART_BYTES, so one much-crawled page, or many copies of one, make no file that a task cannot hold.
    """
    rows = record_texts(pages, date).withColumns({"hash": digest("record"), "length": F.octet_length("record").cast("bigint")})
    number = F.conv(F.substring("hash", 1, 5), 16, 10).cast("bigint")
    rows = numbered_copies(rows.withColumns({"file": F.coalesce(F.floor(F.col("page_id") / FILE), -1 - number % LOOSE).cast("bigint")}), "file", "page_id", "hash")
    large = checkpointed(rows.groupBy(F.col("file").alias("_f")).agg(F.sum("length").alias("_sum")).where(F.col("_sum") > FILE_BYTES))
    if large.isEmpty():
        part: Column = F.lit(0)
    else:
        rows = rows.join(maybe_broadcast(large), F.col("file") == F.col("_f"), "left")
        part = F.coalesce((number + F.col("copy")) % F.ceil(F.col("_sum") / PART_BYTES), F.lit(0))
    return rows.withColumn("part", part.cast("bigint")).select("file", "part", "page_id", "hash", "copy", "length", "record")


def files(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(file, part, data), the WARC files themselves: records in order of page_id, hash and copy. An empty table gives none."""
    held = F.array_sort(F.collect_list(F.struct("page_id", "hash", "copy", "record")))
    return placed(pages, date).groupBy("file", "part").agg(F.array_join(F.transform(held, lambda r: r.record), "").cast("binary").alias("data"))


def manifest(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(file, part, offset, length, page_id, hash) of every record that files() writes, from digests alone: no text is shuffled."""
    before = Window.partitionBy("file", "part").orderBy("page_id", "hash", "copy").rowsBetween(Window.unboundedPreceding, -1)
    return placed(pages, date).select("file", "part", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("offset"), "length", "page_id", "hash")


def parsed(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(start, end, record id) of the records of a WARC file; a stretch whose headers cannot be read runs to the next record, with an empty id."""
    at = 0
    while at < len(data):
        head, name, end = data.find(b"\r\n\r\n", at), "", 0
        if data.startswith(b"WARC/1.", at) and head >= 0:
            told = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in data[at:head].split(b"\r\n")[1:])}
            name = told.get(b"warc-record-id", b"").decode("latin-1")
            size = told.get(b"content-length", b"")
            end = head + 8 + int(size) if size.isdigit() else 0
        # Damage to the length shows where the record does not close.
        if not end or data[end - 4 : end] != b"\r\n\r\n":
            found = NEXT.search(data, at)
            end = found.start() + 4 if found else len(data)
        yield at, end, name
        at = end


def read(stored: DataFrame) -> DataFrame:
    """RECORD rows of files (file, part, data), by the headers of each file alone."""
    target = to_arrow(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, part, data in zip(*[c for c in b.columns]):
                raw = data.as_py() or b""
                found = list(parsed(raw))
                n = len(found)
                cols = [[file.as_py()] * n, [part.as_py()] * n, [a for a, _, _ in found], [e - a for a, e, _ in found], [i for _, _, i in found], [hashlib.sha256(raw[a:e]).hexdigest() for a, e, _ in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target)], schema=target)
        released()

    return small_batches(stored).select("file", "part", "data").mapInArrow(run, RECORD)


KEY = ["file", "part"]


def leaves(rows: DataFrame) -> DataFrame:
    """(file, part, offset, length, id, hash) of RECORD rows."""
    return rows.select(*KEY, "offset", "length", "id", "hash")


def level(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes of ranges `width` bytes wide over (file, part, offset, hash), offset being the range's start; a range holds few children."""
    children = F.array_sort(F.collect_list(F.struct("offset", "hash")))
    joined = F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws(":", c.offset.cast("string"), c.hash)), "|").cast("binary"), 256)
    start = (F.floor(F.col("offset") / width) * width).cast("bigint")
    return nodes.groupBy(*KEY, start.alias("_start")).agg(joined.alias("hash")).select(*KEY, F.col("_start").alias("offset"), "hash")


def tree(rows: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to the root of each file, each written once."""
    out = [checkpointed(leaves(rows))]
    width = RANGE
    for _ in range(LEVELS):
        out.append(checkpointed(level(out[-1], width)))
        width *= FAN
    return [*out, checkpointed(level(out[-1], 1 << 62))]


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, part, offset) of nodes that one side lacks or hashes otherwise."""
    x = a.select(*KEY, "offset", F.col("hash").alias("_a"))
    y = b.select(*KEY, "offset", F.col("hash").alias("_b"))
    return x.join(y, [*KEY, "offset"], "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*KEY, "offset")


def told_apart(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, part, offset, status, replica_offset) of the records under differing ranges: equal hashes meet in order of offset (status ok), then equal
    record ids, then what stands with equal length where the records before it end (corrupt); what is left is missing, or extra with the
    replica's offset as its own.
    """

    def numbered(df: DataFrame, by: str) -> DataFrame:
        return df.withColumn("_k", F.row_number().over(Window.partitionBy(*KEY, by).orderBy("offset")))

    def met(x: DataFrame, y: DataFrame, by: str) -> DataFrame:
        y = numbered(y, by).select(*KEY, by, "_k", *[F.col(c).alias(f"_{c}") for c in ("offset", "length", "id", "hash") if c != by])
        return numbered(x, by).join(y, [*KEY, by, "_k"], "full")

    def own_id(side: str) -> Column:
        """An empty id, of a stretch without headers, meets none."""
        return F.when(F.col("id") != "", F.col("id")).otherwise(F.concat(F.lit(side), F.col("offset").cast("string")))

    same = met(a, b, "hash")
    # Where the sound records before a record end in the replica.
    before = Window.partitionBy(*KEY).orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("_due", F.when(F.col("offset").isNotNull(), F.coalesce(F.last(F.col("_offset") + F.col("length"), ignorenulls=True).over(before), F.col("offset"))))
    same = checkpointed(same)
    sound = same.where("offset IS NOT NULL AND _offset IS NOT NULL").select(*KEY, "offset", F.lit("ok").alias("status"), F.col("_offset").alias("replica_offset"))
    left = same.where("_offset IS NULL").select(*KEY, "offset", "length", own_id("a").alias("id"), "hash", "_due")
    right = same.where("offset IS NULL").select(*KEY, F.col("_offset").alias("offset"), F.col("_length").alias("length"), F.col("_id").alias("id"), "hash").withColumn("id", own_id("b"))
    rest = checkpointed(met(left, right, "id"))
    known = rest.where("offset IS NOT NULL AND _offset IS NOT NULL").select(*KEY, "offset", F.lit("corrupt").alias("status"), F.col("_offset").alias("replica_offset"))
    lost = rest.where("_offset IS NULL").select(*KEY, "offset", F.col("_due").alias("_at"), "length")
    found = rest.where("offset IS NULL").select(*KEY, F.col("_offset").alias("_at"), F.col("_length").alias("length"), F.col("_offset").alias("_r"))
    # Of lost records of one length in a row, the first takes the stretch.
    lost = lost.withColumn("_k", F.row_number().over(Window.partitionBy(*KEY, "_at", "length").orderBy("offset")))
    last = lost.join(found.withColumn("_k", F.lit(1)), [*KEY, "_at", "length", "_k"], "full")
    status = F.when(F.col("_r").isNull(), "missing").when(F.col("offset").isNull(), "extra").otherwise("corrupt")
    return sound.union(known).union(last.select(*KEY, F.coalesce("offset", "_r").alias("offset"), status.alias("status"), F.col("_r").alias("replica_offset")))


def audit(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """(file, part, offset, status, replica_offset) of the records under ranges in which two trees differ, see told_apart().

    From the roots down, children are looked at only under ranges that differ.
    """
    found = differing(a[-1], b[-1])
    widths = [RANGE * FAN**k for k in range(LEVELS)] + [1 << 62]
    for depth in range(LEVELS, -1, -1):
        found = checkpointed(found)
        parent = found.select(*KEY, F.col("offset").alias("_start"))

        def below(nodes: DataFrame, width: int = widths[depth], parent: DataFrame = parent) -> DataFrame:
            start = (F.floor(F.col("offset") / width) * width).cast("bigint")
            return nodes.withColumn("_start", start).join(parent, [*KEY, "_start"], "left_semi").drop("_start")

        if depth:
            found = differing(below(a[depth]), below(b[depth]))
    return told_apart(below(a[0]), below(b[0]))


def report(own: DataFrame, files_a: DataFrame, files_b: DataFrame) -> DataFrame:
    """One row a record of a manifest: page_id, file, part, offset, length, sha256, status (ok, corrupt, missing) and replica_offset, where the
    replica holds it (-1 if missing). offset and length are the damaged range of a record that is not ok.

    files_a is the store that the manifest describes, files_b its replica; both are read, and located differences are all that is compared.
    """
    found = audit(tree(read(files_a)), tree(read(files_b))).where("status <> 'extra'")
    found = found.select(F.col("file").alias("_f"), F.col("part").alias("_p"), F.col("offset").alias("_o"), "status", F.col("replica_offset").alias("_r"))
    told = own.join(found, (F.col("file") == F.col("_f")) & (F.col("part") == F.col("_p")) & (F.col("offset") == F.col("_o")), "left")
    at = F.when(F.col("status").isNull(), F.col("offset")).otherwise(F.coalesce("_r", F.lit(-1)))
    return told.select("page_id", "file", "part", "offset", "length", F.col("hash").alias("sha256"), F.coalesce("status", F.lit("ok")).alias("status"), at.alias("replica_offset"))


def damaged(stored: DataFrame, lost: int = 97, altered: int = 89) -> DataFrame:
    """(file, part, data), a replica with known damage: by a hash of its record id every `lost`-th record is left out, so that what follows moves up, and
    of every `altered`-th the last byte before its closing line ends is flipped.
    """

    def one(data: bytes | None) -> bytes:
        out = []
        for a, e, name in parsed(data or b""):
            c = int(hashlib.md5(name.encode()).hexdigest()[:8], 16)
            record = data[a:e]
            if c % lost:
                out.append(record if c % altered else record[:-5] + bytes([record[-5] ^ 1]) + record[-4:])
        return b"".join(out)

    def start() -> Callable:
        return lambda file, part, data: [file, part, [one(x) for x in data]]

    return map_rows(stored.select("file", "part", "data"), start, "file bigint, part bigint, data binary")
