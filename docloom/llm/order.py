"""Training-order materialisation: every sequence gets a global slot by a keyed permutation, and slots become fixed-stride shards.

Documents are cut into sequences of STRIDE tokens and numbered densely. A Feistel network over the next even power of two, walked
until it lands below the number of sequences, permutes these numbers without a table. Slots are dealt to tasks in ranges and stored as
shards; a sequence stands at offset (slot - first slot) * stride in its shard, so readers go on from any slot by arithmetic alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed, maybe_broadcast, numbered_copies, pick, released, small_batches, to_arrow

#: Tokens of a sequence, sequences of a shard, rounds of the network, bytes of shards that one task writes, and tasks at most.
STRIDE, SLOTS, ROUNDS, TASK_BYTES, TASKS = 1024, 4096, 6, 32 << 20, 20_000
#: Bytes of a token: a text's tokens are its bytes, token ids are little-endian unsigned 32-bit integers.
TEXT_WIDTH, IDS_WIDTH = 1, 4
TYPES = {"doc_id": "bigint", "text": "string", "ids": "array<int>"}
SEQUENCE = "slot bigint, doc_id bigint, part bigint, n_tokens bigint, data binary"
SHARD = "shard bigint, first_slot bigint, slots bigint, doc_ids array<bigint>, parts array<bigint>, lengths array<bigint>, data binary"


def round_keys(key: str) -> np.ndarray:
    raw = hashlib.blake2b(key.encode(), digest_size=8 * ROUNDS).digest()
    return np.frombuffer(raw, "<u8")


def permute(x: np.ndarray, n: int, key: str) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1."""
    half = np.uint64(max(1, (max(2, n) - 1).bit_length() + 1 >> 1))
    mask = np.uint64((1 << int(half)) - 1)
    keys = round_keys(key)
    out = x.astype(np.uint64)
    left = np.ones(len(out), bool)
    while left.any():
        v = out[left]
        a, b = v >> half, v & mask
        for k in keys:
            f = (b ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        out[left] = a << half | b
        left = out >= n
    return out.astype(np.int64)


def source(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, body, th, tokens) and the bytes of a token: body is the column ids (as bpe.encode() gives it) where there is one, else text."""
    if any(c.lower() == "ids" for c in docs.columns):
        df, width = pick(docs, "doc_id", "ids", types=TYPES).withColumnRenamed("ids", "body"), IDS_WIDTH
        tokens: Column = F.size("body")
    else:
        df, width = pick(docs, "doc_id", "text", types=TYPES).withColumnRenamed("text", "body"), TEXT_WIDTH
        tokens = F.octet_length("body")
    df = df.where("body IS NOT NULL").withColumns({"th": F.xxhash64("body"), "tokens": tokens.cast("bigint")})
    return df.where("tokens > 0"), width


def numbered(rows: DataFrame, stride: int = STRIDE) -> DataFrame:
    """(doc_id, th, tokens, n, base, total): of documents that are equal in the first three, the sequences of one, the number of the first sequence
    of the first of them, and the number of all sequences. No body moves.

    Numbers are prefix sums in two steps: within buckets of about fifty thousand documents, then over the buckets.
    """
    key = ["doc_id", "th", "tokens"]
    df = checkpointed(rows.groupBy(*key).agg(F.count("*").alias("_copies"))).withColumn("n", F.ceil(F.col("tokens") / stride).cast("bigint"))
    buckets = max(16, df.count() // 50_000)
    df = df.withColumns({"_b": F.pmod(F.xxhash64(*key), F.lit(buckets)), "_all": F.col("n") * F.col("_copies")})
    sums = df.groupBy("_b").agg(F.sum("_all").alias("_s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("_b").alias("_c"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"), F.sum("_s").over(Window.partitionBy()).alias("total"))
    own = Window.partitionBy("_b").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_before", F.coalesce(F.sum("_all").over(own), F.lit(0)))
    return df.join(starts, F.col("_b") == F.col("_c")).select(*key, "n", (F.col("_start") + F.col("_before")).alias("base"), "total")


def sequences(docs: DataFrame, key: str = "order", stride: int = STRIDE) -> tuple[DataFrame, int, int]:
    """SEQUENCE rows, unordered; the number of all sequences; the bytes of a token. Null and empty documents have none.

    Equal rows, as mixing emits them, each have sequences and slots of their own.
    """
    rows, width = source(docs)
    table = checkpointed(numbered(rows, stride))
    total = table.agg(F.max("total")).first()[0] or 0
    table = maybe_broadcast(table.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), F.col("tokens").alias("_tokens"), "n", "base"))
    rows = numbered_copies(rows, "doc_id", "th", "tokens")
    rows = rows.join(table, (F.col("th") == F.col("_th")) & (F.col("tokens") == F.col("_tokens")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    target = to_arrow(SEQUENCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            bodies = b.column(1)
            for i, (doc, base) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                raw = bodies[i].as_py().encode("utf-8", "surrogatepass") if width == TEXT_WIDTH else bodies[i].values.to_numpy(zero_copy_only=False).astype("<i4").tobytes()
                step = stride * width
                n = -(-len(raw) // step)
                out[0] += permute(np.arange(base, base + n), total, key).tolist()
                out[1] += [doc] * n
                out[2] += range(n)
                for at in range(0, len(raw), step):
                    part = raw[at : at + step]
                    out[3].append(len(part) // width)
                    out[4].append(part.ljust(step, b"\0"))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target)], schema=target)
        released()

    rows = small_batches(rows).select("doc_id", "body", (F.col("base") + F.col("copy") * F.col("n")).alias("base"))
    return rows.mapInArrow(run, SEQUENCE), total, width


def shards(docs: DataFrame, key: str = "order", stride: int = STRIDE, slots: int = SLOTS) -> DataFrame:
    """SHARD rows in order of shard; data holds the sequences of slots first_slot .. first_slot + slots - 1 at fixed stride, the arrays
    say whose they are and how many tokens count.

    Slots are uniform, so ranges of shards of about TASK_BYTES are known without sampling; each is one task's, which writes its shards in turn.
    """
    rows, total, width = sequences(docs, key, stride)
    count = -(-total // slots)
    each = max(1, TASK_BYTES // (slots * stride * width), -(-count // TASKS))
    rows = rows.withColumn("shard", F.floor(F.col("slot") / slots).cast("bigint"))
    rows = rows.repartitionById(max(1, -(-count // each)), F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("slot")
    target = to_arrow(SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def whole() -> pa.RecordBatch:
            first, doc_ids, parts, lengths, data = held[0][0], *map(list, zip(*[r[1:5] for r in held]))
            return pa.RecordBatch.from_pylist([{"shard": shard, "first_slot": first, "slots": len(held), "doc_ids": doc_ids, "parts": parts, "lengths": lengths, "data": b"".join(data)}], schema=target)

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[5] != shard:
                    if held:
                        yield whole()
                    shard, held = row[5], []
                held.append(row)
        if held:
            yield whole()
        released()

    return rows.mapInArrow(run, SHARD)


def materialise(docs: DataFrame, folder: str, key: str = "order", stride: int = STRIDE, slots: int = SLOTS) -> DataFrame:
    """Writes the shards as Parquet, one row a shard and a file a range of them, and gives what is stored. A lost task writes its range again."""
    # Row groups of a few shards, so that a reader of some slots skips the others; no dictionary of records that do not recur.
    shards(docs, key, stride, slots).write.options(**{"parquet.block.size": str(TASK_BYTES // 2), "parquet.enable.dictionary": "false"}).parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def index(stored: DataFrame, stride: int = STRIDE, width: int = TEXT_WIDTH) -> DataFrame:
    """One row a slot of stored shards: slot, shard, offset, doc_id, part, n_tokens and the digest of the record that stands there. No Python."""
    step = stride * width
    rows = stored.select("shard", "first_slot", "data", F.posexplode(F.arrays_zip("doc_ids", "parts", "lengths")).alias("_i", "_r"))
    record = F.substring("data", F.col("_i") * step + 1, F.lit(step))
    return rows.select((F.col("first_slot") + F.col("_i")).alias("slot"), "shard", (F.col("_i") * step).cast("bigint").alias("offset"), F.col("_r.doc_ids").alias("doc_id"), F.col("_r.parts").alias("part"), F.col("_r.lengths").alias("n_tokens"), F.sha2(record, 256).alias("sha256"))


def read_slots(stored: DataFrame, first: int, count: int, stride: int = STRIDE, slots: int = SLOTS, width: int = TEXT_WIDTH) -> DataFrame:
    """(slot, data) of slots first .. first + count - 1 from SHARD rows, for instance to go on after a stop: only their shards are read."""
    df, step = stored.where(F.col("shard").between(first // slots, (first + count - 1) // slots)), stride * width
    df = df.select("first_slot", "data", F.explode(F.sequence(F.lit(0), (F.col("slots") - 1).cast("int"))).alias("_i"))
    df = df.select((F.col("first_slot") + F.col("_i")).alias("slot"), F.substring("data", F.col("_i") * step + 1, F.lit(step)).alias("data"))
    return df.where(F.col("slot").between(first, first + count - 1))
