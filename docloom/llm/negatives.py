"""Hard negatives by a two-dimensional block matrix multiply.

Rows are dealt to row blocks and anchors to anchor blocks, both cut into chunks of dimensions. A task multiplies an anchor shard by a row
shard into a partial tile of int64 scores; partial tiles of all chunks meet by (anchor block, row block), are added and stored. Two reads
of the stored tiles follow: the best rows of the anchor's label in each tile give the positives, then each tile gives the best rows in the
window of each anchor and positive. Only these few of each tile go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed, maybe_broadcast, pick, released, small_batches, to_arrow

EMBEDDINGS = {"vec_id": "bigint", "embedding": "array<float>", "label": "bigint"}
#: Anchors and rows of a block, dimensions of a chunk at least, chunks at most.
ANCHORS, ROWS, CHUNK, CHUNKS = 512, 2048, 32, 8
SHARD = "block int, chunk int, rows int, ids array<bigint>, labels array<bigint>, matrix binary"
PARTIAL = "a int, r int, chunk int, rows int, width int, tile binary, a_ids array<bigint>, a_labels array<bigint>, r_ids array<bigint>, r_labels array<bigint>"
TILE = "a int, r int, rows int, width int, tile binary, a_ids array<bigint>, a_labels array<bigint>, r_ids array<bigint>, r_labels array<bigint>, best array<struct<place: int, id: bigint, score: bigint>>"
FOUND = "a int, r int, place int, p int, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def packed(tile: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them, byte planes apart, so that the planes of high bytes compress away. The first byte is the width."""
    low, high = (int(tile.min()), int(tile.max())) if tile.size else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return bytes([width]) + np.ascontiguousarray(tile.astype(f"<i{width}").reshape(-1).view(np.uint8).reshape(-1, width).T).tobytes()


def unpacked(raw: bytes, rows: int) -> np.ndarray:
    width = raw[0]
    flat = np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1).T).reshape(-1).view(f"<i{width}")
    return flat.astype(np.int64).reshape(rows, -1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed in int64; by floating point where every sum is exact."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def prepared(embeddings: DataFrame, scale: int = 256, flip: int = 7, labels: int = 10) -> DataFrame:
    """(id, label, v): whole components floor(scale * x). Rows without an id, a label, a vector or with a null or non-finite component are left out.

    Rows that repeat all three are one row. Where the id is divisible by `flip`, the label first becomes (label + 1) % labels.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    df = pick(embeddings, *EMBEDDINGS, types=EMBEDDINGS).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    label = F.when(F.col("vec_id") % flip == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    # Beyond 2^62 a component cannot be a whole number of 64 bits; bound() refuses it.
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(2.0**62)), F.lit(-(2.0**62)))).cast("bigint"))
    return df.select(F.col("vec_id").alias("id"), label.alias("label"), whole.alias("v")).distinct()


def bound(rows: DataFrame) -> tuple[int, int]:
    """Rows and dimensions; an error where a score could pass 64 bits."""
    most = F.max(F.array_max(F.transform("v", F.abs)))
    n, dims, top = rows.agg(F.count("*"), F.max(F.size("v")), most).first()
    if n and (dims or 0) * (top or 0) ** 2 >= 1 << 62:
        raise ValueError(f"components up to {top} in {dims} dimensions: scores do not fit 64 bits")
    return n, dims or 0


def shards(rows: DataFrame, blocks: int, dims: int, chunk: int) -> DataFrame:
    """SHARD rows: each block's rows by id, in chunks of dimensions; shorter vectors count as padded with zeros. Ids and labels go with chunk 0."""
    target, chunks = to_arrow(SHARD), max(1, -(-dims // chunk))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []

        def whole() -> Iterator[pa.RecordBatch]:
            full = np.zeros((len(held), chunks * chunk), np.int64)
            for i, (_, _, v) in enumerate(held):
                full[i, : len(v)] = v
            for c in range(chunks):
                part = {"ids": [h[0] for h in held], "labels": [h[1] for h in held]} if c == 0 else {"ids": [], "labels": []}
                yield pa.RecordBatch.from_pylist([{"block": here, "chunk": c, "rows": len(held), **part, "matrix": packed(full[:, c * chunk : (c + 1) * chunk])}], schema=target)

        for b in batches:
            for block, *row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if block != here:
                    if held:
                        yield from whole()
                    here, held = block, []
                held.append((row[0], row[1], row[2].values.to_numpy(zero_copy_only=False)))
        if held:
            yield from whole()
        released()

    dealt = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), "id", "label", "v")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return small_batches(dealt.repartition(tasks, "block").sortWithinPartitions("block", "id", "label")).mapInArrow(run, SHARD)


def one_by_one(work: Callable[[dict], Iterator[dict]], schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over rows that are large: one is held at a time."""
    target = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                out = list(work(b.slice(i, 1).to_pylist()[0]))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=target)
        released()

    return run


def partial_tiles(anchors: DataFrame, rows: DataFrame, blocks: int) -> DataFrame:
    """PARTIAL rows of stored shards: each row shard goes to each of the `blocks` anchor blocks, for the product of one chunk."""
    left = anchors.select(F.col("block").alias("a"), F.col("chunk").alias("a_chunk"), F.col("rows").alias("a_rows"), F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("matrix").alias("a_matrix"))
    right = rows.select(F.col("block").alias("r"), "chunk", "rows", "ids", "labels", "matrix", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("to"))
    both = right.join(maybe_broadcast(left), (F.col("a") == F.col("to")) & (F.col("a_chunk") == F.col("chunk"))).drop("to", "a_chunk")

    def work(x: dict) -> Iterator[dict]:
        tile = product(unpacked(x["a_matrix"], x["a_rows"]), unpacked(x["matrix"], x["rows"]))
        yield {"a": x["a"], "r": x["r"], "chunk": x["chunk"], "rows": x["a_rows"], "width": x["rows"], "tile": packed(tile), "a_ids": x["a_ids"], "a_labels": x["a_labels"], "r_ids": x["ids"], "r_labels": x["labels"]}

    return both.mapInArrow(one_by_one(work, PARTIAL), PARTIAL)


def descending(scores: np.ndarray) -> np.ndarray:
    """Places by score, the highest first; columns are in the order of ids, so ties go to the smaller one."""
    return np.argsort(-scores, kind="stable")


def best_of_label(tile: np.ndarray, x: dict, k: int) -> Iterator[dict]:
    """The k best rows of each anchor's label, the anchor's own row left out."""
    ids, labels = np.array(x["r_ids"], np.int64), np.array(x["r_labels"], np.int64)
    for place, (scores, anchor, label) in enumerate(zip(tile, x["a_ids"], x["a_labels"])):
        own = np.nonzero((labels == label) & (ids != anchor))[0]
        for i in own[descending(scores[own])[:k]]:
            yield {"place": place, "id": int(ids[i]), "score": int(scores[i])}


def summed_tiles(partial: DataFrame, k: int) -> DataFrame:
    """TILE rows: the partial tiles of an (anchor block, row block) added, with the best rows of each anchor's label. A task adds into one tile at a time."""
    target = to_arrow(TILE)
    told = ("a_ids", "a_labels", "r_ids", "r_labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total = None, np.zeros((0, 0), np.int64)

        def whole() -> pa.RecordBatch:
            out = {c: here[c] for c in ("a", "r", "rows", "width", *told)} | {"tile": packed(total), "best": list(best_of_label(total, here, k))}
            return pa.RecordBatch.from_pylist([out], schema=target)

        for b in batches:
            for i in range(b.num_rows):
                x = b.slice(i, 1).to_pylist()[0]
                tile = unpacked(x.pop("tile"), x["rows"])
                if here is None or (x["a"], x["r"]) != (here["a"], here["r"]):
                    if here is not None:
                        yield whole()
                    here, total = x, tile
                else:
                    total += tile
                    if x["chunk"] == 0:
                        here |= {c: x[c] for c in told}
        if here is not None:
            yield whole()
        released()

    tasks = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return partial.repartition(tasks, "a", "r").sortWithinPartitions("a", "r").mapInArrow(run, TILE)


def ranked(rows: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k first of each group with their rank; the parts of a group that 64 row blocks give are cut to k each before they meet."""
    order = [F.col(score).desc(), F.col(tie)]
    part = rows.withColumn("_part", F.floor(F.col("r") / 64))
    part = part.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).where(F.col("_n") <= k).drop("_n", "_part")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def windows(low: int, high: int, k: int) -> Callable[[dict], Iterator[dict]]:
    """From a tile and the positives of its anchors, the k best rows in the window of each anchor and positive."""

    def work(x: dict) -> Iterator[dict]:
        tile = unpacked(x["tile"], x["rows"])
        ids, labels = np.array(x["r_ids"], np.int64), np.array(x["r_labels"], np.int64)
        by: dict[int, list[dict]] = {}
        for w in x["wanted"]:
            by.setdefault(w["place"], []).append(w)
        for place, own in by.items():
            anchor, scores = x["a_ids"][place], tile[place]
            top, least = (f(w["score"] for w in own) for f in (max, min))
            # Only what can stand in a window of the anchor is sorted.
            other = np.nonzero((labels != x["a_labels"][place]) & (ids != anchor) & (scores <= high * top // 100) & (scores >= -(-low * least // 100)))[0]
            other = other[descending(scores[other])]
            found = scores[other]
            for w in own:
                first = int(np.searchsorted(-found, -(high * w["score"] // 100), "left"))
                for i, score in zip(other[first : first + k].tolist(), found[first : first + k].tolist()):
                    if 100 * score >= low * w["score"]:
                        yield {"a": x["a"], "r": x["r"], "place": place, "p": w["p"], "anchor_id": anchor, "positive_id": w["id"], "positive_score": w["score"], "negative_id": int(ids[i]), "negative_score": score}

    return work


def mine(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, anchors: int = ANCHORS, rows: int = ROWS, chunk: int = CHUNK, **labels) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (id divisible by `every`) and each of its first
    `positives` rows of the same label, the first `negatives` rows of another label whose score is low to high percent of the positive's.

    Scores are whole inner products, higher first, ties by smaller id. Which rows take part says prepared(); a null id is none. A repeated id whose
    rows differ gives rows of their own, none of them a partner of another as anchor. An anchor without a positive, or a positive whose window is
    empty, gives no row, nor does an empty table. Scores that could pass 64 bits are an error.
    """
    table = checkpointed(prepared(embeddings, **labels))
    count, dims = bound(table)
    anchor = F.pmod(F.col("id"), F.lit(every)) == 0
    blocks = max(1, -(-table.where(anchor).count() // anchors))
    chunk = max(chunk, -(-dims // CHUNKS))
    left = checkpointed(shards(table.where(anchor), blocks, dims, chunk))
    right = checkpointed(shards(table, max(1, -(-count // rows)), dims, chunk))
    tiles = checkpointed(summed_tiles(partial_tiles(left, right, blocks), positives))
    best = ranked(tiles.select("a", "r", F.inline("best")), ["a", "place"], "score", "id", positives)
    wanted = checkpointed(best.groupBy(F.col("a").alias("of")).agg(F.collect_list(F.struct("place", F.col("rank").alias("p"), "id", "score")).alias("wanted")))
    near = tiles.drop("best").join(maybe_broadcast(wanted), F.col("a") == F.col("of")).drop("of")
    found = near.mapInArrow(one_by_one(windows(low, high, negatives), FOUND), FOUND)
    out = ranked(found, ["a", "place", "p"], "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
