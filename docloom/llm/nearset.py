"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct word shingles. Every set has a list of minwise tokens. A tree branches all sets by one of
them; a node that is still large branches again, by tokens that its path selects, until nodes are small; the
sets of a small node are compared exhaustively by their sketches. Independent trees are repeated until a pair at the
threshold is missed with less than the chance asked for. Sketches only select: what they connect is gathered once by
candidate group, and every link is confirmed there on the full sets. Sizes of nodes and groups are counted before a task holds
one: a node or group that no task may hold is dealt out in blocks, and blocks meet in pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import DOCUMENTS, checkpointed, map_rows, maybe_broadcast, pick, released, small_batches, text_hash, to_arrow, without
from docloom.llm.components import components

#: Minwise tokens of a set: the low four bits of each make its sketch, the first PATH of them in full select its paths.
LANES, PATH = 256, 64
#: Sets of a node that are always compared exhaustively. A larger node is, too, if a few leaders gather nearly all of it, so
#: that no more than WORK pairs are left; else it branches on.
NODE, WORK, DEPTH, BRANCHES = 4096, 40_000_000, 7, 2
#: Sketches of a node that a task may hold. A larger node branches on unseen; at the last depth its blocks meet in pairs.
HOLD = 32_768
_RND = np.random.Generator(np.random.PCG64(20240229))
MULTIPLY = _RND.integers(1, 1 << 31, (LANES, 1), np.uint32) * np.uint32(2) + np.uint32(1)
FLIP = _RND.integers(0, 1 << 32, (LANES, 1), np.uint32)
MIX = np.uint64(0xBF58476D1CE4E5B9)


class Shingler:
    """Distinct k-word shingles of a text as sorted 64-bit hashes. A-Z are lower-cased; a shorter text is one shingle, a text without words none."""

    TABLE = 100_000

    def __init__(self, k: int):
        self.k, self.table = k, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        table = self.table
        if len(table) > self.TABLE:
            table.clear()
        h = []
        for w in words:
            x = table.get(w)
            if x is None:
                x = table[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            h.append(x)
        a = np.array(h, np.uint64)
        k = min(self.k, len(a))
        out = np.full(len(a) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ a[i : len(a) - k + 1 + i]) * MIX
            out ^= out >> np.uint64(31)
        return np.unique(out)


def minwise(s: np.ndarray) -> np.ndarray:
    """Minwise token of each of LANES hash orders, as unsigned 32-bit numbers; in blocks of the set, so memory stays bounded."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    best = np.full(LANES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(best, ((x[at : at + 1024] ^ FLIP) * MULTIPLY).min(axis=1), out=best)
    mixed = (best + np.arange(LANES, dtype=np.uint64) * np.uint64(1 << 32)) * MIX
    mixed ^= mixed >> np.uint64(29)
    return (mixed * MIX >> np.uint64(32)).astype(np.uint32)


def sketch_of(tokens: np.ndarray) -> bytes:
    low = (tokens & np.uint32(15)).astype(np.uint8)
    return (low[::2] << 4 | low[1::2]).tobytes()


def unpacked(sketches: list[bytes]) -> np.ndarray:
    """One row a sketch, one byte a lane."""
    a = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), LANES // 2)
    return np.concatenate([a >> 4, a & 15], axis=1)


def identity(s: np.ndarray) -> int:
    """64-bit id of a set; equal sets have equal ids."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def digests(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, th, n_shingles, id, path, sketch); th is a hash of the text, the last three are null for an empty set."""

    def start() -> Callable:
        shingles = Shingler(k)

        def one(text: str | None) -> tuple:
            s = shingles(text)
            if not len(s):
                return 0, None, None, None
            tokens = minwise(s)
            return len(s), identity(s), tokens[:PATH].tobytes(), sketch_of(tokens)

        return lambda doc, th, text: [doc, th, *map(list, zip(*map(one, text)))]

    df = pick(docs, "doc_id", "text").select("doc_id", text_hash(), "text")
    return map_rows(df, start, "doc_id bigint, th bigint, n_shingles bigint, id bigint, path binary, sketch binary")


def roots(classes: DataFrame, trees: int) -> DataFrame:
    """The first branching of every tree: (node, id, sketch)."""
    step = PATH // trees
    nodes = [F.xxhash64(F.lit(t), F.substring("path", 4 * t * step + 1, 4)) for t in range(trees)]
    return classes.select(F.explode(F.array(*nodes)).alias("node"), "id", "sketch")


def branch(large: DataFrame) -> DataFrame:
    """The next branching of rows (node, id, path, sketch): the node's path selects the entries, each gives a child."""
    at = [F.pmod(F.xxhash64("node", F.lit(b)), F.lit(PATH)).cast("int") for b in range(BRANCHES)]
    return large.select(F.explode(F.array(*[F.xxhash64("node", x, F.substring("path", 4 * x + 1, F.lit(4))) for x in at])).alias("node"), "id", "sketch")


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def all(self) -> np.ndarray:
        up = self.up
        while not np.array_equal(up, up[up]):
            up = up[up]
        self.up = up
        return up


def agreement(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity from equal lanes, corrected for equality by chance."""
    same = np.count_nonzero(others == sketch, axis=1) / sketch.shape[0]
    return (same - 1 / 16) / (1 - 1 / 16)


def lead(sketches: np.ndarray, least: float, forest: Forest, accept: Callable[[int, int], bool] | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each set joins the first leader it agrees with, or leads. Gives each set's leader in order of leading, and the sets left when `most` have led."""
    free, order, turn = np.arange(len(sketches)), np.full(len(sketches), most), 0
    while len(free) and turn < most:
        first, rest = free[0], free[1:]
        hit = agreement(sketches[first], sketches[rest]) >= least
        if accept:
            hit[hit] = [accept(int(first), int(j)) for j in rest[hit]]
        forest.up[rest[hit]] = first
        order[rest[hit]] = order[first] = turn
        free, turn = rest[~hit], turn + 1
    return order, free


def across(sketches: np.ndarray, least: float, forest: Forest, accept: Callable[[int, int], bool] | None, order: np.ndarray) -> None:
    """The pairs that lead() has not compared: a follower of an earlier leader with any set of a later one."""
    followers = np.flatnonzero(forest.up != np.arange(len(order)))
    if not len(followers):
        return
    later = np.flatnonzero(order > order[followers].min())
    swap = len(later) < len(followers)
    for i in later if swap else followers:
        others = followers[order[followers] < order[i]] if swap else later[order[later] > order[i]]
        top = forest.all()
        others = others[top[others] != top[i]]
        if len(others):
            for j in others[agreement(sketches[i], sketches[others]) >= least].tolist():
                if forest.find(int(i)) != forest.find(j) and (accept is None or accept(int(i), j)):
                    forest.join(int(i), j)


def connect(sketches: np.ndarray, least: float, accept: Callable[[int, int], bool] | None = None, work: int | None = None) -> np.ndarray | None:
    """Exhaustive comparison of one node: roots of the forest of pairs whose estimate is `least` or more and that accept() confirms.

    Pairs already connected are not compared again, so a mass of copies costs one pass. With `work`, None comes back where
    64 leaders leave sets over, or more than so many pairs would follow.
    """
    n = len(sketches)
    forest = Forest(n)
    order, left = lead(sketches, least, forest, accept, n if work is None else 64)
    if work is not None:
        largest = np.bincount(order).max() if n else 0
        if len(left) or n * (n - largest) > work:
            return None
    across(sketches, least, forest, accept, order)
    return forest.all()


def bridge(sketches: np.ndarray, known: list[int], least: float, accept: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Confirmed pairs that join sets of different known components, as few as that takes."""
    _, first, own = np.unique(np.array(known, np.int64), return_index=True, return_inverse=True)
    forest, out = Forest(len(known)), []
    for i, f in enumerate(first[own].tolist()):
        forest.join(i, f)
    for i in np.flatnonzero(own != np.bincount(own).argmax()).tolist():
        top = forest.all()
        others = np.flatnonzero(top != top[i])
        for j in others[agreement(sketches[i], sketches[others]) >= least].tolist():
            if forest.find(i) != forest.find(j) and accept(i, j):
                forest.join(i, j)
                out.append((i, j))
    return out


def _groups(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, list]]:
    """Runs of equal first column in sorted batches, with the other columns as lists; a run may span batches."""
    key, held = None, None
    for batch in batches:
        keys = np.asarray(batch.column(0))
        cols = [batch.column(i).to_pylist() for i in range(1, len(columns))]
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1 if len(keys) else []
        edges = [0, *cuts, len(keys)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if key is not None and keys[a] == key:
                for h, c in zip(held, cols):
                    h.extend(c[a:b])
            else:
                if key is not None:
                    yield int(key), held
                key, held = keys[a], [c[a:b] for c in cols]
    if key is not None:
        yield int(key), held


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def compare_nodes(rows: DataFrame, least: float, last: bool) -> DataFrame:
    """(node, a, b) of candidate links, at most one a set and node; node is null. Sets of nodes that are too large come back as (node, id, null)."""
    target = to_arrow("node bigint, a bigint, b bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for node, (ids, sketches) in _groups(batches, "node", "id", "sketch"):
                if len(ids) < 2:
                    continue
                s = unpacked(sketches)
                top = connect(s, least, work=None if last or len(ids) <= NODE else WORK)
                if top is None:
                    for i in ids:
                        yield node, i, None
                else:
                    for i, r in enumerate(top.tolist()):
                        if r != i:
                            yield None, ids[i], ids[r]

        yield from _batches(found(), target)
        released()

    return small_batches(rows).repartition("node").sortWithinPartitions("node", "id").mapInArrow(run, "node bigint, a bigint, b bigint")


def dealt(rows: DataFrame, key: str, sizes: DataFrame, most: int) -> DataFrame:
    """rows under a key too large for a task, once for each pair of blocks that theirs is in; the key becomes the pair's. sizes: (key, n)."""
    blocks = F.ceil(F.col("_n") / most).cast("int")
    rows = rows.join(maybe_broadcast(sizes.select(F.col(key).alias("_key"), F.col("n").alias("_n"))), F.col(key) == F.col("_key"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn(key, F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other"))).drop("_key", "_n", "_own", "_other")


def candidates(classes: DataFrame, trees: int, least: float) -> DataFrame:
    """Candidate links (a, b) of all trees. Each level is written once; the loop ends when no node is too large."""
    rows, out = roots(classes, trees), []
    for depth in range(DEPTH):
        last = depth == DEPTH - 1
        sizes = checkpointed(rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > HOLD))
        huge = None
        if not sizes.isEmpty():
            few = maybe_broadcast(sizes.select("node"))
            huge, rows = rows.join(few, "node", "left_semi"), rows.join(few, "node", "left_anti")
        made = checkpointed(compare_nodes(rows, least, last))
        out.append(made.where("node IS NULL").select("a", "b"))
        large = made.where("node IS NOT NULL").select("node", F.col("a").alias("id"))
        if huge is not None and last:
            out.append(checkpointed(compare_nodes(dealt(huge, "node", sizes, HOLD), least, True)).select("a", "b"))
        elif huge is not None:
            large = large.union(huge.select("node", "id"))
        if large.isEmpty():
            break
        rows = branch(large.join(classes, "id").select("node", "id", "path", "sketch"))
    links = out[0]
    for x in out[1:]:
        links = links.union(x)
    return links


def full_sets(docs: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(grp, id, sketch, hashes) of rows (doc_id, id, grp): full sets, made from the whole texts again."""
    kept = pick(docs, "doc_id", "text").where("doc_id IS NOT NULL")
    wanted = maybe_broadcast(checkpointed(groups.select(F.col("doc_id").alias("_doc"), F.col("id").alias("_id"), "grp")))
    rows = kept.join(wanted, kept.doc_id == F.col("_doc")).select("_id", "grp", "text")

    def start() -> Callable:
        shingles = Shingler(k)

        def work(ids: list, grp: list, text: list) -> list:
            out: list[list] = [[], [], [], []]
            for i, g, t in zip(ids, grp, text):
                s = shingles(t)
                if len(s) and identity(s) == i:  # a row that shares only its doc_id with the set's row has another id
                    for column, x in zip(out, (g, i, sketch_of(minwise(s)), s.tobytes())):
                        column.append(x)
            return out

        return work

    return map_rows(rows, start, "grp bigint, id bigint, sketch binary, hashes binary")


def confirm(sets: DataFrame, percent: int, least: float) -> DataFrame:
    """Confirmed links (a, b), enough to connect what is linked, of rows (grp, id, sketch, hashes) that meet by grp; with a column `known`, only
    links between different known components."""
    columns = ["grp", "id", "sketch", "hashes", *(["known"] if "known" in sets.columns else [])]
    target = to_arrow("a bigint, b bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for _, (ids, *held) in _groups(batches, *columns):
                one = dict(zip(ids, zip(*held)))  # repeated rows
                ids = list(one)
                if len(ids) < 2:
                    continue
                sketch, hashes, *known = map(list, zip(*one.values()))
                full, s = [np.frombuffer(h, np.uint64) for h in hashes], unpacked(sketch)

                def linked(i: int, j: int) -> bool:
                    x, y = full[i], full[j]
                    if len(x) > len(y):
                        x, y = y, x
                    if 100 * len(x) < percent * len(y):
                        return False
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    both = int((y[at] == x).sum())
                    return 100 * both >= percent * (len(x) + len(y) - both)

                if known:
                    for i, j in bridge(s, known[0], least, linked):
                        yield ids[i], ids[j]
                else:
                    for i, r in enumerate(connect(s, least, linked).tolist()):
                        if r != i:
                            yield ids[i], ids[r]

        yield from _batches(found(), target)
        released()

    return sets.select(*columns).repartition("grp").sortWithinPartitions("grp", "id").mapInArrow(run, "a bigint, b bigint")


def _rooted(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, grp, known) of rows (id, grp): the component of each over the links, its own id without one."""
    found = components(links).select(F.col("id").alias("_id"), "root")
    return checkpointed(ids.join(found, F.col("id") == F.col("_id"), "left").select("id", "grp", F.coalesce("root", "id").alias("known")))


def confirm_large(sets: DataFrame, percent: int, least: float, most: int) -> DataFrame:
    """confirm() of groups that no task may hold, exactly, from stored rows (grp, id, sketch, hashes).

    Blocks of about `most` sets are confirmed by themselves, then one set of each component found. What is still apart meets in pairs
    of blocks: sets outside the group's largest component with each other and with that one. A group of copies is whole after the first two
    steps, so its largest component is never compared with itself.
    """

    def cells(ids: DataFrame, salt: int) -> DataFrame:
        counts = maybe_broadcast(checkpointed(ids.groupBy(F.col("grp").alias("_g")).agg(F.ceil(F.count("*") / most).alias("_b"))))
        return ids.join(counts, F.col("grp") == F.col("_g")).select("id", F.xxhash64("grp", F.pmod(F.xxhash64("id", F.lit(salt)), F.col("_b"))).alias("cell"))

    def met(placed: DataFrame) -> DataFrame:
        placed = maybe_broadcast(checkpointed(placed.withColumnRenamed("id", "_id")))
        rows = sets.join(placed, F.col("id") == F.col("_id"))
        return rows.select(F.col("cell").alias("grp"), "id", "sketch", "hashes", *[c for c in placed.columns if c == "known"])

    ids = sets.select("id", "grp").distinct()
    links = checkpointed(confirm(met(cells(ids, 1)), percent, least))
    own = _rooted(ids, links)
    links = checkpointed(links.union(confirm(met(cells(own.where("id = known").select("id", "grp"), 2)), percent, least)))
    own = _rooted(ids, links)
    sizes = own.groupBy("grp", "known").agg(F.count("*").alias("n"))
    total = checkpointed(sizes.groupBy(F.col("grp").alias("_g")).agg(F.max(F.struct("n", "known")).alias("_top"), F.sum("n").alias("_all"), F.count("*").alias("_c")).where("_c > 1"))
    if total.isEmpty():
        return links
    rows = own.join(maybe_broadcast(total.select("_g", F.col("_top.known").alias("_main"), F.ceil(F.col("_top.n") / most).cast("int").alias("_m"), F.ceil((F.col("_all") - F.col("_top.n")) / most).cast("int").alias("_o"))), F.col("grp") == F.col("_g"))
    main = F.col("known") == F.col("_main")
    block = F.pmod(F.xxhash64("id", F.lit(3)), F.when(main, F.col("_m")).otherwise(F.col("_o"))).cast("int")
    rows = rows.withColumns({"_own": block, "_in": main})
    # Cells (other block, main block) are numbered -1 - main block; cells of two other blocks by both.
    across = F.transform(F.sequence(F.lit(0), F.col("_o") - 1), lambda o: F.xxhash64("grp", o, -1 - F.col("_own")))
    inward = F.transform(F.sequence(F.lit(0), F.col("_m") - 1), lambda m: F.xxhash64("grp", F.col("_own"), -1 - m))
    among = F.transform(F.sequence(F.lit(0), F.col("_o") - 1), lambda o: F.xxhash64("grp", F.least("_own", o), F.greatest("_own", o)))
    placed = rows.select("id", "known", F.explode(F.when(F.col("_in"), across).otherwise(F.concat(inward, among))).alias("cell"))
    return links.union(confirm(met(placed), percent, least))


def groups_of(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-5, group: int = 5_000) -> DataFrame:
    """One row a document: doc_id, th (hash of the text), n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of k-word shingles; component_id is the
    smallest doc_id reachable over links, kept is doc_id = component_id. Null or word-less text has an empty set, linked with
    nothing. Rows without a doc_id have no identity: they are never linked, component_id is null and kept is true. Repeated
    rows share their component and are all kept if its smallest id is theirs. A candidate group of up to `group` sets is
    confirmed by one task, a larger one in blocks, with the same links.

    `miss` is the chance that all trees separate a pair at the threshold by their first branching, and each further branching of a
    node too large to compare parts it with a chance of (1 - similarity) ** BRANCHES in that tree; the sketch's estimate is allowed five
    standard deviations.
    """
    similar = percent / 100
    trees = max(1, math.ceil(math.log(miss) / math.log(1 - similar)))
    chance = similar + (1 - similar) / 16
    least = similar - 5 * math.sqrt(chance * (1 - chance) / LANES) / (1 - 1 / 16)
    signed = checkpointed(digests(docs, k))
    classes = signed.where("id IS NOT NULL AND doc_id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("rep"), F.first("path").alias("path"), F.first("sketch").alias("sketch"))
    classes = checkpointed(classes)
    links = candidates(classes, trees, least)
    groups = checkpointed(components(links).select("id", F.col("root").alias("grp")))
    groups = groups.union(groups.select(F.col("grp").alias("id"), "grp").distinct())
    members = groups.join(classes.select("id", F.col("rep").alias("doc_id")), "id")
    sizes = checkpointed(groups.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > group).select("grp"))
    if sizes.isEmpty():
        confirmed = confirm(full_sets(docs, members, k), percent, least)
    else:
        few = maybe_broadcast(sizes)
        confirmed = confirm(full_sets(docs, members.join(few, "grp", "left_anti"), k), percent, least)
        large = checkpointed(full_sets(docs, members.join(few, "grp", "left_semi"), k))
        confirmed = confirmed.union(confirm_large(large, percent, least, group))
    linked = components(confirmed)
    reps = classes.select("id", "rep").join(linked, "id", "left").withColumn("root", F.coalesce("root", "id"))
    reps = reps.join(reps.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select(F.col("id").alias("_id"), "component_id")
    out = signed.select("doc_id", "th", "n_shingles", "id").join(reps, (F.col("id") == F.col("_id")) & F.col("doc_id").isNotNull(), "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "th", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def duplicates(docs: DataFrame, k: int = 5, **settings) -> DataFrame:
    """groups_of() without the hash of the text."""
    return groups_of(docs, k, **settings).drop("th")


def keep(docs: DataFrame, k: int = 5, **settings) -> DataFrame:
    """The columns of documents, one document of each component: its smallest by (doc_id, hash of the text), once if rows repeat.

    Documents with an empty set or without a doc_id all stay.
    """
    found = checkpointed(groups_of(docs, k, **settings).where("n_shingles > 0 AND doc_id IS NOT NULL"))
    several = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "th")).alias("best"), F.count("*").alias("n")).where("n > 1")
    several = several.select(F.col("component_id").alias("_c"), "best")
    rows = found.join(several, found.component_id == F.col("_c"))
    out = without(docs, rows.where(F.struct("doc_id", "th") != F.col("best")))
    again = checkpointed(rows.where(F.struct("doc_id", "th") == F.col("best")).groupBy("doc_id", "th").count().where("count > 1"))
    if again.isEmpty():
        return out
    twice = again.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"))
    own = pick(docs, *DOCUMENTS).withColumn("th", text_hash())
    own = own.join(twice, (F.col("th") == F.col("_th")) & (F.col("doc_id") == F.col("_doc")), "left_semi")
    return without(out, again).union(own.dropDuplicates(["doc_id", "th"]).drop("th"))
