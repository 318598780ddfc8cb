"""Importance resampling toward a target distribution over hashed features.

Bucket counts of corpus and target give an array of gains; a document's weight is their mean over its features, and a hash-seeded draw is
added to it. The draw without replacement is the documents of the highest scores. Each partition cuts its candidates into sorted runs,
stored in blocks; a range of scores is then one task's, which merges its runs by a tournament tree. Blocks arrive in the order of their
first keys, so a block is held only from when the merge reaches it: the shuffle is the external memory, and no run is held whole.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed, map_rows, pick, released, small_batches, to_arrow

BUCKETS = 10_000
#: Rows of a block; rows that one task sorts as a run; rows of a range of scores, about.
BLOCK, RUN, RANGE = 4096, 1 << 20, 1 << 20
SCORED = "doc_id bigint, n_features bigint, weight bigint, score bigint"
RUNS = "range int, first_score bigint, first_place bigint, doc_id array<bigint>, n_features array<bigint>, weight array<bigint>, score array<bigint>"
#: A to Z in lower case; digits, letters and bytes beyond ASCII stay, anything else parts words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Gains(NamedTuple):
    """array[b] is the gain of bucket b."""

    array: np.ndarray
    runs: int


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def features(own: list[bytes], runs: int) -> Iterable[bytes]:
    """All runs of 1 to `runs` consecutive words."""
    if runs == 1:
        return own
    return (b" ".join(own[i : i + n]) for n in range(1, runs + 1) for i in range(len(own) - n + 1))


def bucket_counts(texts: DataFrame, runs: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket over all rows of the one column text. A task sends a row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            seen: Counter = Counter()
            for text in b.column(0):
                seen.update(features(words(text.as_py()), runs))
                if len(seen) > 500_000:
                    tally(seen, total)
                    seen = Counter()
            tally(seen, total)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])
        released()

    def tally(seen: Counter, total: np.ndarray) -> None:
        np.add.at(total, np.array([zlib.crc32(f) % buckets for f in seen], np.int64), np.array(list(seen.values()), np.int64))

    out = np.zeros(buckets, np.int64)
    for r in small_batches(texts).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, runs: int = 1) -> Gains:
    """floor(1000 * ln of the ratio of the add-one estimates), target over corpus, of each bucket; in doubles."""
    b, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    return Gains(np.array([math.floor(1000 * math.log((float(t) + 1) * (all_corpus + b) / ((float(s) + 1) * (all_target + b)))) for s, t in zip(corpus, target)], np.int64), runs)


def fit(docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = BUCKETS) -> Gains:
    """From the column text of both tables, whole. The driver gets one number a bucket of each."""
    return gains(bucket_counts(pick(docs, "text"), runs, buckets), bucket_counts(pick(target, "text", types={"text": "string"}), runs, buckets), runs)


def noise(doc_id: int | None, seed: str = "2024") -> int:
    """The seeded draw of a document: floor(1000 * a standard Gumbel variate), from a hash of its id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, model: Gains, seed: str = "2024") -> DataFrame:
    """SCORED rows and n_words, one a document. Weight is the floored mean gain of the features, 0 without one; null text has none."""
    sent, buckets = docs.sparkSession.sparkContext.broadcast(model), len(model.array)  # a number a bucket

    def start() -> Callable:
        array, runs = sent.value.array.tolist(), sent.value.runs
        known: dict[bytes, int] = {}

        def gain(f: bytes) -> int:
            g = known.get(f)
            if g is None:
                g = array[zlib.crc32(f) % buckets]
                if len(known) < 200_000 and len(f) < 64:
                    known[f] = g
            return g

        def one(doc: int | None, text: str | None) -> tuple:
            own = words(text)
            seen = Counter(features(own, runs))
            n = seen.total()
            weight = sum(gain(f) * k for f, k in seen.items()) // n if n else 0
            return doc, n, weight, weight + noise(doc, seed), len(own)

        return lambda doc, text: [list(c) for c in zip(*map(one, doc, text))]

    return map_rows(pick(docs, "doc_id", "text"), start, f"{SCORED}, n_words bigint")


Key = tuple[int, bool, int, int, int]


def key(doc_id: int | None, n_features: int, weight: int, score: int) -> Key:
    """Order of the draw: higher scores, then smaller ids, no id last; further columns only make the order of repeated ids definite."""
    return -score, doc_id is None, doc_id or 0, weight, n_features


class Tournament:
    """A tree of blocks by the key each shows next. The root is the winner; after it moved, its path is played again."""

    def __init__(self):
        self.tree: list[int | None] = [None, None]  # places of blocks; leaves are the second half
        self.blocks: dict[int, list] = {}  # leaf: [keys, place, payload]
        self.spare = [0]

    def shown(self, leaf: int | None) -> Key | None:
        return None if leaf is None or leaf not in self.blocks else self.blocks[leaf][0][self.blocks[leaf][1]]

    def play(self, leaf: int) -> None:
        half = len(self.tree) // 2
        node = (half + leaf) // 2
        while node:
            a, b = self._at(2 * node), self._at(2 * node + 1)
            ka, kb = self.shown(a), self.shown(b)
            self.tree[node] = b if ka is None or (kb is not None and kb < ka) else a
            node //= 2

    def _at(self, node: int) -> int | None:
        half = len(self.tree) // 2
        return node - half if node >= half else self.tree[node]

    def enter(self, keys: list[Key], payload: list) -> None:
        if not self.spare:
            size = len(self.tree)
            self.tree = [None] * (2 * size)
            self.spare = list(range(size - 1, size // 2 - 1, -1))
            for leaf in self.blocks:
                self.play(leaf)
        leaf = self.spare.pop()
        self.blocks[leaf] = [keys, 0, payload]
        self.play(leaf)

    def winner(self) -> int | None:
        root = self._at(1)
        return root if root in self.blocks else None

    def second(self, leaf: int) -> Key | None:
        """The best key beside the winner's: that of the siblings along its path."""
        half, best = len(self.tree) // 2, None
        node = half + leaf
        while node > 1:
            k = self.shown(self._at(node ^ 1))
            if k is not None and (best is None or k < best):
                best = k
            node //= 2
        return best

    def take(self, limit: Key | None) -> Iterator[tuple[list, int, int]]:
        """Stretches (payload, from, to) in order, of all keys below limit: each time as many of the winner as precede the second best."""
        while (leaf := self.winner()) is not None:
            keys, at, payload = self.blocks[leaf]
            if limit is not None and keys[at] >= limit:
                return
            second = self.second(leaf)
            end = len(keys) if second is None else max(at + 1, bisect_right(keys, second, at))
            end = end if limit is None else min(end, bisect_left(keys, limit, at))
            if end == len(keys):
                del self.blocks[leaf]
                self.spare.append(leaf)
            else:
                self.blocks[leaf][1] = end
            self.play(leaf)
            yield payload, at, end


def boundaries(candidates: DataFrame, histogram: list[tuple[int, int]], each: int) -> list[tuple[int, int]]:
    """First (-score, doc_id) of every range but the first, in order: about `each` rows a range; a score that has more is cut by quantiles of doc_id."""
    cuts, held, heavy = [], 0, {}
    for s, n in histogram:
        if held and held + n > each:
            cuts.append((-s, -(1 << 63)))
            held = 0
        held += n
        if n > each:
            heavy[s] = -(-n // each)
    if heavy:
        by = {}
        for s, n in heavy.items():
            by.setdefault(n, []).append(s)
        for n, scores in by.items():
            q = candidates.where(F.col("score").isin(scores)).groupBy("score").agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 1000).alias("q"))
            cuts += [(-r["score"], x) for r in q.collect() for x in (r["q"] or [])]
    return sorted(set(cuts))


def sorted_runs(candidates: DataFrame, cuts: list[tuple[int, int]], block: int = BLOCK, run_rows: int = RUN) -> DataFrame:
    """RUNS rows: the candidates of each partition as sorted runs of `run_rows` rows at most, cut at the ranges and into blocks."""
    target, starts = to_arrow(RUNS), [(s, False, i) for s, i in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def cut() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda r: key(*r))
            keys = [key(*r)[:3] for r in held]
            at = [0, *(bisect_left(keys, c) for c in starts), len(held)]
            for n, (a, b) in enumerate(zip(at, at[1:])):
                for low in range(a, b, block):
                    own = held[low : min(low + block, b)]
                    doc, n_features, weight, score = map(list, zip(*own))
                    yield pa.RecordBatch.from_pylist([{"range": n, "first_score": -score[0], "first_place": doc[0], "doc_id": doc, "n_features": n_features, "weight": weight, "score": score}], schema=target)
            held.clear()

        for b in batches:
            held += zip(*[c.to_pylist() for c in b.columns])
            if len(held) >= run_rows:
                yield from cut()
        if held:
            yield from cut()
        released()

    return candidates.select("doc_id", "n_features", "weight", "score").mapInArrow(run, RUNS)


def merged(runs: DataFrame, base: dict[int, int], draw: int) -> DataFrame:
    """SCORED rows of the stored runs with rank, each range merged by a task of its own. base: rows of all ranges before. Ranks end at draw; what is
    left of the range then stays unmerged, with a null rank."""
    sent = runs.sparkSession.sparkContext.broadcast(base)  # a number a range
    schema = f"{SCORED}, rank bigint"
    target = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, here, rank = Tournament(), None, 0
        out: list[list] = [[] for _ in range(5)]

        def whole() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target)], schema=target)
            for c in out:
                c.clear()
            return b

        def take(limit: Key | None) -> Iterator[pa.RecordBatch]:
            nonlocal rank
            for payload, a, b in tree.take(limit):
                for c, p in zip(out, payload):
                    c.extend(p[a:b])
                out[4].extend(k if k <= draw else None for k in range(rank + 1, rank + 1 + b - a))
                rank += b - a
                if len(out[4]) >= BLOCK:
                    yield whole()
                if rank >= draw:
                    yield from rest()
                    return

        def rest() -> Iterator[pa.RecordBatch]:
            """What the tree still holds, in no order."""
            nonlocal tree
            for keys, at, payload in tree.blocks.values():
                for c, p in zip(out, payload):
                    c.extend(p[at:])
                out[4].extend([None] * (len(keys) - at))
                yield whole()
            tree = Tournament()

        for b in batches:
            for n, _, _, *payload in zip(*[c.to_pylist() for c in b.columns]):
                if n != here:
                    yield from take(None)
                    here, rank = n, sent.value[n]
                keys = [key(*r) for r in zip(*payload)]
                yield from take(keys[0])
                tree.enter(keys, payload)
                if rank >= draw:
                    yield from rest()
        yield from take(None)
        if out[4]:
            yield whole()
        released()

    tasks = max(1, min(len(base), 10_000))
    # The order of key(): a null id stands last among equal scores.
    ordered = runs.repartitionById(tasks, F.col("range") % tasks).sortWithinPartitions("range", "first_score", F.col("first_place").asc_nulls_last(), F.col("n_features")[0])
    return ordered.mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, runs: int = 1, buckets: int = BUCKETS, seed: str = "2024", each: int = RANGE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs (doc_id, text) for the distribution of target (text).

    Of the N rows with `least_words` words or more, the floor(percent * N / 100) of highest score get ranks 1, 2, 3 and so on, ties to the smaller
    doc_id, a null id last; the others a null rank. Null and empty texts have no feature, weight 0 and no part in the draw. Rows that repeat a doc_id
    are documents of their own, with equal noise. Empty tables give no rows; an empty target leaves the gains to the corpus alone.
    Scores are bounded (gains and noise by the logarithm of the counts), so their histogram is small; it gives the lowest score that
    can be drawn, below which nothing is sorted or moved.
    """
    scored = checkpointed(score(docs, fit(docs, target, runs, buckets), seed))
    eligible = F.col("n_words") >= least_words
    histogram = sorted(((r["score"], r["n"]) for r in scored.where(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw = percent * sum(n for _, n in histogram) // 100
    low, held, reached = None, [], 0
    for s, n in histogram:
        if reached >= draw:
            break
        low, reached = s, reached + n
        held.append((s, n))
    unranked = F.lit(None).cast("bigint").alias("rank")
    if low is None:
        return scored.select("doc_id", "n_features", "weight", "score", unranked)
    candidate = eligible & (F.col("score") >= low)
    candidates = scored.where(candidate)
    stored = checkpointed(sorted_runs(candidates, boundaries(candidates, held, each), block))
    sizes = {r["range"]: r["n"] for r in stored.groupBy("range").agg(F.sum(F.size("doc_id")).alias("n")).collect()}
    base, at = {}, 0
    for n in sorted(sizes):
        base[n] = at
        at += sizes[n]
    return scored.where(~candidate).select("doc_id", "n_features", "weight", "score", unranked).unionByName(merged(stored, base, draw))
