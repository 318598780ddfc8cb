"""Quality rules: per-document counts and cross-document line frequency.

Each document is read once, narrow, into a digest: its counts and the 64-bit hashes of its normalised lines with the words
under each. Lines that more documents of a host carry than the limit are boilerplate: they are cut out, and a document that loses
too large a share of its words with them is rejected. Only digests are shuffled, never texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import DOCUMENTS, checkpointed, map_rows, maybe_broadcast, pick, text_hash

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
DIGEST = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "lines array<struct<h: bigint, w: int>>"
)


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    total = end = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def line_hash(words: list[bytes]) -> int:
    """64-bit hash of a line in normal form: its words in lower case, one blank between them."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(b" ".join(words).decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def digest_of(text: str | None) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    repeated = 0
    lines: dict[int, int] = {}
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            if line in seen:
                repeated += 1
            seen.add(line)
            h = line_hash(own)
            lines[h] = lines.get(h, 0) + len(own)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeated, repeat_words(words),
        [{"h": h, "w": w} for h, w in lines.items()],
    )


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, th, source) and the columns of DIGEST, one row a document; null text counts as empty."""

    def start() -> Callable:
        return lambda doc, th, source, text: [doc, th, source, *map(list, zip(*map(digest_of, text)))]

    df = pick(docs, "doc_id", "source", "text").select("doc_id", text_hash(), "source", "text")
    return map_rows(df, start, f"doc_id bigint, th bigint, source string, {DIGEST}")


def frequent_lines(digest: DataFrame, share: float = 0.1, least: int = 50, copies: bool = False) -> DataFrame:
    """(source, h) of lines that more voters of a host carry than max(least, share * the host's voters).

    A voter is a document of the host, repeated rows of one doc_id being one; without `copies`, the copies of one text are one voter, the document of
    the least id, in the count and in the limit alike. The plain count bounds the voters from above, so they are told apart only for lines whose plain count passes.
    """
    def voters(rows: DataFrame, *by: str) -> DataFrame:
        one = rows if copies else rows.groupBy("source", *by, "th").agg(F.min("doc_id").alias("doc_id"))
        return one.select("source", *by, "doc_id").distinct().groupBy("source", *by).agg(F.count("*").alias("n"))

    lines = digest.select("source", "doc_id", "th", F.explode("lines.h").alias("h"))
    hosts = voters(digest.select("source", "doc_id", "th")).select(F.col("source").alias("_s"), F.greatest(F.lit(float(least)), F.lit(float(share)) * F.col("n")).alias("limit"))
    often = lines.groupBy("source", "h").agg(F.count("*").alias("n")).where(F.col("n") > least)
    often = often.join(hosts, often.source.eqNullSafe(hosts._s)).where(F.col("n") > F.col("limit"))
    often = often.select(F.col("source").alias("_s"), F.col("h").alias("_h"), "limit")
    exact = lines.join(often, lines.source.eqNullSafe(often._s) & (lines.h == often._h))
    return voters(exact, "h", "limit").where(F.col("n") > F.col("limit")).select("source", "h")


def verdicts(docs: DataFrame, share: float = 0.1, least: int = 50, depleted: int = 70, copies: bool = False) -> DataFrame:
    """One row a document: doc_id, th (hash of the text), the counts, n_removed (words in frequent lines), cut (hashes of its frequent lines), base_failed and kept.

    kept is false if base_failed (under 50 words, or over half of them in repeated 3-word windows), or if frequent lines hold
    more than `depleted` percent of the words. The host of a document is its source; a null source is a host of its own.
    Repeated rows of one doc_id count as one document of a host, rows without an id likewise; each row is judged and stays.
    Documents with one text count once for all of them, so a text copied many times does not make its own lines boilerplate; with `copies`, each counts.
    Frequent lines meet the digests' lines by (host, hash); only documents that have one go on from there.
    """
    digest = checkpointed(digests(docs))
    often = checkpointed(frequent_lines(digest, share, least, copies).select(F.col("source").alias("_s"), F.col("h").alias("_h")))
    lines = digest.select("doc_id", "th", "source", F.explode("lines").alias("_l"))
    hit = lines.join(maybe_broadcast(often), lines.source.eqNullSafe(F.col("_s")) & (F.col("_l.h") == F.col("_h")))
    # A set, since repeated rows of a document bring their lines again; a document's lines have a hash each.
    hit = hit.groupBy(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), F.col("source").alias("_s")).agg(F.collect_set("_l").alias("_cut"))
    hit = maybe_broadcast(checkpointed(hit.select("_doc", "_th", "_s", F.transform("_cut", lambda x: x.h).alias("cut"), F.aggregate("_cut", F.lit(0).cast("bigint"), lambda a, x: a + x.w).alias("_removed"))))
    joined = digest.join(hit, (digest.th == F.col("_th")) & digest.doc_id.eqNullSafe(F.col("_doc")) & digest.source.eqNullSafe(F.col("_s")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = joined.select("doc_id", "th", "source", *counts, F.coalesce("_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("cut", F.array().cast("array<bigint>")).alias("cut"), failed.alias("base_failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_removed") <= depleted * F.col("n_words")))


def judge(docs: DataFrame, **limits) -> DataFrame:
    """verdicts() without the hash of the text, the host and the hashes of lines."""
    return verdicts(docs, **limits).drop("th", "source", "cut")


def cut_lines(text: str, hashes: set[int]) -> str:
    """text without its lines of these hashes."""
    return "\n".join(line for line in text.split("\n") if not (words := line.encode("utf-8", "surrogatepass").split()) or line_hash(words) not in hashes)


def keep(docs: DataFrame, **limits) -> DataFrame:
    """The columns of documents, without the documents that verdicts() rejects, and their texts without the frequent lines (n_chars set anew).

    Documents without a frequent line stay as they are, and their texts do not move while the others are few. Exact copies of a text are one
    voter here: a large group of them would else make all its own lines boilerplate and go as a whole, before near-dedup can keep one.
    """
    found = checkpointed(verdicts(docs, **limits).where("NOT kept OR size(cut) > 0").select("doc_id", "th", "source", "kept", "cut"))
    touched = maybe_broadcast(checkpointed(found.where("kept").select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), F.col("source").alias("_s"), "cut").dropDuplicates(["_doc", "_th", "_s"])))
    rows = pick(docs, *DOCUMENTS).withColumn("_own", F.coalesce(F.xxhash64("text"), F.lit(0)))
    rows = rows.join(touched, (F.col("_own") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_s"))).select(*DOCUMENTS, "cut")

    def start() -> Callable:
        def work(doc: list, text: list, lang: list, source: list, n_chars: list, cut: list) -> list:
            left = [cut_lines(t, set(c)) for t, c in zip(text, cut)]
            return [doc, left, lang, source, list(map(len, left))]

        return work

    # One (doc_id, text) under two hosts is touched by host, so the host decides here too.
    return _others(docs, found).unionByName(map_rows(rows, start, ", ".join(f"{k} {v}" for k, v in DOCUMENTS.items())))


def _others(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of documents that found (doc_id, th, source) does not name."""
    gone = checkpointed(found.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), F.col("source").alias("_s")).distinct())
    rows = pick(docs, *DOCUMENTS).withColumn("_own", F.coalesce(F.xxhash64("text"), F.lit(0)))
    same = (F.col("_own") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_s"))
    return rows.join(maybe_broadcast(gone), same, "left_anti").drop("_own")
