"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has one bit per language in each slot, in as many machine words as that takes: the AND of an n-gram's
slots gives all languages that contain it, in one look-up for all of them. A document's masks are counted per language, each count is
corrected for the filter's false positives, and the largest corrected share decides.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed, map_rows, pick, unit_hash

#: Orders of the n-grams, the hash functions of the filter, and slots per n-gram of the largest language.
ORDERS, HASHES, SLOTS = (3, 4), 3, 12
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
UNKNOWN = "und"
#: Languages in one machine word.
WORD = 64


class Model(NamedTuple):
    langs: list[str]
    slots: np.ndarray  # a word per slot, or a row of words beyond 64 languages
    rates: np.ndarray  # false-positive rate of each language


def letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for i in range(0x323B0):  # no letters are assigned beyond
        table[i] = chr(i).isalpha()
    return table


def grams(text: str, letter: np.ndarray) -> np.ndarray | None:
    """64-bit hashes of all n-grams over lower-case letters, runs of anything else counting as one blank; None without a letter."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[a]
    if not is_letter.any():
        return None
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]
    a = np.where(is_letter, a, 32)[keep].astype(np.uint64)
    out = []
    for n in ORDERS:
        if len(a) >= n:
            h = a[: len(a) - n + 1] * MULTIPLIERS[0]
            for k in range(1, n):
                h += a[k : len(a) - n + 1 + k] * MULTIPLIERS[k]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def places(h: np.ndarray, size: int) -> list[np.ndarray]:
    """Slots of each n-gram for each hash function; size is a power of two."""
    low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]


def train(labelled: DataFrame, sample: int = 500, least_share: float = 1e-5, few: int = 10_000) -> Model:
    """Filters from rows (doc_id, text, lang); null texts and labels teach nothing.

    Bounds: about `sample` whole documents per language, drawn by a hash of doc_id at the rate sample / documents of the
    language; at most 1 / least_share n-grams per language, since rarer ones are left out. An n-gram seen once is left out, too, where
    the language's documents give `few` or more: a short one would else learn nothing. Every label is learned; n-grams
    reach the driver as numbers, WORD languages at a time.
    """
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return Model([], np.zeros(1, np.uint64), np.zeros(0))
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample / r["count"]))])
    drawn = known.where(unit_hash(F.lit("language"), "doc_id") < rate[F.col("lang")])

    def start() -> Callable:
        letter = letters()

        def work(text: list, lang: list) -> list:
            by: dict[str, list[np.ndarray]] = {}
            for t, x in zip(text, lang):
                if (g := grams(t, letter)) is not None:
                    by.setdefault(x, []).append(g)
            out: list[list] = [[], [], []]
            for x, all_grams in by.items():
                h, n = np.unique(np.concatenate(all_grams), return_counts=True)
                out[0] += [x] * len(h)
                out[1] += h.view(np.int64).tolist()
                out[2] += n.tolist()
            return out

        return work

    tally = map_rows(pick(drawn, "text", "lang"), start, "lang string, h bigint, n bigint").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    number = F.create_map(*[F.lit(x) for i, v in enumerate(langs) for x in (v, i)])
    tally = checkpointed(tally.select(number[F.col("lang")].alias("lang"), "h", "n"))
    total = {r["lang"]: r["n"] for r in tally.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    sets: list[np.ndarray] = []
    if total:
        least = F.create_map(*[F.lit(x) for k, v in total.items() for x in (k, max(2.0 if v >= few else 1.0, v * least_share))])
        chosen = tally.where(F.col("n") >= least[F.col("lang")]).select("lang", "h")
        for at in range(0, len(langs), WORD):
            held = chosen.where(F.col("lang").between(at, at + WORD - 1)).toPandas()
            sets += [np.sort(held.h[held.lang == i].to_numpy(np.int64)).view(np.uint64) for i in range(at, min(at + WORD, len(langs)))]
    sets = sets or [np.zeros(0, np.uint64)] * len(langs)
    size = 1 << int(SLOTS * max(1, *map(len, sets))).bit_length()
    kind, words = np.uint8 if len(langs) <= 8 else np.uint64, -(-len(langs) // WORD)
    slots, rates = np.zeros((size, words), kind), []
    for n, own in enumerate(sets):
        word, bit = slots[:, n // WORD], kind(1 << n % WORD)
        for at in places(own, size):
            word[at] |= bit
        rates.append(float(np.count_nonzero(word & bit)) / size)
    slots = slots if words > 1 else slots[:, 0].copy()
    return Model(langs, slots, np.array(rates) ** HASHES)


def masks(model: Model, h: np.ndarray) -> np.ndarray:
    """For each n-gram, the bitmask of the languages that contain it; a row of words beyond 64 languages."""
    first, *rest = places(h, len(model.slots))
    out = model.slots[first]
    for at in rest:
        out &= model.slots[at]
    return out


def shares(model: Model, h: np.ndarray) -> np.ndarray:
    """Corrected share of the n-grams that each language contains: (hits / n - false positives) / (1 - false positives)."""
    m = masks(model, h)
    byte = np.arange(256)
    width = m.dtype.itemsize * (m.shape[1] if m.ndim > 1 else 1)
    hits = np.zeros(8 * width)
    for k, column in enumerate(m.view(np.uint8).reshape(len(m), width).T):
        seen = np.bincount(column, minlength=256)
        for bit in range(8):
            hits[8 * k + bit] = seen[(byte >> bit) & 1 == 1].sum()
    if sys.byteorder != "little":
        hits = hits.reshape(-1, m.dtype.itemsize, 8)[:, ::-1].ravel()
    return np.clip((hits[: len(model.langs)] / max(1, len(h)) - model.rates) / (1 - model.rates), 0, 1)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns, lang_pred and score (0 to 1), one row a document, from the whole text alone.

    lang_pred is `und` with score 0 for null text, text without a letter, or an untaught model. Equal shares go to the first
    language in code point order. The score is the winner's share of the two best corrected shares, times its own.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by train(), for each language
    kinds = {"doc_id": "bigint"}

    def start() -> Callable:
        own, letter = sent.value, letters()

        def one(text: str | None) -> tuple[str, float]:
            h = grams(text, letter) if text and own.langs else None
            if h is None:
                return UNKNOWN, 0.0
            s = shares(own, h)
            best = int(np.argmax(s))
            second = max((x for i, x in enumerate(s) if i != best), default=0.0)
            return own.langs[best], float(s[best] * s[best] / (s[best] + second)) if s[best] > 0 else 0.0

        def work(*cols: list) -> list:
            return [*cols[:-1], *map(list, zip(*map(one, cols[-1])))]

        return work

    df = pick(docs, *keep, "text")
    return map_rows(df, start, ", ".join(f"`{k}` {kinds.get(k, 'string')}" for k in keep) + ", lang_pred string, score double")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def identify(docs: DataFrame, sample: int = 500) -> DataFrame:
    """Learns from the documents that are not held out (crc32 of the id's text mod 3 is not 1) and predicts all.

    A null id is never held out and never taught from.
    """
    df = pick(docs, "doc_id", "text", "lang")
    model = train(df.where(~held_out()), sample)
    return predict(df, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
