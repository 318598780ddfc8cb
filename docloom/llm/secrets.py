"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

The pattern kinds find what has a known form. Every other run of token characters that is long enough is scored by two
first-order character models, one of random strings and one of ordinary identifiers; if the log-likelihood ratio favours
randomness clearly, the run is reported as kind markov.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import map_rows, pick, unit_hash

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a shorter run fails whole, so the length can stand in the pattern
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "markov")
#: Columns of a table of labelled samples.
LABELLED = {"text": "string", "secret": "boolean"}
#: States of the models: start of a string, the printable ASCII characters, anything else.
STATES = 97


class Markov(NamedTuple):
    """ratio[a, b]: log-likelihood ratio, random over ordinary, of state b after state a."""

    ratio: np.ndarray


def states(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) - 31
    a[(a < 1) | (a > STATES - 2)] = STATES - 1
    return np.concatenate([[0], a])


def transitions(samples: Iterable[str]) -> np.ndarray:
    n = np.zeros((STATES, STATES))
    for s in samples:
        a = states(s)
        np.add.at(n, (a[:-1], a[1:]), 1)
    return n


def train(random_counts: np.ndarray, ordinary_counts: np.ndarray, smooth: float = 0.5) -> Markov:
    """From transition counts of the two labels, with add-`smooth` estimates."""
    logs = [np.log((n + smooth) / (n + smooth).sum(axis=1, keepdims=True)) for n in (random_counts, ordinary_counts)]
    return Markov(logs[0] - logs[1])


def random_samples(n: int = 6000, seed: int = 11) -> list[str]:
    """Labelled random: seeded strings over the digits of base 16, base 62 and base 64."""
    rnd = random.Random(seed)
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    sets = ("0123456789abcdef", "0123456789ABCDEF", plain, plain, plain + "+/", plain + "-_")
    return ["".join(rnd.choices(sets[i % len(sets)], k=rnd.randint(20, 64))) for i in range(n)]


def identifiers(text: str) -> Iterable[str]:
    """Labelled ordinary: words of letters in a text, plain, and joined by twos and threes as code joins them."""
    words = re.findall(r"[A-Za-z]{2,20}", text)
    for i, w in enumerate(words):
        yield w
        if i % 4 == 0:
            near = words[i : i + 3]
            yield ("_".join(near).lower(), "".join(x.capitalize() for x in near), "-".join(near[:2]).lower(), f"{w}_{i % 100}", "/".join(near))[i // 4 % 5]


def _counts(texts: DataFrame, cut: Callable[[str], Iterable[str]]) -> DataFrame:
    """(a, b, n) of the transitions in what `cut` makes of each row's text, the one column."""

    def start() -> Callable:
        def work(text: list) -> list:
            n = transitions(x for t in text if t for x in cut(t))
            a, b = np.nonzero(n)
            return [a.tolist(), b.tolist(), n[a, b].tolist()]

        return work

    return map_rows(texts, start, "a int, b int, n double").groupBy("a", "b").agg(F.sum("n").alias("n"))


def unmarked(text: str) -> Iterable[str]:
    """Ordinary identifiers of a text, from what no pattern marks as a secret and no mix of digits and both cases makes suspect."""
    plain = CANDIDATE.sub(lambda m: " " if re.search(r"\d", m[0]) else m[0], ACCESS.sub(" ", HEX.sub(" ", ASSIGN.sub(" ", text))))
    return identifiers(plain)


def fit(docs: DataFrame, sample: int = 400, labelled: DataFrame | None = None) -> Markov:
    """Models of both labels; only transition counts are gathered.

    Ordinary identifiers come from about `sample` whole documents drawn by a hash of doc_id, random strings from a seeded generator. Rows of
    `labelled` (text, secret) add to either, as they are; rows without a text or a label teach nothing.
    """
    df = pick(docs, "doc_id", "text").where("text IS NOT NULL")
    count = df.count()
    drawn = df.where(unit_hash(F.lit("secrets"), "doc_id") < min(1.0, sample / max(1, count))).select("text")
    ordinary = transitions(identifiers("identifier value name index count user file path config result message data type list"))
    chance = transitions(random_samples())
    found = [(ordinary, _counts(drawn, unmarked))]
    if labelled is not None:
        told = pick(labelled, "text", "secret", types=LABELLED)
        found += [(n, _counts(told.where(F.col("secret") == x).select("text"), lambda t: [t])) for n, x in ((chance, True), (ordinary, False))]
    for n, counts in found:
        for r in counts.collect():
            n[r["a"], r["b"]] += r["n"]
    return train(chance, ordinary)


def ratio(model: Markov, token: str) -> float:
    a = states(token)
    return float(model.ratio[a[:-1], a[1:]].sum())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, of the whole match."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def more_spans(text: str, base: list[tuple[int, int, int]], model: Markov, margin: float, each: float) -> list[tuple[int, int, int]]:
    """Candidates clear of all base spans that the models call random. Both lists are walked in order once."""
    out, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start():
            x = ratio(model, m[0])
            if x >= margin and x >= each * len(m[0]):
                out.append((m.start(), 3, m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: Markov, margin: float = 12.0, each: float = 0.6) -> DataFrame:
    """One row a document: doc_id, found (array of kind, start, end; by start, then kind), n_assign, n_access, n_hex, n_markov, base_sha256, spans.

    Null text counts as empty: nothing found. A markov span needs a log-likelihood ratio of `margin` in all and `each` per
    character and never overlaps a span of another kind, all of which stay. Rows are read one by one; repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 97 x 97 numbers

    def start() -> Callable:
        own = sent.value

        def one(text: str | None) -> tuple:
            base = base_spans(text or "")
            spans = sorted(base + more_spans(text or "", base, own, margin, each))
            count = [sum(k == x for _, k, _ in spans) for x in range(4)]
            found = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
            return found, *count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

        return lambda doc, text: [doc, *map(list, zip(*map(one, text)))]

    schema = "doc_id bigint, found array<struct<kind: string, start: int, end: int>>, n_assign bigint, n_access bigint, n_hex bigint, n_markov bigint, base_sha256 string, spans string"
    return map_rows(pick(docs, "doc_id", "text"), start, schema)
