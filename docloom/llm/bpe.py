"""Byte-pair encoding with a segment tree over adjacent pair ranks, and its decoding.

The leaves of the tree hold the merge rank of each adjacent symbol pair of a word; every inner node holds the smaller
(rank, position) of its children. The root therefore is the leftmost pair of lowest rank. A merge changes at most three
leaves, each updated in O(log n), and merging ends when the root holds no rank: a word of n symbols takes O(n log n).
Words repeat, so each task keeps a bounded table of finished words.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.common import map_rows, pick

#: No pair, or a pair without a merge.
NONE = 1 << 62
#: Words in each of the two generations of a task's table: a full young one becomes the old one, and a word found there moves back.
TABLE = 250_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class PairTree:
    """Minimum segment tree over keys rank << 32 | position."""

    def __init__(self, ranks: list[int]):
        self.size = size = 1 << max(0, len(ranks) - 1).bit_length()
        leaves = [r << 32 | i if r >= 0 else NONE for i, r in enumerate(ranks)]
        self.node = node = [NONE] * size + leaves + [NONE] * (size - len(leaves))
        for i in range(size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b

    def put(self, i: int, rank: int) -> None:
        node, k = self.node, self.size + i
        node[k] = best = rank << 32 | i if rank >= 0 else NONE
        while k > 1:
            other = node[k ^ 1]
            if other < best:
                best = other
            k >>= 1
            if node[k] == best:
                return
            node[k] = best

    def least(self) -> int:
        """Position of the leftmost pair of lowest rank, -1 if no pair can merge."""
        top = self.node[1]
        return -1 if top == NONE else top & 0xFFFFFFFF


def known(told: dict, steps: list[dict]) -> None:
    """Refuses a vocabulary file whose steps are not those that WordBpe takes."""
    normal = [{k: v for k, v in s.items()} for s in told["normalizer"]["normalizers"]]
    if normal != [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]:
        raise ValueError(f"normaliser {normal}")
    if [s["type"] for s in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"] or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
        raise ValueError(f"pre-tokenizer {steps}")
    model = told["model"]
    if model["type"] != "BPE" or told["decoder"] or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        raise ValueError("only plain byte-level BPE models without a decoder")
    if any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that strip, normalise or want whole words")


class WordBpe:
    """Encoder and decoder of one vocabulary file of the byte-level word-end kind."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: (left id, right id) -> (rank, merged id)
        self.merge = {(self.vocab[a], self.vocab[b]): (n, self.vocab[a + b]) for n, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.name = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        steps = told["pre_tokenizer"]["pretokenizers"]
        known(told, steps)
        self.split = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), regex.V0)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        #: What every added token begins with: a text without it holds none.
        self.mark = os.path.commonprefix(list(self.special))
        self.alphabet = byte_alphabet()
        self.table: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def normal(self, text: str) -> str:
        """NFC and lower case, character by character (no final-sigma rule). White space never reaches a word, so runs of it stay."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def word(self, word: str) -> list[int]:
        """Token ids of one pre-token, merged through the segment tree."""
        units = [self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")]
        units[-1] += self.suffix
        ids = [self.vocab[u] for u in units]
        n, merge = len(ids), self.merge
        if n == 1:
            return ids
        pair = [merge.get((ids[i], ids[i + 1]), (-1, 0)) for i in range(n - 1)]
        tree = PairTree([p[0] for p in pair])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (i := tree.least()) >= 0:
            j = after[i]
            ids[i] = pair[i][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, -1)
            if k < n:
                before[k] = i
                pair[i] = merge.get((ids[i], ids[k]), (-1, 0))
                tree.put(i, pair[i][0])
            else:
                tree.put(i, -1)
            if (h := before[i]) >= 0:
                pair[h] = merge.get((ids[h], ids[i]), (-1, 0))
                tree.put(h, pair[h][0])
        return [x for x in ids if x >= 0]

    def known(self, word: str) -> tuple[bytes, str]:
        """The word's ids as little-endian unsigned 32-bit integers, and its decoded text."""
        if len(self.table) >= TABLE:
            self.old, self.table = self.table, {}
        made = self.old.get(word)
        if made is None:
            ids = self.word(word)
            made = struct.pack(f"<{len(ids)}I", *ids), " ".join([self.name[i] for i in ids])
        self.table[word] = made
        return made

    def both(self, text: str) -> tuple[bytes, str]:
        """Ids of a whole text as bytes, and their decoded text (token names joined by a blank)."""
        packed: list[bytes] = []
        names: list[str] = []
        for part in self.cut.split(text) if self.cut and self.mark in text else [text]:
            if part in self.special:
                packed.append(struct.pack("<I", self.special[part]))
                names.append(part)
                continue
            table, known = self.table, self.known
            made = [table.get(w) or known(w) for w in self.split.findall(self.normal(part))]
            packed += [a for a, _ in made]
            names += [b for _, b in made]
        return b"".join(packed), " ".join(names)

    def decode(self, packed: bytes) -> str:
        return " ".join([self.name[i] for i in struct.unpack(f"<{len(packed) // 4}I", packed)])


def id_lists(counts: list[int], packed: list[bytes]) -> pa.ListArray:
    """Arrow lists straight from the packed ids, without a Python object for each id."""
    values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def encode(docs: DataFrame, vocabulary: str | None = None, ids: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document: the keep columns, n_tokens, ids (array<int>, unless ids=False), ids_sha256 and decoded_sha256.

    Null text counts as empty: no tokens, digests of nothing. Repeated rows stay; an empty table gives no rows.
    The path of the vocabulary file is a parameter; every executor must be able to open it.
    """
    path = vocabulary or default_vocabulary()
    df = pick(docs, *keep, "text")
    kinds = dict(df.dtypes)

    def start() -> Callable:
        bpe, digest = WordBpe(path), hashlib.sha256

        def work(*cols: list) -> list:
            n, all_ids, a, b = [], [], [], []
            for text in cols[-1]:
                packed, decoded = bpe.both(text or "")
                n.append(len(packed) // 4)
                if ids:
                    all_ids.append(packed)
                a.append(digest(packed).hexdigest())
                b.append(digest(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            return [*cols[:-1], n, *([id_lists(n, all_ids)] if ids else []), a, b]

        return work

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "n_tokens bigint", *(["ids array<int>"] if ids else []), "ids_sha256 string", "decoded_sha256 string"])
    return map_rows(df, start, schema)


def decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Rows (doc_id, ids array<int>) to (doc_id, text); null ids give null."""
    path = vocabulary or default_vocabulary()

    def start() -> Callable:
        name = WordBpe(path).name
        return lambda doc, ids: [doc, [None if x is None else " ".join([name[i] for i in x]) for x in ids]]

    return map_rows(tokens.select(tokens.doc_id.cast("bigint").alias("doc_id"), tokens.ids), start, "doc_id bigint, text string")
