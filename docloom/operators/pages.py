"""Structured elements matched to page blocks, element first, with forward expansion over following blocks."""

from __future__ import annotations

import re
import statistics
from collections import namedtuple

from pyspark.sql import DataFrame

from docloom.functions import predicates as P
from docloom.operators.folds import paired_fold
from docloom.operators.matching import both_ends, prefix

OUT = "doc_id bigint, idx bigint, source_idx bigint, type string, type_source string, first_block bigint, span bigint, page bigint, x0 double, y0 double, x1 double, y1 double"
MARKS = re.compile(r"^[\-–—−•●○‣▪▫⁃]+\s*")
LISTS = {"numbered_list", "unnumbered_list", "nested_numbered_list", "nested_unnumbered_list"}


def normal(text: str) -> str:
    """The matching form of functions.text.norm_match, on one string."""
    t = re.sub(r"^\d+[.)]\s+", "", MARKS.sub("", text.strip())).lower()
    words: list[str] = []
    single = False
    for w in t.split():
        one = len(w) == 1 and w.isalpha()
        if one and single:
            words[-1] += w
        else:
            words.append(w)
        single = one
    return re.sub(r"\s+([;:,.])", r"\1", " ".join(words))


Wanted = namedtuple("Wanted", "idx type text_start text_end")
Block = namedtuple("Block", "page_num blk_seq x0 y0 x1 y1 text is_table")


class Page:
    """Blocks of one document in order, with what scoring needs of each, made once."""

    def __init__(self, rows: list):
        self.rows = sorted(rows, key=lambda r: [(x is None, x) for x in (r.page_num, r.y0, r.blk_seq)])
        self.text = [r.text or "" for r in self.rows]
        self.norm = [normal(t) for t in self.text]
        self.safe = [any(w in t.lower() for w in P.SAFETY_WORDS) or any(w in n for w in P.SAFETY_WORDS) for t, n in zip(self.text, self.norm)]
        gaps = [b.y0 - a.y1 for a, b in zip(self.rows, self.rows[1:]) if a.page_num == b.page_num and 0 < b.y0 - a.y1 < 50]
        self.gap = statistics.median(gaps) if gaps else 10.0
        # Blocks by the first three characters of their ends in both forms: without three in common with an element's a score is 0.
        self.keys = [{x[:3] for y in (t, n) for x in (y[:60].strip(), y[-40:].strip()) if len(x) >= 3} for t, n in zip(self.text, self.norm)]
        self.opened: dict[str, list[int]] = {}
        for i, keys in enumerate(self.keys):
            for k in keys:
                self.opened.setdefault(k, []).append(i)
        self.used: set[int] = set()

    def near(self, e) -> list[int]:
        """Blocks in order that can score at all for an element."""
        return sorted({i for k in e.keys for i in self.opened.get(k, ())})

    def score(self, e, i: int) -> float:
        s = max(both_ends(e.norm, e.end, self.norm[i]), both_ends(e.start, e.end, self.text[i]))
        return s * (0.1 if e.type in ("warning", "caution", "note") and not self.safe[i] else 1.0)

    def stops(self, e, claimed: list[int], i: int, others: dict) -> bool:
        """Whether block i does not belong to the element that holds the claimed blocks."""
        b, last, anchor = self.rows[i], self.rows[claimed[-1]], self.rows[claimed[0]]
        if (b.is_table and e.type != "table") or b.page_num > anchor.page_num + 1:
            return True
        same, gap = b.page_num == last.page_num, b.y0 - last.y1
        if same and gap > self.gap * (5 if e.type in LISTS else 3):
            turns = i + 1 < len(self.rows) and self.rows[i + 1].page_num > b.page_num
            if not turns:
                return True
        if any(o is not e and max(both_ends(o.norm, o.end, self.norm[i]), both_ends(o.start, o.end, self.text[i])) > 0.4 for k in self.keys[i] for o in others.get(k, ())):
            return True
        shift = abs(b.x0 - anchor.x0)
        if shift <= 40:
            return False
        return gap > self.gap * 1.5 if same else not (b.is_table and e.type == "table") and shift > 100

    def claim(self, e, i: int, others: dict) -> list[int]:
        claimed = [i]
        self.used.add(i)
        end = normal(e.end or "")
        while len(claimed) <= 30:
            n = claimed[-1] + 1
            if n >= len(self.rows) or n in self.used or self.stops(e, claimed, n, others):
                break
            claimed.append(n)
            self.used.add(n)
            if end and prefix(end, self.norm[n]) > 0.4:
                break
        return claimed


class Element:
    def __init__(self, r) -> None:
        self.idx, self.type, self.start, self.end = r.idx, r.type, r.text_start or "", r.text_end or ""
        self.norm = normal(self.start)
        self.keys = {x[:3] for x in (self.norm.strip(), self.start.strip(), self.end.strip()) if len(x) >= 3}
        self.least = 0.18 if r.type in ("table", "figure", "illustration") else 0.15 if len(self.norm) < 10 else 0.3


def match(elements: DataFrame, blocks: DataFrame, window: int = 80) -> DataFrame:
    """Elements (doc_id, idx, type, text_start, text_end) and blocks (doc_id, page_num, blk_seq, x0, y0, x1, y1, text, is_table) to OUT.

    Pass 1 looks for each element in order from 3 blocks before the cursor to `window` after, pass 2 for the rest anywhere. A match claims
    following blocks until one belongs elsewhere. What is left stays as _unmatched_xml with the box of the element before it, unused blocks
    as _extra_pdf; idx is numbered anew by page, height and order. One document is one group.
    """

    def one(key: tuple, e: list[tuple], b: list[tuple]) -> list[list]:
        want, page = [Element(Wanted(*r)) for r in e], Page([Block(*r) for r in b])
        others: dict[str, list[Element]] = {}
        for x in want:
            for k in x.keys:
                others.setdefault(k, []).append(x)
        got: dict[int, list[int]] = {}
        cursor = 0
        for whole in (False, True):
            for n, x in enumerate(want):
                if n in got:
                    continue
                options = page.near(x) if whole else [i for i in page.near(x) if cursor - 3 <= i < cursor + window]
                found, top = None, x.least
                for i in options:
                    if i not in page.used and (s := page.score(x, i)) > top:
                        found, top = i, s
                if found is not None:
                    got[n] = page.claim(x, found, others)
                    cursor = cursor if whole else got[n][-1] + 1
        rows: list[list] = []
        box = (1, 0.0, 0.0, 0.0, 0.0)
        for n, x in enumerate(want):
            own = [page.rows[i] for i in got.get(n, [])]
            if own:
                box = (own[0].page_num, round(min(r.x0 for r in own), 1), round(own[0].y0, 1), round(max(r.x1 for r in own), 1), round(own[-1].y1, 1))
            rows.append([key[0], 0, x.idx, x.type if own else "_unmatched_xml", "xml_derived", own[0].blk_seq if own else None, len(own) or 1, *box])
        for i, r in enumerate(page.rows):
            if i not in page.used:
                rows.append([key[0], 0, None, "_extra_pdf", "pdf", r.blk_seq, 1, r.page_num, r.x0, r.y0, r.x1, r.y1])
        rows.sort(key=lambda r: (r[7], r[9]))
        for n, r in enumerate(rows, 1):
            r[1] = n
        return rows

    return paired_fold(elements.select("doc_id", *Wanted._fields), blocks.select("doc_id", *Block._fields), ["doc_id"], ("idx", "blk_seq"), one, OUT)
