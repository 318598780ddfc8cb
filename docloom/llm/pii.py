"""Personal data by anchor expansion.

One automaton of short anchors (at-signs, schemes, digits, plus-digit and cue words) runs once over a text. At each anchor a local parser
walks outward to the span's boundaries and validates it: e-mail and network addresses, card and phone numbers, addresses that name a
person, and account numbers beside a cue. A parser starts where the last span of its kind ended, so spans of a kind never overlap.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from docloom.llm.common import map_rows, pick

KINDS = ("email", "ip", "card", "phone", "url", "ip6", "iban", "account", "handle")
EMAIL, IP, CARD, PHONE, URL, IP6, IBAN, ACCOUNT, HANDLE = range(len(KINDS))
#: Kinds of the base patterns; spans of the others are reported only clear of these.
BASE = 4

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
WORDY = LOCAL[:62] + "_"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIAL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Behind a scheme: what may follow up to white space, quotes and brackets.
REST = re.compile(r"[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]+")
#: Addresses that name a person: credentials or a bare address as host, a home folder, a profile.
PERSONAL = re.compile(r"[^/?#]*@|[0-9.]+(?:[:/]|$)|[^?#]*/(?:~|(?:users?|profile|people|in|u)/)[A-Za-z0-9._-]{2,}", re.I)
HEXES = re.compile(r"[0-9A-Fa-f:]+(?:(?<=:)[0-9]{1,3}(?:\.[0-9]{1,3}){3})?")
HEXDIGITS = "0123456789ABCDEFabcdef:"
NAME = re.compile(r"[A-Za-z0-9_]{3,30}(?![A-Za-z0-9_@.-])")
IBAN_AT = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Behind a cue: a few signs, then an identifier of which five characters at least are digits.
BESIDE = re.compile(r"(?:\x20(?:number|no|nr|id))?[\x20.:=#'\"]{1,4}([A-Za-z0-9](?:[A-Za-z0-9]|-(?=[A-Za-z0-9])){3,33})", re.I)

# Schemes and cue words, found in either case.
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "git://")
CUES = ("account", "acct", "iban", "ssn", "passport", "customer", "member", "patient", "employee", "login", "user", "username", "tax id", "kundennummer", "konto", "compte", "cuenta")


def parts_of(m: re.Match) -> list[tuple[int, int]]:
    """Numbers joined by dots taken by fours from the left: (start, end) of each four."""
    out, at, ends = [], m.start(), []
    for x in m[0].split("."):
        ends.append((at, at + len(x)))
        at += len(x) + 1
    for k in range(0, len(ends) - 3, 4):
        out.append((ends[k][0], ends[k + 3][1]))
    return out


def octets(text: str) -> bool:
    return all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in text.split(".")))


def luhn(digits: str) -> bool:
    """Whether 12 to 19 digits pass the check of Luhn."""
    if not 12 <= len(digits) <= 19:
        return False
    values = [int(d) for d in digits[::-1]]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def only_digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def ip6(text: str) -> bool:
    if text.count(":") < 3 or sum(map(bool, text.split(":"))) < 4:
        return False
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


def automaton():
    """Anchors to the parsers they start."""
    import ahocorasick

    a = ahocorasick.Automaton()
    own: dict[str, tuple[int, ...]] = {"@": (EMAIL, HANDLE), ":": (IP6,)}
    own |= {d: (IP, CARD) for d in "0123456789"} | {f"+{d}": (PHONE,) for d in "0123456789"}
    own |= {s[-3:]: (URL,) for s in SCHEMES} | {c: (ACCOUNT,) for c in CUES} | {"iban": (IBAN, ACCOUNT)}
    for anchor, kinds in own.items():
        a.add_word(anchor, (len(anchor), kinds))
    a.make_automaton()
    return a


#: For texts whose lower-case form is longer: only ASCII letters change, so places stay.
LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else text.translate(LOWER)


class Scanner:
    """Parsers of one text. free[k] is where the next span of kind k may start."""

    def __init__(self, text: str):
        self.text = text
        self.free = [0] * len(KINDS)
        self.found: list[tuple[int, int, int]] = []
        self.at_sign = 0  # behind the last at-sign: no local part reaches across it

    def add(self, kind: int, start: int, end: int) -> None:
        self.found.append((start, kind, end))

    def email(self, at: int) -> None:
        low = max(self.free[EMAIL], self.at_sign)
        start = low + len(self.text[low:at].rstrip(LOCAL))
        self.at_sign = at + 1
        if start < at and (m := DOMAIN.match(self.text, at + 1)):
            self.add(EMAIL, start, m.end())
            self.free[EMAIL] = m.end()

    def ip(self, at: int) -> None:
        if m := NUMBERS.match(self.text, at):
            for start, end in parts_of(m):
                if octets(self.text[start:end]):
                    self.add(IP, start, end)
            self.free[IP] = m.end()
        else:
            while at < len(self.text) and self.text[at] in "0123456789":
                at += 1
            self.free[IP] = at

    def card(self, at: int) -> None:
        if m := DIGITS.match(self.text, at):
            if m.end() - at >= 12 and luhn(only_digits(m[0])):
                self.add(CARD, at, m.end())
            self.free[CARD] = m.end()

    def phone(self, at: int) -> None:
        if m := DIAL.match(self.text, at):
            if 9 <= len(only_digits(m[0])) <= 15:
                self.add(PHONE, at, m.end())
            self.free[PHONE] = m.end()

    def url(self, at: int) -> None:
        """at: of '://'. A known scheme stands to the left, alone."""
        head = self.text[max(0, at - 5) : at + 3].lower()
        scheme = next((s for s in SCHEMES if head.endswith(s)), None)
        if not scheme or not (m := REST.match(self.text, at + 3)):
            return
        start = at + 3 - len(scheme)
        if start and self.text[start - 1] in WORDY:
            return
        end = at + 3 + len(m[0].rstrip(".,;:!?')"))
        if PERSONAL.match(self.text[at + 3 : end]):
            self.add(URL, start, end)
        self.free[URL] = max(end, at + 3)

    def ip6(self, at: int) -> None:
        low = self.free[IP6]
        start = low + len(self.text[low:at].rstrip(HEXDIGITS))
        m = HEXES.match(self.text, start)
        end = start + len(m[0]) - (m[0].endswith(":") and not m[0].endswith("::"))
        clear = (not start or self.text[start - 1] not in WORDY) and (m.end() == len(self.text) or self.text[m.end()] not in WORDY)
        if clear and end - start <= 45 and ip6(self.text[start:end]):
            self.add(IP6, start, end)
        self.free[IP6] = m.end()

    def iban(self, at: int) -> None:
        """at: of the cue; the number starts within the next 16 characters."""
        for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}", self.text[at : at + 20]):
            whole = IBAN_AT.match(self.text, at + m.start())
            if whole and iban(whole[0]):
                self.add(IBAN, *whole.span())
                self.free[IBAN] = self.free[ACCOUNT] = whole.end()
                return

    def account(self, at: int, end: int) -> None:
        """A cue from at to end: a whole word, an identifier behind it."""
        if at and self.text[at - 1].isalpha():
            return
        if (m := BESIDE.match(self.text, end)) and len(only_digits(m[1])) >= 5 and m.start(1) >= self.free[ACCOUNT]:
            self.add(ACCOUNT, *m.span(1))
            self.free[ACCOUNT] = m.end(1)

    def handle(self, at: int) -> None:
        """A name behind an at-sign that ends no local part."""
        if at and self.text[at - 1] in LOCAL + "/=":
            return
        if (m := NAME.match(self.text, at + 1)) and not m[0].isdigit():
            self.add(HANDLE, at, m.end())


def spans(text: str, anchors) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind number, end) in code points: those of the base kinds, and all. By start, then kind."""
    s = Scanner(text)
    free = s.free
    for last, (length, kinds) in anchors.iter(lowered(text)):
        at = last - length + 1
        for k in kinds:
            if k == EMAIL:
                s.email(at)  # every at-sign counts, even within a span
            elif at < free[k]:
                continue
            elif k == IP:
                s.ip(at)
            elif k == CARD:
                s.card(at)
            elif k == PHONE:
                s.phone(at)
            elif k == URL:
                s.url(at)
            elif k == IP6:
                s.ip6(at)
            elif k == IBAN:
                s.iban(at)
            elif k == ACCOUNT:
                s.account(at, last + 1)
            else:
                s.handle(at)
    base = sorted(x for x in s.found if x[1] < BASE)
    if len(base) == len(s.found):
        return base, base
    more, at, reach = [], 0, 0
    for x in sorted(x for x in s.found if x[1] >= BASE):
        while at < len(base) and base[at][0] < x[2]:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= x[0]:
            more.append(x)
    return base, sorted(base + more)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, found (array of kind, start, end, value; by start, then kind), n_email, n_ip, n_card, n_phone, n_more, base_sha256, spans.

    Null text counts as empty: nothing found. Whole texts are read once, each by itself; repeated rows stay, and a text of any length is walked in time
    in proportion to it. Spans of one base kind never overlap; spans of two may (a card number within a phone number), and both stay, the kind listed
    first ahead. Spans of the kinds beyond the base are left out where they touch a base span.
    """

    def start() -> Callable:
        anchors = automaton()

        def one(text: str | None) -> tuple:
            text = text or ""
            base, every = spans(text, anchors)
            count = [sum(k == x for _, k, _ in base) for x in range(BASE)]
            found = [{"kind": KINDS[k], "start": s, "end": e, "value": text[s:e]} for s, k, e in every]
            return found, *count, len(every) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)

        return lambda doc, text: [doc, *map(list, zip(*map(one, text)))]

    schema = "doc_id bigint, found array<struct<kind: string, start: int, end: int, value: string>>, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_more bigint, base_sha256 string, spans string"
    return map_rows(pick(docs, "doc_id", "text"), start, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id, text with each found stretch replaced by its kind in angle brackets (overlapping spans as one, under the first one's kind), n_spans.

    Null text stays null, a text without personal data stays as it is.
    """

    def start() -> Callable:
        anchors = automaton()

        def one(text: str | None) -> tuple[str | None, int]:
            if not text:
                return text, 0
            out, at = [], 0
            every = spans(text, anchors)[1]
            for s, k, e in every:
                if s >= at:
                    out += [text[at:s], f"<{KINDS[k]}>"]
                at = max(at, e)
            return "".join(out) + text[at:], len(every)

        return lambda doc, text: [doc, *map(list, zip(*map(one, text)))]

    return map_rows(pick(docs, "doc_id", "text"), start, "doc_id bigint, text string, n_spans bigint")
