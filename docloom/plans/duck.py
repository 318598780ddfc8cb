"""Spellings of text functions in DuckDB's SQL (RE2 patterns), for the oracles."""

from __future__ import annotations

from docloom.functions import rules

WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def sub(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', '{flags}')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def count(x: str, kind: str) -> str:
    return f"length(regexp_replace({x}, '[^{kind}]', '', 'g'))"


def upper_share(x: str) -> str:
    return f"(CASE WHEN {count(x, chr(92) + 'p{L}')} > 0 THEN {count(x, chr(92) + 'p{Lu}')}::double / {count(x, chr(92) + 'p{L}')} END)"


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def starts_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{w}')" for w in words) + ")"


def loud(x: str, number: str, test: str) -> str:
    return f"(CASE WHEN {has(x, number)} THEN coalesce({upper_share(sub(x, number))} {test}, false) ELSE false END)"


def main_header(x: str) -> str:
    return loud(x, rf"^{WS}*\d+(?:\.\d+)*\.?{WS}+", ">= 0.7")


def numbered_item(x: str) -> str:
    return loud(x, rf"^{WS}*\d+(?:(?:\.\d+)+\.?|[.)]){WS}+", "< 0.7")


def all_caps(x: str) -> str:
    return rf"({has(x, r'\p{Lu}')} AND NOT {has(x, r'\p{Ll}')})"


def likely(x: str) -> str:
    t = trim(x)
    return f"({has(t, rf'^[0-9]+{WS}*шт[.]?{WS}*[-–—]')} OR {numbered_item(t)} OR {starts_any(t, rules.LIKELY_MARKERS)} OR ({has(t, '^[-*] ')} AND NOT {all_caps(t)}) OR ends_with({t}, ';'))"


def word(words: list[str]) -> str:
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({'|'.join(words)})([^\p{{L}}\p{{N}}_]|$)"


def head(x: str, n: int = 60) -> str:
    return trim(f"substring({x}, 1, {n})")


def tail(x: str, n: int = 40) -> str:
    return trim(f"right({x}, {n})")


def norm_text(x: str) -> str:
    t = squeeze(f"lower({trim(x)})")
    for a, b in (("п р и м е ч а н и е", "примечание"), ("в н и м а н и е", "внимание"), ("примечание :", "примечание:")):
        t = f"replace({t}, '{a}', '{b}')"
    t = sub(t, r"([а-яёa-z])-\s+([а-яёa-z])", r"\1\2")
    t = sub(t, r"^\d+(?:\.\d+)*\s+")
    t = sub(t, r"^рисунок\s+\d+\s*[–—\-]\s*")
    return sub(t, r"^[–—\-]\s*")


def common_prefix(a: str, b: str) -> str:
    return f"coalesce(len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: left({a}, i) = left({b}, i))), 0)"


def prefix_score(a: str, b: str, floor: int = 3) -> str:
    x, y = trim(f"coalesce({a}, '')"), trim(f"coalesce({b}, '')")
    n = common_prefix(x, y)
    return f"(CASE WHEN length({x}) > 0 AND length({y}) > 0 AND {n} >= {floor} THEN {n}::double / length({x}) ELSE 0.0::double END)"


def type_class(x: str) -> str:
    return f"(CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.TYPE_CLASS.items()) + f" ELSE {x} END)"
