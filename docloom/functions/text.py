"""Text functions as Column expressions. Patterns are Unicode-aware: (?iuU) folds case and widens \\s, \\w and \\b beyond ASCII."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import rules


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once a row, however often f reads it; fields of a struct are read by name."""
    return F.transform(F.array(x), f)[0]


#: What pytrim() strips: white space as Unicode has it, and the four separators before the blank.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def pytrim(x: Column | str) -> Column:
    """Strips all Unicode white space, where trim() strips blanks only."""
    return F.btrim(col(x), F.lit(SPACE))


def matched_trim(x: Column | str) -> Column:
    """pytrim() by a pattern, which tries every place of a text."""
    return F.regexp_replace(col(x), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def squeeze(x: Column | str) -> Column:
    """Runs of white space become one blank."""
    return F.regexp_replace(col(x), r"(?U)\s+", " ")


def like(x: Column | str, pattern: str) -> Column:
    return F.regexp_like(col(x), F.lit(pattern))


def group(x: Column | str, pattern: str, n: int) -> Column:
    """Group n of the first match, null without a match (regexp_extract alone gives '' for both)."""
    return F.when(like(x, pattern), F.regexp_extract(col(x), pattern, n))


def any_of(x: Column | str, words: list[str]) -> Column:
    """Whether a text contains one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(col(x), F.lit(w)) for w in words])


def starts_with_any(x: Column | str, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [col(x).startswith(m) for m in marks])


def upper_share(x: Column | str) -> Column:
    """Share of upper-case among all letters, null without letters."""
    letters = F.regexp_count(col(x), F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(col(x), F.lit(r"\p{Lu}")) / letters)


def head(x: Column | str, n: int = 60) -> Column:
    return pytrim(F.substring(col(x), 1, n))


def tail(x: Column | str, n: int = 40) -> Column:
    return pytrim(F.right(col(x), F.lit(n)))


# -- F1 to F3: prefix scores ---------------------------------------------------------------------------------------------


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, by bisection over prefix equality: log(n) steps in place of one per character."""
    most = F.least(F.length(a), F.length(b))
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.greatest(most, F.lit(1)) + 1)).cast("int"), F.lit(1)))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc.lo + acc.hi + 1) / 2).cast("int")
        same = a.substr(F.lit(1), mid) == b.substr(F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(acc.lo).alias("lo"), F.when(same, acc.hi).otherwise(F.greatest(mid - 1, acc.lo)).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), most.alias("hi"))
    return F.aggregate(steps, start, step, lambda acc: acc.lo)


def prefix_score(ref: Column | str, text: Column | str, fold: bool = False, floor: int = 3) -> Column:
    """Common prefix over the length of the first argument, both stripped; 0 under `floor` characters or if either is empty or null."""
    a, b = (matched_trim(F.coalesce(col(x), F.lit(""))) for x in (ref, text))
    if fold:
        a, b = F.lower(a), F.lower(b)

    def score(p: Column) -> Column:
        n = common_prefix(p.a, p.b)
        return F.when((p.a != "") & (p.b != "") & (n >= floor), n / F.length(p.a)).otherwise(F.lit(0.0))

    # Of the second text no more than the first is long can be common, and bisection reads both at every step.
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: let(F.struct(p.a.alias("a"), p.b.substr(F.lit(1), F.length(p.a)).alias("b")), score))


def combined_score(start: Column | str, end: Column | str, text: Column | str) -> Column:
    """0.7 * prefix score of the start + 0.3 * of the end; the start alone if the end is empty."""
    a = prefix_score(start, head(text))
    b = prefix_score(end, tail(text))
    return F.when(pytrim(F.coalesce(col(end), F.lit(""))) == "", a).otherwise(0.7 * a + 0.3 * b)


# -- F6 to F11: normal forms ---------------------------------------------------------------------------------------------


def norm_text(x: Column | str) -> Column:
    """Comparison form: lower case, single blanks, known letter-spaced words closed, hyphenation undone, then number, figure and dash prefixes dropped."""
    t = squeeze(F.lower(pytrim(x)))
    for spaced, closed in (("п р и м е ч а н и е", "примечание"), ("в н и м а н и е", "внимание"), ("примечание :", "примечание:")):
        t = F.replace(t, F.lit(spaced), F.lit(closed))
    t = F.regexp_replace(t, r"([а-яёa-z])-\s+([а-яёa-z])", "$1$2")
    t = F.regexp_replace(t, r"^\d+(?:\.\d+)*\s+", "")
    t = F.regexp_replace(t, r"(?iu)^рисунок\s+\d+\s*[–—\-]\s*", "")
    return F.regexp_replace(t, r"^[–—\-]\s*", "")


def norm_match(x: Column | str) -> Column:
    """Matching form: bullets and a single-level number dropped, lower case, runs of one-letter words closed, no blank before punctuation."""
    t = F.regexp_replace(pytrim(x), r"(?U)^[\-–—−•●○‣▪▫⁃]+\s*", "")
    t = squeeze(pytrim(F.lower(F.regexp_replace(t, r"(?U)^\d+[.)]\s+", ""))))
    # A blank between two one-letter words goes; both must stand alone.
    t = F.regexp_replace(t, r"(?<![^ ])(\p{L}) (?=\p{L}(?: |$))", "$1")
    return F.regexp_replace(t, r"(?U)\s+([;:,.])", "$1")


def norm_procedure(x: Column | str) -> Column:
    """Procedure form: lower case, single blanks, all leading numbers and one dash dropped."""
    t = F.regexp_replace(squeeze(F.lower(pytrim(x))), r"^(?:[\d.]+\s+)+", "")
    return F.regexp_replace(t, r"^[\-–—•]\s*", "")


def collapse_spaced(x: Column | str) -> Column:
    """Runs of three or more single characters parted by blanks are closed."""
    return F.regexp_replace(col(x), r"(?U)(?:(?<=(?<!\S)\S)\s(?=\S\s\S(?!\S))|(?<=(?<!\S)\S\s\S)\s(?=\S(?!\S))|(?<=(?<!\S)\S)\s(?=\S\s\S\s))", "")


def strip_list_prefix(x: Column | str) -> Column:
    t = F.regexp_replace(pytrim(x), r"^\d+(?:\.\d+)*[.)]*\s*", "")
    return F.regexp_replace(t, r"^[–\-•]\s*", "")


def heavy_form(x: Column | str) -> Column:
    """Letters and digits only, lower case, 80 at most."""
    return F.substring(F.regexp_replace(F.lower(col(x)), r"[^\p{L}\p{N}]+", ""), 1, 80)


def light_form(x: Column | str) -> Column:
    """Lower case, single blanks, 80 at most."""
    return F.substring(squeeze(F.lower(pytrim(x))), 1, 80)


def norm_name(x: Column | str) -> Column:
    return F.regexp_replace(squeeze(F.lower(pytrim(x))), r"\.+$", "")


# -- F12, F13: title case ------------------------------------------------------------------------------------------------


def capital(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))


def clean_title(x: Column | str) -> Column:
    """Control characters out, dashes unified, single blanks; a mostly upper-case title gets sentence case with capitals after dash and colon; final dots out."""
    t = F.translate(F.regexp_replace(F.regexp_replace(matched_trim(x), "[\r\x07]", ""), "\x0b", " "), "−‒", "––")

    def sentence(low: Column) -> Column:
        opened = let(F.regexp_instr(low, F.lit(r"\p{L}")), lambda at: F.concat(low.substr(F.lit(1), at - 1), F.upper(low.substr(at, F.lit(1))), low.substr(at + 1, F.length(low))))
        for mark in ("– ", "— ", ": "):
            opened = F.array_join(F.transform(F.split(opened, mark), lambda part, i: F.when((i > 0) & F.regexp_like(part, F.lit(r"^\p{Ll}")), capital(part)).otherwise(part)), mark)
        return opened

    def cased(t: Column) -> Column:
        loud = (F.length(t) > 5) & (F.coalesce(upper_share(t), F.lit(0.0)) >= 0.7)
        return F.when(loud, let(F.lower(t), sentence)).otherwise(t)

    return F.regexp_replace(let(matched_trim(squeeze(t)), cased), r"\.+$", "")


def title_case(x: Column | str) -> Column:
    """Unchanged if all letters are upper-case; otherwise every part outside parentheses gets one capital and lower case."""
    t = col(x)
    parts = F.regexp_extract_all(t, F.lit(r"(\([^)]*\)|(?:[^(]|\((?![^)]*\)))+)"), F.lit(1))
    made = F.transform(parts, lambda p: F.when(p.startswith("(") & p.endswith(")"), p).otherwise(capital(F.lower(p))))
    loud = F.regexp_like(t, F.lit(r"\p{Lu}")) & ~F.regexp_like(t, F.lit(r"\p{Ll}"))
    return F.when((t == "") | loud, t).otherwise(F.array_join(made, ""))


# -- F14, F15: prefixes of items and notes ---------------------------------------------------------------------------------

#: Numbers that open list items, in order of test. Fixed values.
NUMBER_MARKS = [
    r"^\d+\.\s*", r"^\d+\)\s*", r"^\(\d+\)\s*", r"^\d+\s*[.)]\s*", r"^[a-zA-Z]\.\s*", r"^[a-zA-Z]\)\s*", r"^\([a-zA-Z]\)\s*",
    r"^[IVXLCDM]+\.\s*", r"^[ivxlcdm]+\.\s*", r"^[IVXLCDM]+\)\s*", r"^[ivxlcdm]+\)\s*",
]


def clean_item(x: Column | str, kind: Column | str) -> Column:
    """One marker removed: a bullet for unnumbered lists, the first number form that changes the text for numbered ones."""
    t = pytrim(x)
    marks = "".join("\\" + m if m in "-*" else m for m in rules.LIST_MARKERS)
    bullet = pytrim(F.regexp_replace(t, f"^[{marks}]", ""))
    changed = [F.nullif(F.regexp_replace(t, p, ""), t) for p in NUMBER_MARKS]
    return F.when(col(kind) == "unnumbered_list", bullet).when(col(kind) == "numbered_list", pytrim(F.coalesce(*changed, t))).otherwise(t)


def clean_safety(x: Column | str) -> Column:
    t = pytrim(x)
    return pytrim(F.regexp_replace(t, r"(?iu)^(?:ВНИМАНИЕ|ОСТОРОЖНО|ПРЕДУПРЕЖДЕНИЕ)[!:]?", ""))


def note_body(x: Column | str) -> Column:
    """What follows the word for a note and its separator, '' if the text is no note."""
    first = r"(?sU)^[Пп]римечани[ея]\s*[.:–\-]\s*(.+)"
    second = r"(?sU)^[Пп]римечани[ея]\s+(.+)"
    return pytrim(F.when(like(x, first), F.regexp_extract(col(x), first, 1)).otherwise(F.regexp_extract(col(x), second, 1)))


def sanitize(x: Column | str) -> Column:
    """Without the characters that file names must not hold."""
    return pytrim(F.regexp_replace(col(x), r'[<>:"/\\|?*\x00-\x1f]', ""))


def local_tag(x: Column | str) -> Column:
    return F.element_at(F.split(col(x), "}"), -1)


# -- F19: ids --------------------------------------------------------------------------------------------------------------


def stable_id(seq: Column | str, kind: Column | str, text: Column | str) -> Column:
    """First 12 hex digits of SHA-256 over seq|type|stripped lower-case first 80 characters."""
    parts = F.concat_ws("|", col(seq).cast("string"), col(kind), F.lower(head(text, 80)))
    return F.substring(F.sha2(parts, 256), 1, 12)


def element_id(page: Column | str, y0: Column | str, text: Column | str) -> Column:
    """As stable_id over page, y rounded half-even to tens, and the first 30 characters."""
    parts = F.concat_ws("|", col(page).cast("string"), F.bround(col(y0), -1).cast("int").cast("string"), F.lower(head(text, 30)))
    return F.substring(F.sha2(parts, 256), 1, 12)


def procedure_id(idx: Column | str, kind: Column | str, text: Column | str) -> Column:
    return F.substring(F.md5(F.concat_ws("|", col(idx).cast("string"), col(kind), F.substring(col(text), 1, 60))), 1, 12)


# -- U9: word sets -----------------------------------------------------------------------------------------------------------


def word_set(x: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(col(x)), r"(?U)\s+"), lambda w: w != ""))


def word_jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over size of the union, 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))
