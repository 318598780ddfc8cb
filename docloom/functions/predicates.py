"""Row predicates of document classification as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import rules
from docloom.functions.text import any_of, col, group, let, like, pytrim, starts_with_any, upper_share

BULLETS = r"\-–—−•●○‣▪▫⁃"


def _loud_after(x: Column | str, number: str) -> Column:
    """Upper-case share of what follows a number, null without number or letters."""
    return F.when(like(x, number), let(F.regexp_replace(col(x), number, ""), upper_share))


def main_header(x: Column | str) -> Column:
    """Number, then text whose letters are at least 70 % upper-case."""
    return F.coalesce(_loud_after(x, r"(?U)^\s*\d+(?:\.\d+)*\.?\s+") >= 0.7, F.lit(False))


def numbered_item(x: Column | str) -> Column:
    """Multi-level number, or single number with dot or parenthesis, then text under 70 % upper-case."""
    return F.coalesce(_loud_after(x, r"(?U)^\s*\d+(?:(?:\.\d+)+\.?|[.)])\s+") < 0.7, F.lit(False))


def quantity(x: Column | str) -> Column:
    return like(x, r"(?U)^\d+\s*шт\.?\s*[-–—]")


def all_caps(x: Column | str) -> Column:
    return like(x, r"\p{Lu}") & ~like(x, r"\p{Ll}")


def likely_by_text(x: Column | str) -> Column:
    """The checks of P3 that need the row alone: quantity, number, markers, dash, final semicolon."""
    return let(pytrim(x), likely_stripped)


def likely_stripped(t: Column) -> Column:
    """likely_by_text() of a text without white space around it."""
    dash = like(t, r"^[-*] ") & ~all_caps(t)
    return quantity(t) | numbered_item(t) | starts_with_any(t, rules.LIKELY_MARKERS) | dash | t.endswith(";")


def is_warning(x: Column | str) -> Column:
    """One of six words at word boundaries, in any case."""
    # The words' first letters, in all forms that fold to them, are looked for before the dearer boundary.
    return like(x, r"(?=[ВвᲀОоᲂПпCcWw])(?iuU)\b(?:" + "|".join(rules.WARNING_WORDS) + r")\b")


def warning_style(x: Column | str) -> Column:
    return F.coalesce(like(x, "(?iu)вниман"), F.lit(False))


def note_style(x: Column | str) -> Column:
    return F.coalesce(like(x, "(?iu)примеч|замеч"), F.lit(False))


def is_note(x: Column | str) -> Column:
    """The word for a note, then a separator."""
    return like(x, r"(?iuU)^\s*примечани[ея][\s.:–\-]")


def item_style_level(style: Column | str) -> Column:
    """Number of parts of the numbering in an item style, null for other styles."""
    return F.size(F.split(group(style, r"(?iuU)ПУНКТ\s+(\d+(?:\.\d+)*)", 1), r"\."))


#: (kind, pattern), in the order in which results are joined. Fixed values.
REFERENCES = [
    ("table_reference", r"\b[Тт]аблица\s*(\d+)"),
    ("table_reference", r"\b[Тт]абл\.\s*(\d+)"),
    ("table_reference", r"\bTable\s*(\d+)"),
    ("illustration_reference", r"^[Рр]исунок\s*(\d+)\s*[–-]\s*.+"),
    ("illustration_reference", r"\b[Рр]ис\.\s*(\d+)"),
    ("illustration_reference", r"\b[Фф]igure\s*(\d+)"),
    ("data_module_reference", r"\bDMC-[A-Z]\d+-[A-Z]-(\d+)-.*?\b"),
    ("data_module_reference", r"\bМодуль\s*данных\s*(\d+)"),
]
#: What each of them needs, first letters in all forms that fold to them: one cheap pass that most texts end with.
REFERRING = r"[TtТтᲄᲅ](?iuU:(?:аблица|абл\.|able)\s*\d)|[Рр](?iuU:(?:исунок|ис\.)\s*\d)|[Фф](?iuU:igure\s*\d)|[Dd](?iu:MC-)|[Мм](?iu:одуль)"


def references(x: Column | str) -> Column:
    """Array of (kind, number), pattern by pattern."""
    def of(kind: str, pattern: str) -> Column:
        numbers = F.regexp_extract_all(col(x), F.lit("(?iuU)" + pattern), F.lit(1))
        return F.transform(numbers, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("number")))

    none = F.array().cast("array<struct<kind:string,number:string>>")
    return F.when(like(x, REFERRING), F.concat(*[of(k, p) for k, p in REFERENCES])).when(col(x).isNotNull(), none)


def page_footer(x: Column | str) -> Column:
    """A page mark in a short text, or up to four digits alone."""
    return (like(x, r"Стр\.\s*\d") & (F.length(col(x)) < 200)) | like(pytrim(x), r"^\d{1,4}$")


SERVICE = (
    r"(?iuU)^(?:ТЕХНОЛОГИЧЕСКАЯ\s+КАРТА|Продолжение\s+ТК|Содержание\s+операци|Работы,?\s+выполняем|Контр|Трудоёмкость|чел\.\s*ч|"
    r"при\s+отклонени|К\s+РО|Пункт\s+РО|Наименование\s+работы|На\s+страницах|РУКОВОДСТВО\s+ПО\s+ТЕХН|ДЕЙСТВИТЕЛЬНО\s+ВСЕ|\d{3}\.\d{2}\.\d{2}$)"
)


def service_block(x: Column | str) -> Column:
    """Texts of two characters at most, and those of the card's form."""
    t = pytrim(x)
    return (F.length(t) <= 2) | like(t, SERVICE)


def list_start(x: Column | str) -> Column:
    """Bullet, number with dot or parenthesis, or multi-level number."""
    return like(pytrim(x), rf"(?U)^(?:[{BULLETS}]|\d+[.)]\s|\d+(?:\.\d+)+\s)")


def font_class(size: Column | str, text: Column | str, median: Column | str) -> Column:
    """Header by font, list by mark, else paragraph."""
    t = pytrim(text)
    mark = like(t, r"(?U)^(?:[\-–—−•●○]|\d+[.)]\s)")
    return F.when(col(size) > col(median) * 1.3, "header").when(mark, "unnumbered_list").otherwise("paragraph")


SAFETY_WORDS = ["внимание", "предупреждение", "предостережение", "осторожно", "примечание", "caution", "warning", "note"]


def context_factor(kind: Column | str, text: Column | str, norm: Column | str) -> Column:
    """0.1 for a safety type against a block without a safety word, else 1."""
    said = any_of(F.lower(col(text)), SAFETY_WORDS) | any_of(F.lower(col(norm)), SAFETY_WORDS)
    return F.when(col(kind).isin("warning", "caution", "note") & ~said, F.lit(0.1)).otherwise(F.lit(1.0))


def type_class(x: Column | str) -> Column:
    """The comparison class of a type, unknown types stay."""
    table = F.create_map(*[F.lit(v) for kv in rules.TYPE_CLASS.items() for v in kv])
    return F.coalesce(F.try_element_at(table, col(x)), col(x))


def types_compatible(a: Column | str, b: Column | str) -> Column:
    x, y = type_class(a), type_class(b)
    return (x == y) | (x.isin("list", "heading") & y.isin("list", "heading"))


def section_number(x: Column | str) -> Column:
    """The leading number of a section title, null if the rest has letters under 70 % upper-case."""
    number = r"(?U)^\s*(\d+(?:\.\d+)*)\.?\s+"
    rest = F.regexp_replace(col(x), number, "")
    return F.when(like(x, number) & (F.coalesce(upper_share(rest), F.lit(1.0)) >= 0.7), F.regexp_extract(col(x), number, 1))


def content_item(kind: Column | str, text: Column | str) -> Column:
    """A list type, a bullet and a blank, or a final semicolon under 120 characters."""
    t = pytrim(text)
    return col(kind).isin("unnumbered_list", "nested_unnumbered_list") | like(t, rf"(?U)^[{BULLETS}]\s+") | (t.endswith(";") & (F.length(t) < 120))


#: First words of steps. Fixed values.
IMPERATIVES = [
    "откройте", "закройте", "снимите", "установите", "проверьте", "убедитесь", "отсоедините", "подсоедините", "расконтрите", "законтрите",
    "ослабьте", "заверните", "произведите", "подключите", "отключите", "включите", "выключите", "слейте", "заправьте", "зарядите",
    "разрядите", "стравите", "прокачайте", "закачайте", "удалите", "нанесите", "протрите", "расстыкуйте", "состыкуйте", "расконсервируйте",
    "выполните", "выдержите", "дозарядите", "доразрядите", "уменьшите", "создайте",
]


def imperative(x: Column | str) -> Column:
    word = F.regexp_replace(F.lower(F.regexp_extract(col(x), r"(?U)^\s*(\S+)", 1)), r"[.,;:]+$", "")
    return word.isin(IMPERATIVES)


def inside(x0: Column, y0: Column, x1: Column, y1: Column, rect: Column) -> Column:
    """The centre of a block in a closed rectangle (struct x0, y0, x1, y1)."""
    return ((x0 + x1) / 2).between(rect.x0, rect.x1) & ((y0 + y1) / 2).between(rect.y0, rect.y1)


def loose_list(text: Column | str, in_colon_list: Column | str) -> Column:
    """Whether a row counts as a list item on the loose test: the text as written opens with a marker, or ends in ; or . without white space, or a colon above it opened a list."""
    raw = F.col(text) if isinstance(text, str) else text
    inside = F.col(in_colon_list) if isinstance(in_colon_list, str) else in_colon_list
    t = pytrim(raw)
    return F.when(starts_with_any(raw, rules.LIST_MARKERS) | t.endswith(";") | t.endswith(".") | inside, F.lit("unnumbered_list"))
