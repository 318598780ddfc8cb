"""Word lists, rule tables and type vocabularies that results depend on."""

# Rules of title -> information code: (required words, excluded words, code, variant, priority). Fixed values.
INFO_CODE_RULES = [
    (["демонтаж"], [], "920", "A", 10),
    (["дм "], [], "920", "A", 9),
    (["смазк"], [], "242", "A", 10),
    (["герметичност"], [], "364", "A", 10),
    (["разрядк"], [], "224", "A", 10),
    (["стравливан"], [], "227", "A", 10),
    (["слив"], ["фильтр"], "222", "A", 10),
    (["удален", "воздух"], [], "231", "A", 11),
    (["подключен", "наземн"], [], "926", "A", 11),
    (["подключен", "канал"], [], "730", "A", 11),
    (["монтаж", "арматур"], [], "721", "A", 11),
    (["восстановлен"], [], "420", "A", 10),
    (["визуальн", "осмотр"], [], "311", "B", 11),
    (["осмотр"], ["визуальн"], "311", "A", 10),
    (["контрол", "воздух"], [], "369", "A", 11),
    (["чистот"], [], "371", "A", 10),
    (["электромагнитн"], [], "341", "A", 10),
    (["работоспособност"], [], "341", "A", 8),
]

# (system, subsystem, component or '*', code) -> code. Fixed values.
OVERRIDES = [
    ("029", "30", "05", "040", "042"),
    ("029", "12", "02", "920", "922"),
    ("029", "30", "*", "341", "320"),
]

# Roots that make a title self-describing. Fixed values.
SELF_DESCRIBING = [
    "указани", "осмотр", "смазк", "заправк", "слив", "обслуживан", "консервац", "расконсервац", "демонтаж", "монтаж",
    "работ", "таблиц", "очистк", "зарядк", "контрол", "проверк", "особенност", "внеплановое", "подготовительн", "заключительн",
]

# Modules that a fault list and a maintenance card are split into. Fixed values.
FAULT_MODULES = [
    ("01", "Недозаправка 1ГС (2ГС)", "Устранение неисправности"),
    ("02", "ВОЗДУХ в 1 ГС (2ГС)", "Устранение неисправности"),
    ("03", "Отсутствие показаний на мнемокадре ГПС уровня заправки гидрокомпенсатора 1ГС (2ГС)", "Устранение неисправности"),
    ("04", "Отсутствие показаний на мнемокадре ГПС давления 1ГС (2ГС)", "Устранение неисправности"),
    ("05", "Отсутствие показаний на мнемокадре ГПС давления в гидроаккумуляторе 1ГС (2ГС)", "Устранение неисправности"),
]
CARD_MODULES = [
    ("012", "A", "Меры безопасности"),
    ("720", "A", "Общие указания при монтаже фторопластовых рукавов"),
    ("920", "A", "Общие указания при проведении демонтажно-монтажных работ"),
]

# Keywords of special files in the root folder, in order of test. Fixed values.
ROOT_SPECIAL = [("лрви", "lrvi"), ("лри", "lri"), ("пдс", "pds"), ("ппс", "pps"), ("содержание", "contents")]

# Marks that open a list item: for the early test, and for the list test. Fixed values.
LIKELY_MARKERS = ["•", "◦", "▪", "▫", "⁃", "·", "−", "–", "—", "†", "‡", "§"]
LIST_MARKERS = ["•", "◦", "▪", "▫", "⁃", "·", "-", "–", "—", "*", "†", "‡", "§"]

# Words that make a text a warning. Fixed values.
WARNING_WORDS = ["внимание", "осторожно", "предупреждение", "caution", "warning", "опасно"]

# Comparison classes of element types. Fixed values.
TYPE_CLASS = {
    "paragraph": "para", "para": "para",
    "illustration": "figure", "figure": "figure", "illustration_reference": "figure",
    "numbered_list": "list", "unnumbered_list": "list", "nested_numbered_list": "list", "nested_unnumbered_list": "list",
    "heading": "heading", "header": "heading",
}

# Element types of overrides and of reference markup, mapped to analyzer types. Fixed values.
OVERRIDE_TYPES = {"heading": "numbered_paragraph_header", "caution": "warning", "note": "paragraph", "para": "paragraph", "figure": "illustration"}
MARKUP_TYPES = {"heading": "header", "caution": "caution", "note": "note", "para": "paragraph", "figure": "illustration"}
SENTINELS = ["_skip", "_extra_pdf", "_unmatched_xml"]
