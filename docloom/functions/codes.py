"""Module codes: parsing coded names and building keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import rules
from docloom.functions.text import let, any_of, col, like, pytrim

#: A coded folder name: eleven parts in brackets, a title, an optional language tail. Fixed value.
CODE = (
    r"^\[([A-Z0-9]+)-([A-Z])-(\d{2,3})-(\d)(\d)-(\d{2})-(\d{2})([A-Z])-(\d{3})([A-Z])-([A-Z])\]\s*(.+?)(?:_\d{3}_[a-z]{2}-[A-Z]{2})?$"
)
PARTS = [
    "modelIdentCode", "systemDiffCode", "systemCode", "subSystemCode", "subSubSystemCode", "assyCode", "disassyCode",
    "disassyCodeVariant", "infoCode", "infoCodeVariant", "itemLocationCode",
]


def _parts(name: Column | str) -> Column:
    """The twelve groups of a coded name from one match, as an array; any other name gives an array of one."""
    return F.split(F.regexp_replace(col(name), CODE, "\x01".join(f"${i}" for i in range(1, 13))), "\x01")


def dm_code(name: Column | str) -> Column:
    """Struct of the eleven code parts, all strings; null for names without a code."""
    made = F.transform(F.array(_parts(name)), lambda found: F.when(F.size(found) == 12, F.struct(*[F.get(found, F.lit(i)).alias(p) for i, p in enumerate(PARTS)])))
    return F.get(made, F.lit(0))


def with_code(df: DataFrame, name: str) -> DataFrame:
    """df with dm_code and its title (null for names without a code), each name matched once: the one-row generator keeps the optimizer from copying the match into every use."""
    df = df.select("*", F.explode(F.array(_parts(name))).alias("_c"))
    coded = F.size("_c") == 12
    code = F.when(coded, F.struct(*[F.get("_c", F.lit(i)).alias(p) for i, p in enumerate(PARTS)]))
    return df.select("*", code.alias("dm_code"), F.when(coded, pytrim(F.get("_c", F.lit(11)))).alias("dm_title")).drop("_c")


def title_part(name: Column | str) -> Column:
    return let(_parts(name), lambda found: F.when(F.size(found) == 12, pytrim(F.get(found, F.lit(11)))))


def title_parts(title: Column | str) -> Column:
    """(tech_name, info_name), split once at a period and white space."""
    parts = F.split(col(title), r"\.\s+", 2)
    return F.when(col(title).isNotNull(), F.struct(pytrim(parts[0]).alias("tech_name"), F.coalesce(pytrim(F.get(parts, F.lit(1))), F.lit("")).alias("info_name")))


def number(code: Column | str) -> Column:
    return F.when(like(code, r"^\s*\d+\s*$"), F.trim(col(code)).try_cast("int"))


def is_descriptive(code: Column | str) -> Column:
    """0 to 99; false for anything that is no number."""
    return F.coalesce(number(code).between(0, 99), F.lit(False))


def is_procedure(code: Column | str) -> Column:
    return F.coalesce(number(code) >= 100, F.lit(False))


def code_string(code: Column) -> Column:
    """file name of a module; missing parts take their defaults."""
    d = {"modelIdentCode": "S5", "systemDiffCode": "A", "systemCode": "000", "subSystemCode": "0", "subSubSystemCode": "0", "assyCode": "00", "disassyCode": "00", "disassyCodeVariant": "A", "infoCode": "000", "infoCodeVariant": "A", "itemLocationCode": "A"}
    p = {k: F.coalesce(code[k], F.lit(v)) for k, v in d.items()}
    return F.concat(
        F.lit("DMC-"), p["modelIdentCode"], F.lit("-"), p["systemDiffCode"], F.lit("-"), p["systemCode"], F.lit("-"), p["subSystemCode"], p["subSubSystemCode"], F.lit("-"), p["assyCode"],
        F.lit("-"), p["disassyCode"], p["disassyCodeVariant"], F.lit("-"), p["infoCode"], p["infoCodeVariant"], F.lit("-"), p["itemLocationCode"], F.lit("_001"),
    )


def graphic_prefix(code: Column) -> Column:
    """prefix of a module's graphics."""
    plain = F.regexp_replace(code_string(code), "^DMC-|_001$", "")
    return F.when(code.isNotNull(), F.concat(F.lit("G"), plain, F.lit("_001_RU-RU")))


def module_string(sys: Column, sub: Column, comp: Column, assy: Column, disassy: Column, info: Column, variant: Column, model: str = "S5", diff: str = "A", place: str = "A") -> Column:
    """one field holds the disassembly code, or the assembly code where that is 00."""
    field = F.when(disassy != "00", disassy).otherwise(assy)
    return F.concat(F.lit(f"{model}-{diff}-"), sys, F.lit("-"), sub, F.lit("-"), comp, F.lit("-"), field, F.lit("A-"), info, variant, F.lit(f"-{place}"))


def folder_dmc(name: Column | str) -> Column:
    """A bracketed code anywhere in a name, null if there is none."""
    pattern = r"\[([A-Z0-9]+-[A-Z]-\d{2,3}-\d{2}-\d{2}-\d{2}[A-Z]-\d{3}[A-Z]-[A-Z])\]"
    return F.when(like(name, pattern), F.regexp_extract(col(name), pattern, 1))


def self_describing(title: Column | str) -> Column:
    """P34."""
    return F.coalesce(any_of(F.lower(col(title)), rules.SELF_DESCRIBING), F.lit(False))


def info_code(titles: DataFrame, title: str = "title") -> DataFrame:
    """Adds code and variant by the rule of highest priority, ties to the first rule; null without a rule.

    The rules are a fixed list, so the rule join folds into one expression per row and needs no join at all.
    """
    low = F.lower(F.col(title))

    def hit(required: list[str], excluded: list[str]) -> Column:
        out = F.lit(True)
        for w in required:
            out = out & F.contains(low, F.lit(w))
        for w in excluded:
            out = out & ~F.contains(low, F.lit(w))
        return out

    found = [F.when(hit(req, exc), F.struct(F.lit(p).alias("p"), F.lit(-n).alias("n"), F.lit(c).alias("code"), F.lit(v).alias("variant"))) for n, (req, exc, c, v, p) in enumerate(rules.INFO_CODE_RULES)]
    best = F.greatest(*found)
    # The one-row generator keeps the optimizer from copying the rules into every use of the code.
    return titles.select("*", F.explode(F.array(best)).alias("_best")).select(*titles.columns, F.col("_best.code").alias("code"), F.col("_best.variant").alias("variant"))


def override(sys: Column | str, sub: Column | str, comp: Column | str, info: Column | str) -> Column:
    """Exact key, else the key with any component, else unchanged."""
    exact = wild = None
    for s, b, c, old, new in rules.OVERRIDES:
        key = (col(sys) == s) & (col(sub) == b) & (col(info) == old)
        if c == "*":
            wild = F.when(key, new) if wild is None else wild.when(key, new)
        else:
            key = key & (col(comp) == c)
            exact = F.when(key, new) if exact is None else exact.when(key, new)
    return F.coalesce(exact, wild, col(info))


def letters(n: Column) -> Column:
    """A to Z for 0 to 25, then AA, AB and so on, to five letters: a code that stays unique and within letters where one letter does not do."""
    out = None
    first = 0
    for width in range(1, 6):
        digits = [F.char(65 + F.floor((n - first) / 26 ** (width - 1 - i)) % 26) for i in range(width)]
        own = F.concat(*digits)
        first += 26**width
        out = F.when(n < first, own) if out is None else out.when(n < first, own)
    return out


def letters_number(variant: Column | str) -> Column:
    """The number that letters() made a variant of, 0 for A."""
    return F.aggregate(F.split(variant, ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1


def character(n: Column) -> Column:
    """The character n places after A."""
    return F.decode(F.unhex(F.lpad(F.hex((n + 65).cast("bigint")), 8, "0")), "UTF-32")


def letter_number(variant: Column) -> Column:
    """The number of a variant of one letter, 0 for A."""
    return F.ascii(variant) - 65
