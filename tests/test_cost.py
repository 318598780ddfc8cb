"""Dear steps of conversion and verification, made cheaper with the same results."""

import sys

from pyspark.sql import functions as F

from docloom.functions import predicates as P, rules, text as X
from docloom.operators import assembly, folds, matching as M
from docloom.operators.sequence import MENTIONS
from docloom.plans.registry import table

#: Letters that fold to those of the patterns, beside their plain forms.
FORMS = {"т": "Ттᲄᲅ", "t": "Tt", "р": "Рр", "ф": "Фф", "d": "Dd", "м": "Мм", "в": "Ввᲀ", "о": "Ооᲂ", "п": "Пп", "c": "Cc", "w": "Ww"}


def plan(c):
    return c._jc.toString()


def test_white_space_is_stripped_without_a_pattern(spark):
    """equal to the pattern around every code point, alone and beside others."""
    points = [i for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and (i < 0x10000 or i % 257 == 0)]
    df = spark.createDataFrame([(chr(i),) for i in points] + [("",), (None,), (" \t a b　\x1c",)], "c string").select(F.explode(F.array("c", F.concat("c", F.lit(" x y "), "c"), F.concat(F.lit(" "), "c", F.lit("z")))).alias("c"))
    assert df.where(~X.pytrim("c").eqNullSafe(X.matched_trim("c"))).count() == 0
    assert "regexp" not in plan(X.pytrim("c"))


def test_first_letters_in_all_forms_that_fold(spark):
    """the cheap first look finds every code point that the case-insensitive pattern takes for its letter."""
    df = spark.createDataFrame([(chr(i),) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000], "c string")
    for letter, forms in FORMS.items():
        assert {r.c for r in df.where(X.like("c", f"(?iuU)^{letter}$")).collect()} == set(forms), letter


def test_cheap_first_looks_lose_nothing(spark):
    """references, warnings and mentions of tables are those of their patterns alone."""
    words = ["таблица 1", "ТАБЛ. 2", "ᲅаблица 3", "Table4", "table", "Рисунок 5 – да", "рис. 6 и Рис.7", "Фigure 8", "figure 9", "DMC-S5-A-10-00A", "dmc-s5-a-11-00A ", "Модуль данных 12", "Внимание!", "ᲀнимание", "невнимание", "осᲃорожно", "ОПАСНО", "a warning", "Caution", "(таблица 1)", "см. таб. 2,", "табл. ٣.,"]
    df = spark.createDataFrame([(f"{a}{b}{c}",) for a in ("", "x ", "я", "Рисунок 1 - ") for b in words for c in ("", " и таблица 3", ".,", ", ")] + [("",), (None,)], "t string")

    def found(kind, pattern):
        return F.transform(F.regexp_extract_all("t", F.lit("(?iuU)" + pattern), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("number")))

    whole = F.concat(*[found(k, p) for k, p in P.REFERENCES])
    assert df.where(~P.references("t").eqNullSafe(whole)).count() == 0
    assert df.where(F.size(whole) > 0).count() > 100
    assert df.where(~P.is_warning("t").eqNullSafe(X.like("t", r"(?iuU)\b(?:" + "|".join(rules.WARNING_WORDS) + r")\b"))).count() == 0
    cut = F.col("t")
    for m in MENTIONS:
        cut = F.regexp_replace(cut, f"(?iuU){m}", "")
    cut = X.pytrim(cut)
    cut = F.when(cut.endswith(".,"), F.substring(cut, F.lit(1), F.length(cut) - 2)).when(cut.endswith(","), F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)
    assert df.where(~assembly.cleaned(F.col("t")).eqNullSafe(cut)).count() == 0


def test_a_fold_of_two_sides_has_tasks_by_cores(spark):
    """not a task for each of many partitions, each of which writes a piece for every other."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        a = spark.range(9).selectExpr("id AS doc_id", "id AS n")
        out = folds.paired_fold(a, a, ["doc_id"], ("n", "n"), lambda key, x, y: [(*key, len(x) + len(y))], "doc_id bigint, n bigint")
        assert out.rdd.getNumPartitions() == max(32, 3 * spark.sparkContext.defaultParallelism)
        assert {tuple(r) for r in out.collect()} == {(i, 2) for i in range(9)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_a_comparison_is_one_fold(spark, monkeypatch):
    """the steps go over a document once, without a join for each; long documents, which go stepwise, get the same."""
    sides = [table(spark, "/root/testdata/sf0.001", t).where("doc_id < 60") for t in ("left_elements", "right_elements")]
    whole = lambda long: [sorted(map(tuple, df.collect())) for df in M.compare(*sides, long)]
    apart = whole(300)
    assert whole(0) == apart
    for step in ("fuzzy", "align_types", "contained", "by_stable_id"):
        monkeypatch.setattr(M, step, None)
    assert whole(M.LONG) == apart and len(apart[0]) > 100


def test_words_of_an_end_contain_too():
    """the last step looks for a start's words in the whole of the right elements, whatever took them."""
    left = [(1, "a", "para", "one two", "one two", "one two one two"), (2, "", "note", "red green blue", "zz", "red green blue zz")]
    right = [(1, "", "table", "yellow", "other", "yellow other"), (2, "a", "para", "start", "red green", "start red green")]
    assert M.in_turn(left, right[1:]) == [(0, 0), (1, 0)]
