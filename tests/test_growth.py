"""What must not be done, or held, for a job to grow no faster than its input."""

import random
from pathlib import Path
from time import sleep
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import matching as M, sequence as S
from docloom.operators.folds import each_row
from docloom.plans import QUERIES
from docloom.sources.store import RELEASE, released, shared

DATA = "/root/testdata/sf0.001"
ELEMENT = "doc_id bigint, idx bigint, type string, text_start string, text_end string, stable_id string"


def test_an_equal_end_asks_for_no_ratio(spark, monkeypatch):
    """the similarity is 1 by one equal end, whatever the other one is."""
    left = spark.createDataFrame([(1, 1, "para", "one start", "its own end", "a"), (1, 2, "para", "own start here", "the same end", "b")], ELEMENT)
    right = spark.createDataFrame([(1, 1, "para", "one start", "another close", "a"), (1, 2, "para", "quite different", "the same end", "b")], ELEMENT)
    monkeypatch.setattr(M, "seq_ratio", lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.raise_error(F.lit("a ratio was asked for")).cast("double")))
    matches, report = M.compare(left, right)
    assert [r.sim for r in matches.collect()] == [1.0, 1.0]
    assert [(r.matched, r.score) for r in report.collect()] == [(2, 1.0)]


def test_counts_need_no_comparison(spark, monkeypatch):
    """the sizes of both sides are counted, not compared."""
    whole = {(r.doc_id, r.left_count, r.right_count) for r in QUERIES["a2_comparison"](spark, DATA).collect()}
    monkeypatch.setattr(M, "compare", lambda *_: pytest.fail("elements were compared"))
    assert {tuple(r) for r in QUERIES["a2_counts"](spark, DATA).collect()} == whole


@pytest.mark.parametrize("name", ["s10_box_tables", "s11_illustrations", "s7_docx_round_trip", "j11_pages", "j11_unmatched", "s16_module_elements", "s16_module_rows", "s17_rendered"])
def test_documents_are_folds_not_frames(spark, name):
    """No frame for each document, and no batch of what a whole input batch yields."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan


def test_output_batches_are_bounded(spark):
    """rows of many to a row leave in batches of `rows`, and none is lost."""
    out = each_row(spark.range(250).select("id"), lambda i: [(i, n) for n in range(4)], "id bigint, n bigint", rows=10)
    assert {tuple(r) for r in out.collect()} == {(i, n) for i in range(250) for n in range(4)}


def test_a_break_at_the_end_of_a_row_starts_a_line(spark):
    """the rest after the last break is taken by look-up, not by a pattern that tries every start of a long line."""
    rows = spark.createDataFrame([(1, 0, "abc\n"), (1, 1, "x"), (1, 2, "y\r"), (1, 3, "z")], "doc_id bigint, seq bigint, text string")
    assert [(r.line, r.column) for r in S.positions(rows).orderBy("seq").collect()] == [(0, 0), (1, 0), (1, 1), (1, 3)]


def test_a_text_is_cleaned_once_a_row(spark):
    """what scores and titles read several times is made once."""
    df = spark.createDataFrame([("a", "b")], "a string, b string")
    plan = lambda c: df.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(X.prefix_score("a", "b")).count("regexp_replace") == 2
    assert plan(X.clean_title("a")).count("regexp_replace") == 5 + 1


def test_a_ratio_is_computed_once_a_task(spark):
    """pairs that recur in later batches are remembered; sure pairs are not asked for."""
    import pandas as pd

    from docloom.functions import similarity

    asked = []
    ratio, similarity.ratio = similarity.ratio, lambda a, b: asked.append((a, b)) or 0.5
    try:
        batch = pd.Series(["ab", None, "x"]), pd.Series(["ac", "b", "x"])
        out = [list(x) for x in similarity._ratios.func(iter([batch, batch]))]
    finally:
        similarity.ratio = ratio
    assert asked == [("ab", "ac")] and [[x[0], x[2]] for x in out] == [[0.5, 1.0]] * 2


def test_a_path_is_made_once_a_use(spark):
    """once for the tasks, once for the number of files."""
    plan = QUERIES["s1_tasks"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws(/") == 2


def _held(spark):
    """Files of shuffles on this machine's disk, and tables in the shared folder."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    shuffled = {files.apply(i).getName() for i in range(files.size())}
    return {f for f in shuffled if f.startswith("shuffle_")}, {p.name for p in Path(urlparse(shared(spark)).path).iterdir()}


def test_a_verification_leaves_no_shuffled_rows(spark):
    """what a step shuffled or stored is gone once the next one has its own table; but for numbers a document the elements stay, and the settings are as they were."""
    shared(spark)
    was, held = spark.conf.get(RELEASE, None), _held(spark)
    made = QUERIES["v4_verify"](spark, DATA)
    for _ in range(50):
        shuffled, tables = (now - then for now, then in zip(_held(spark), held))
        if not shuffled:
            break
        sleep(0.2)
    assert not shuffled
    assert len([t for t in tables if t.startswith("tables-")]) == 1
    assert spark.conf.get(RELEASE, None) == was
    assert made.count() == made.select("doc_id").distinct().count() > 100


def test_released_gives_a_setting_back(spark):
    """also after an error, and whatever it was."""
    was = spark.conf.get(RELEASE, None)
    try:
        spark.conf.set(RELEASE, "false")
        with pytest.raises(ZeroDivisionError), released(spark):
            assert spark.conf.get(RELEASE) == "true"
            1 / 0
        assert spark.conf.get(RELEASE) == "false"
    finally:
        spark.conf.unset(RELEASE) if was is None else spark.conf.set(RELEASE, was)


def test_errors_meet_elements_by_their_prefixes(spark):
    """prefixes of 20 travel in place of whole texts; blanks at the 20th place count, as they did."""
    rng = random.Random(5)
    text = lambda: " " * rng.randrange(3) + "".join(rng.choice("aab  ") for _ in range(rng.choice([0, 2, 3, 5, 19, 20, 21, 22, 40]))) + " " * rng.randrange(2)
    some = [text() for _ in range(60)]
    errors = [(d, i, rng.choice(some)) for d in range(3) for i in range(60)] + [(0, 99, None), (9, 0, "aaaa")]
    elements = [(d, i, rng.choice(some) + rng.choice(["", "", "b", " a"])) for d in range(3) for i in range(80)] + [(0, 99, None)]

    def first(d, x):
        a = (x or "").strip()
        for _, seq, y in (e for e in elements if e[0] == d):
            b = (y or "").strip()
            n = min(20, len(a), len(b))
            if n >= 3 and a[:n] == b[:n]:
                return seq
        return None

    got = M.map_errors(spark.createDataFrame(errors, "doc_id long, err_no long, text string"), spark.createDataFrame(elements, "doc_id long, seq long, content string")).collect()
    want = sorted((d, i, first(d, x)) for d, i, x in errors)
    assert sorted(map(tuple, got)) == want and len({r[2] for r in want}) > 10
