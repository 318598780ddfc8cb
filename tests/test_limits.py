"""Results beyond small numbers: letters after Z, publications in entries, look-ups without texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import codes
from docloom.llm import linedup
from docloom.operators import assemble as A


def test_variants_after_z_are_characters_in_turn(spark):
    n = spark.range(2000).select("id", codes.letters(F.col("id")).alias("v"))
    got = n.select("id", codes.letters_number("v").alias("n"), codes.character(codes.letters_number("v")).alias("c")).collect()
    assert all(r.n == r.id and r.c == chr(65 + r.id) for r in got)


def test_publication_is_made_of_its_entries(spark):
    refs = spark.createDataFrame([(i, "028", f"{i % 3:02}", f"{i % 2:02}", "040", f"DMC-{i}", "a", "b", None) for i in range(12)], "pos long, system_code string, sub_key string, assy string, info_code string, dmc string, tech_name string, info_name string, tag string")
    rows = sorted(map(tuple, A.publication_entries(refs).collect()))
    assert A.publication(refs).first().xml == "<pm><content>" + "".join(r[-1] for r in rows) + "</content></pm>" and len(rows) == 6


def test_look_ups_move_no_lines(spark, monkeypatch):
    """Rows of shared keys carry their lines only after those of other keys are gone; each line is read once more."""
    seen, plain = [], linedup.checkpointed
    monkeypatch.setattr(linedup, "checkpointed", lambda df: seen.append(df.columns) or plain(df))
    df = spark.createDataFrame([(1, "a line that is long enough"), (2, "a line that is lung enough"), (3, "nothing like the others at all")], "id long, line string")
    rows, texts = linedup.keyed_rows(df, 2)
    assert {r.id for r in texts.collect()} == {1, 2} == {r.id for r in rows.collect()}
    assert seen[0] == ["key", "pos", "id"]
