"""Classification by a pluggable function, with prompt, answer parsing and fallback order."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import col

TYPES = {"HEADER": "header", "LIST_ITEM": "list_item", "PARAGRAPH": "paragraph", "TABLE_INTRO": "table_intro"}


def prompt(text: Column | str, previous: Column | str, style: Column | str) -> Column:
    """F26."""
    return F.format_string("Классифицируйте элемент документа.\nСтиль: %s\nПредыдущий элемент: %s\nТекст: %s", col(style), col(previous), col(text))


def parse_answer(answer: Column | str) -> Column:
    """the outermost braces of an answer as (type, confidence, reasoning, list_level); unknown types are paragraphs, confidence 0.5 by default; null without JSON."""
    found = F.from_json(F.regexp_extract(col(answer), r"(?s)(\{.*\})", 1), "type string, confidence double, reasoning string, list_level int")
    table = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    kind = F.coalesce(F.try_element_at(table, F.upper(F.coalesce(found["type"], F.lit("PARAGRAPH")))), F.lit("paragraph"))
    valid = F.coalesce(found["type"].isNotNull() | found["confidence"].isNotNull() | found["reasoning"].isNotNull(), F.lit(False))
    return F.when(valid, F.struct(kind.alias("type"), F.coalesce(found["confidence"], F.lit(0.5)).alias("confidence"), F.coalesce(found["reasoning"], F.lit("")).alias("reasoning"), found["list_level"].alias("list_level")))


def cache_key(text: Column | str, previous: Column | str, ending: Column | str, style: Column | str) -> Column:
    """MD5 of the key-sorted JSON of a question, as a compact text of its own."""
    return F.md5(F.to_json(F.struct(col(ending).alias("prev_ending"), col(previous).alias("prev_type"), col(style).alias("style"), col(text).alias("text"))))


def remember(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache (key, type, confidence) with new answers (key, type, confidence) in place of old ones; of several answers to one key the surest, then the first type."""
    best = answers.groupBy("key").agg(F.min_by(F.struct("type", "confidence"), F.struct((-F.col("confidence")).alias("c"), F.col("type").alias("t"))).alias("_b")).select("key", "_b.type", "_b.confidence")
    return cache.select("key", "type", "confidence").join(best.select("key"), "key", "left_anti").unionByName(best)


def stats(cache: DataFrame, enabled: bool = False, available: bool = False, least: float = 0.7) -> DataFrame:
    """One row: whether the service is used and answers, the size of the cache, and the confidence asked for."""
    return cache.agg(F.lit(enabled).alias("llm_enabled"), F.lit(enabled and available).alias("llm_available"), F.count("*").alias("cache_size"), F.lit(least).alias("confidence_threshold"))


def classify(rows: DataFrame, ask: Callable[[pd.Series], pd.Series] | None = None, heuristic: Column | None = None, cache: DataFrame | None = None, least: float = 0.7) -> DataFrame:
    """Adds vote (type, confidence, source): the cache's answer, else ask(prompts) of at least `least`, else the heuristic at 0.6, else paragraph at 0.3.

    Without `ask`, the default, no outside service is called. ask works on batches of prompts and may return null.
    """
    df = rows.withColumn("_k", cache_key("text", "previous", F.right("previous", F.lit(1)), "style"))

    def vote(kind: Column, confidence: Column, source: str) -> Column:
        return F.struct(kind.alias("type"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source"))

    steps = []
    if cache is not None:
        df = df.join(cache.select(F.col("key").alias("_k"), F.col("type").alias("_t"), F.col("confidence").alias("_c")), "_k", "left")
        steps.append(F.when(F.col("_t").isNotNull(), vote(F.col("_t"), F.col("_c"), "cache")))
    if ask is not None:
        answer = parse_answer(F.pandas_udf(ask, "string")(prompt("text", "previous", "style")))
        df = df.select("*", F.explode(F.array(answer)).alias("_a"))
        steps.append(F.when(F.col("_a.confidence") >= least, vote(F.col("_a.type"), F.col("_a.confidence"), "model")))
    if heuristic is not None:
        steps.append(F.when(heuristic.isNotNull(), vote(heuristic, F.lit(0.6), "heuristic")))
    steps.append(vote(F.lit("paragraph"), F.lit(0.3), "default"))
    return df.withColumn("vote", F.coalesce(*steps)).drop("_k", "_t", "_c", "_a")
