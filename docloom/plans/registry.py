"""Named queries with their DuckDB SQL, over base tables and derived tables that both engines build from one SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: name -> SQL with {table} for base and derived tables
DERIVED: dict[str, str] = {}
#: name -> (Spark SQL, DuckDB SQL) for the few expressions that the engines spell differently
SPELLED: dict[str, tuple[str, str]] = {}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(x for x in re.findall(r"\{(\w+)\}", sql) if x in BASE or x in DERIVED or x in SPELLED))


def spark_sql(sql: str, sf_dir: str) -> str:
    def told(m: re.Match) -> str:
        name = m[1]
        if name in BASE:
            return f"parquet.`{sf_dir}/{name}.parquet`"
        return f"({spark_sql(DERIVED[name] if name in DERIVED else SPELLED[name][0], sf_dir)})"

    return re.sub(r"\{(\w+)\}", lambda m: told(m) if m[1] in BASE or m[1] in DERIVED or m[1] in SPELLED else m[0], sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(spark_sql(DERIVED[name] if name in DERIVED else SPELLED[name][0], sf_dir))


def duck_sql(sql: str) -> str:
    """The SQL with its derived tables as common table expressions, each once, in order of need."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        if name in parts or name in BASE:
            return
        own = DERIVED[name] if name in DERIVED else SPELLED[name][1]
        for other in _needs(own):
            add(other)
        parts[name] = _plain(own)

    for name in _needs(sql):
        add(name)
    body = _plain(sql)
    # MATERIALIZED: these are read several times, and keep one row order in all uses
    head = ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in parts.items())
    if not head:
        return body
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body.lstrip()[14:]}"
    if body.lstrip().upper().startswith("WITH"):
        return f"WITH {head}, {body.lstrip()[4:]}"
    return f"WITH {head} {body}"


def _plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in BASE or m[1] in DERIVED or m[1] in SPELLED else m[0], sql)


def query(name: str, *tables: str, sql: str | None = None) -> Callable:
    """Registers f(*DataFrames) as a query over these tables, and its SQL."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in tables])
        if sql:
            ORACLES[name] = duck_sql(sql)
        return f

    return register
