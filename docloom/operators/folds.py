"""Ordered folds: many small groups in one pass over sorted partitions, without a frame for each group."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.sources.store import width

#: Rows of an output batch.
ROWS = 10_000


def ordered_fold(df: DataFrame, key: list[str], order: list[str], work: Callable[[list], Iterable[tuple]], schema: str, tasks: int | None = None, rows: int = ROWS) -> DataFrame:
    """work(rows) of each group of equal `key`, its rows as named tuples in `order`; a task holds one group and a batch at a time. One shuffle, by key.

    `tasks` fixes their number, for work that is dear where rows are few: these would be coalesced by size. An output batch has some more than `rows` rows at most.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = [*key, *[c for c in df.columns if c not in key]]
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Row = namedtuple("Row", columns, rename=True)
        out: list[tuple] = []
        held: list = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

        for b in batches:
            for row in map(Row._make, zip(*[c.to_pylist() for c in b.columns])):
                if held and row[:n] != held[0][:n]:
                    out.extend(work(held))
                    held = []
                    if len(out) >= rows:
                        yield batch()
                        out = []
                held.append(row)
        if held:
            out.extend(work(held))
        if out:
            yield batch()

    # Dealt by the key's hash: rows that a join or union already left partitioned by the key itself would not be shuffled, while adaptive execution may
    # read that join's shuffle in pieces, since nothing above asks for it, and so part a group.
    dealt = [F.xxhash64(*key)]
    return df.select(*columns).repartition(*([tasks] if tasks else []), *dealt).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


#: Rows of an input batch that are Python objects at one time.
SLICE = 100


def each_row(df: DataFrame, work: Callable[..., Iterable[Sequence]], schema: str, rows: int = ROWS) -> DataFrame:
    """work(*row) of each row, as rows of `schema`. A task holds an input batch, a slice of it as Python objects, and an output batch of some more than `rows` rows at most."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[Sequence] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                for row in zip(*[c.to_pylist() for c in b.slice(at, SLICE).columns]):
                    out.extend(work(*row))
                    if len(out) >= rows:
                        yield batch()
                        out = []
        if out:
            yield batch()

    return df.mapInArrow(run, schema)


def paired_fold(left: DataFrame, right: DataFrame, key: list[str], orders: tuple[str, str], work: Callable[[tuple, list[tuple], list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """work(key, left rows, right rows) of each group of equal `key` on either side; rows are tuples of a side's other columns in their order, sorted by its order."""
    n, k = len(key), len(left.columns) - len(key)

    def side(df: DataFrame, no: int, mark: str) -> DataFrame:
        own = [c for c in df.columns if c not in key]
        return df.select(*key, F.lit(no).alias("_side"), F.col(orders[no]).alias("_at"), *[F.col(c).alias(f"{mark}{i}") for i, c in enumerate(own)])

    def both(held: list) -> Iterable[tuple]:
        a = [r[n + 2 : n + 2 + k] for r in held if not r[n]]
        return work(tuple(held[0][:n]), a, [r[n + 2 + k :] for r in held[len(a) :]])

    rows = side(left, 0, "a").unionByName(side(right, 1, "b"), allowMissingColumns=True)
    return ordered_fold(rows, key, ["_side", "_at"], both, schema, width(left.sparkSession))
