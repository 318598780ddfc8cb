"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

DOCUMENTS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def pick(df: DataFrame, *names: str, types: dict[str, str] = DOCUMENTS) -> DataFrame:
    """Only the named columns, in this order and with their declared types.

    A name is found as the session finds it, by case or not, an exact one first; a missing or an ambiguous one is an error. Any
    other column of the input, whatever its name, cannot clash with an operator's own columns afterwards.
    """
    cased = str(df.sparkSession.conf.get("spark.sql.caseSensitive")).lower() == "true"

    def place(name: str) -> int:
        found = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if not cased and c.lower() == name.lower()]
        if len(found) != 1:
            raise ValueError(f"column {name}: {'none' if not found else 'more than one'} among {df.columns}")
        return found[0]

    at = {n: place(n) for n in names}
    # Columns by place, since two names that differ in case only cannot be told apart by name.
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{at[n]}").cast(types[n]).alias(n) for n in names])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of a batch between the JVM and Python.
ROWS = 1000
#: Memory of a broadcast table at most, and what a row of it takes beside 16 bytes a column: 31 MB were measured for 256,410 rows of four numbers.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64


def small_batches(df: DataFrame) -> DataFrame:
    """df, once its session hands Python at most ROWS rows a batch: the default of ten thousand texts takes much memory on both sides.

    A smaller setting of the session stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ROWS:
        conf.set(key, str(ROWS))
    return df


def map_rows(df: DataFrame, start: Callable[[], Callable[..., list]], schema: str) -> DataFrame:
    """Narrow Arrow map. start() runs once a task and returns a function from the input's columns (lists) to output columns (lists or Arrow arrays).

    Batches are cut to ROWS rows, so a task holds the Python objects of few rows at a time.
    """
    target = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    out = work(*[c.to_pylist() for c in whole.slice(at, ROWS).columns])
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(out, target)], schema=target)
        finally:
            del work
            released()

    return small_batches(df).mapInArrow(run, schema)


def released() -> None:
    """Hands freed memory back to the system: an idle worker is kept, and would hold what its last task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def to_arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Unset, a folder of our own serves a local session; on a cluster it is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        told = sc.getConf().get("spark.checkpoint.dir")
        if not told and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table can be broadcast: its rows are counted, and its strings and arrays measured, against `most` bytes in memory."""
    width = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) if t in ("string", "binary") else F.coalesce(F.sum(8 * F.size(c)), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary") or t.startswith("array")]
    rows, *more = df.agg(F.count("*"), *width).first()
    return rows * (ROW_BYTES + 16 * len(df.columns)) + sum(more) <= most


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, marked for broadcast if it is small()."""
    return F.broadcast(df) if small(df, most) else df


def unit_hash(*parts: Column | str) -> Column:
    """Uniform in [0, 1) from MD5 of the parts joined by '|' (null parts count as '~'); the same in any engine."""
    text = F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def scratch(spark: SparkSession) -> str:
    """A new folder for tables between steps, under the shared folder."""
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that scratch() gave, through the file system that holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(docs: DataFrame, gone: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of documents whose (doc_id, hash of text) is not among gone (doc_id, th).

    Up to `most` bytes of these keys are broadcast, so that no text moves; beyond, the anti join shuffles.
    """
    gone = checkpointed(gone.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).distinct())
    rows = pick(docs, *DOCUMENTS).withColumn("_own", F.coalesce(F.xxhash64("text"), F.lit(0)))
    same = (F.col("_own") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    return rows.join(maybe_broadcast(gone, most), same, "left_anti").drop("_own")


def text_hash() -> Column:
    """With doc_id, what tells rows apart that share a doc_id."""
    return F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th")


def numbered_copies(rows: DataFrame, *key: str, block: int = 64) -> DataFrame:
    """rows with a column `copy`: rows equal in `key`, and so in all, are numbered from 0 in a block of copies each.

    Rows that occur once pass without a shuffle. Repeated ones meet by key, once for all copies, and are dealt out again by blocks of
    `block` copies, so that no task emits them all.
    """
    counts = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.count("*").alias("_copies")).where("_copies > 1")
    counts = checkpointed(counts)
    if counts.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("bigint"))
    counts = maybe_broadcast(counts)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    alone = rows.join(counts, same, "left_anti").withColumn("copy", F.lit(0).cast("bigint"))
    several = rows.join(counts, same).drop(*[f"_k{i}" for i in range(len(key))])
    rest = [c for c in rows.columns if c not in key]
    one = several.groupBy(*key).agg(*[F.first(c).alias(c) for c in rest], F.first("_copies").alias("_copies")).select(*rows.columns, "_copies")
    one = one.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1, F.lit(block).cast("bigint"))))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = one.repartition(tasks, *key, "_from")
    last = F.least(F.col("_from") + block, F.col("_copies")) - 1
    return alone.unionByName(one.withColumn("copy", F.explode(F.sequence("_from", last))).drop("_from", "_copies"))


def in_order(rows: DataFrame, *order: Column, number: str = "place", weight: str | None = None) -> DataFrame:
    """rows with a place in a global order, from 1, and with `weight` the sum of it over all rows before (column `before`).

    The rows are sorted into ranges, stored, and numbered in each; only the ranges' counts and sums meet in one task. So no task holds
    more than a range, however many rows there are.
    """
    kept = checkpointed(rows.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    total = F.sum(weight) if weight else F.lit(0)
    ranges = kept.groupBy("_range").agg(F.count("*").alias("_n"), total.alias("_w"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"), F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_sum"))
    own = Window.partitionBy("_range").orderBy(*order)
    kept = kept.withColumn(number, F.row_number().over(own))
    if weight:
        kept = kept.withColumn("_own", F.coalesce(F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = kept.join(F.broadcast(ranges), F.col("_range") == F.col("_of")).withColumn(number, (F.col(number) + F.col("_first")).cast("bigint"))
    if weight:
        out = out.withColumn("before", F.col("_own") + F.col("_sum")).drop("_own")
    return out.drop("_range", "_of", "_first", "_sum")
