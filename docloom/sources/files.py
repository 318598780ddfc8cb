"""Folders of named text files as a Python data source (S21, K1, K2, K6): partitioned readers, and a writer whose files appear under their exact names once all tasks have ended.

Many files are spread over folders of a bounded number of files and bytes (option spread): one of them is moved, listed and read as a whole, so the driver handles folders only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT, SCHEMA = "docloom_files", "file string, content string"
#: Bytes of files that one task reads, bytes that opening a file counts as, and files of a batch.
SPLIT, OPENING, BATCH = 32 << 20, 64 << 10, 64
#: Threads of the driver that rename files or folders.
MOVERS = 16
#: Folders that a spread write makes.
PART = re.compile(r"part-\d+-\d+")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it. Stores that only Spark reads are not reached; spark.read.format("binaryFile") reads those."""
    system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return system, inner.rstrip("/")


def hidden(name: str) -> bool:
    return name.startswith(("_", "."))


@dataclass
class Names(InputPartition):
    names: list[str]


@dataclass
class Part(InputPartition):
    folder: str


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int
    task: int
    parts: int


class Reader(DataSourceReader):
    """Files of a folder, not of its subfolders, cut by bytes; bytes that are no UTF-8 give null, hidden names are passed over.

    Spread files are read by their folders, each listed by the task that reads it.
    """

    def __init__(self, path: str, split: int, spread: bool) -> None:
        self.path, self.split, self.spread = path, split, spread

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.path)
        if self.spread:
            found = [f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and PART.fullmatch(f.base_name)]
            return [Part(n) for n in found] or [Names([])]
        out, size = [Names([])], 0
        for f in system.get_file_info(fs.FileSelector(root)):
            if f.type != fs.FileType.File or hidden(f.base_name):
                continue
            if out[-1].names and size + f.size + OPENING > self.split:
                out.append(Names([]))
                size = 0
            out[-1].names.append(f.base_name)
            size += f.size + OPENING
        return out

    def read(self, part: Names | Part) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.path)
        if isinstance(part, Part):
            root = f"{root}/{part.folder}"
            part = Names([f.base_name for f in system.get_file_info(fs.FileSelector(root))])
        for i in range(0, len(part.names), BATCH):
            names = part.names[i : i + BATCH]
            texts = []
            for n in names:
                with system.open_input_stream(f"{root}/{n}", compression=None) as f:
                    try:
                        texts.append(f.read().decode("utf-8"))
                    except UnicodeDecodeError:
                        texts.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["file", "content"])


class Writer(DataSourceArrowWriter):
    """Each attempt of a task fills a folder of its own beside the target; the commit moves the files of the attempts that count, an abort deletes all.

    Names are checked before anything moves: an empty or hidden name, one with a slash, and one that a task meets twice are errors of the task; one that exists is an
    error of the commit unless the mode is overwrite, which replaces files of equal name and leaves others, since several runs fill a folder.
    A spread write cuts an attempt's files into folders, by bytes as the reader does, and its commit moves these; it fills a folder once, so anything there is an error.
    """

    def __init__(self, path: str, overwrite: bool, spread: bool) -> None:
        if overwrite and spread:
            raise ValueError("spread files do not replace others")
        self.path, self.overwrite, self.spread, self.staging = path, overwrite, spread, f"_staging-{uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        system, root = opened(self.path)
        task = TaskContext.get()
        own = folder = f"{root}/{self.staging}/{task.partitionId()}-{task.taskAttemptId()}"
        system.create_dir(own)
        n, parts, size, last = 0, 0, 0, None
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                for name, text in zip(*[c.to_pylist() for c in b.slice(at, BATCH).columns]):
                    if not name or "/" in name or hidden(name):
                        raise ValueError(f"no name for a file: {name!r}")
                    if name == last:
                        raise ValueError(f"two files are named {name}")
                    data = (text or "").encode("utf-8")
                    size += len(data) + OPENING
                    if self.spread and (not parts or size > SPLIT):
                        folder, size = f"{own}/{parts}", len(data) + OPENING
                        system.create_dir(folder)
                        parts += 1
                    with system.open_output_stream(f"{folder}/{name}", compression=None) as f:
                        f.write(data)
                    n, last = n + 1, name
        return Staged(own, n, task.partitionId(), parts)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = opened(self.path)
        made = [m for m in messages if m and m.files]
        target = lambda p: f"{root}/{p.rsplit('/', 1)[-1]}"

        def moves() -> Iterator[list[tuple[str, str]]]:
            for m in made:
                if self.spread:
                    yield [(f"{m.folder}/{k}", f"{root}/part-{m.task}-{k}") for k in range(m.parts)]
                else:
                    yield [(f.path, target(f.path)) for f in system.get_file_info(fs.FileSelector(m.folder))]

        if self.spread:
            found = [f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if not hidden(f.base_name)]
            if found:
                raise FileExistsError(f"{found[0]} and {len(found) - 1} more exist")
        elif not self.overwrite:
            for pairs in moves():
                found = [i.path for i in system.get_file_info([b for _, b in pairs]) if i.type != fs.FileType.NotFound]
                if found:
                    raise FileExistsError(f"{found[0]} and {len(found) - 1} more exist")
        with ThreadPoolExecutor(MOVERS) as pool:
            for pairs in moves():
                list(pool.map(lambda p: system.move(*p), pairs))
        self._clear(system, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        staging = f"{root}/{self.staging}"
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class Files(DataSource):
    """Option path: the folder; option split: bytes a task reads; option spread: whether files are spread over folders."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Reader:
        return Reader(self.options["path"], int(self.options.get("split", SPLIT)), self._spread())

    def writer(self, schema: object, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite, self._spread())

    def _spread(self) -> bool:
        return self.options.get("spread", "false") == "true"


def read(spark: SparkSession, path: str, split: int = SPLIT, spread: bool = False) -> DataFrame:
    """(file, content) of the files in a folder, or of files that write() spread."""
    spark.dataSource.register(Files)
    return spark.read.format(FORMAT).option("split", split).option("spread", spread).load(path)


def write(files: DataFrame, path: str, overwrite: bool = False, spread: bool = False) -> None:
    """Rows (file, content) as files; a null content is an empty file. Rows meet by name, so equal names are found, and nothing is written then.

    A flat folder costs the driver a move a file. Spread files cost it one a folder of some 500, which a store must be able to rename.
    """
    files.sparkSession.dataSource.register(Files)
    rows = files.select(F.col("file").cast("string"), F.col("content").cast("string")).repartition("file").sortWithinPartitions("file")
    rows.write.format(FORMAT).option("spread", spread).mode("overwrite" if overwrite else "append").save(path)
