"""The data source of named text files: names, splits, failures and commits."""

import os
from pathlib import Path

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from docloom.sources import files

ROWS = "file string, content string"


def made(spark, rows):
    return spark.createDataFrame(rows, ROWS).repartition(5)


def test_round_trip_in_any_split(spark, tmp_path):
    rows = [(f"DMC-S5-{i}_ru-RU.xml", "ы\r\n<a>\x00" * (i % 7)) for i in range(150)] + [("пустой.xml", None), ("a b%20c.gz", "x" * 300_000)]
    path = str(tmp_path / "out")
    files.write(made(spark, rows), path)
    assert sorted(os.listdir(path)) == sorted(n for n, _ in rows)
    want = sorted((n, t or "") for n, t in rows)
    for split in (1, 500, 1 << 30):
        assert sorted(map(tuple, files.read(spark, path, split).collect())) == want
    assert files.read(spark, path, 1).rdd.getNumPartitions() == len(rows)
    assert sorted(map(tuple, files.read(spark, "file:" + path).collect())) == want


def test_hidden_and_broken_files(spark, tmp_path):
    (tmp_path / "_x").write_text("h")
    (tmp_path / ".x").write_text("h")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "y").write_text("h")
    assert files.read(spark, str(tmp_path)).count() == 0
    (tmp_path / "b").write_bytes(b"\xff\xfe")
    assert [tuple(r) for r in files.read(spark, str(tmp_path)).collect()] == [("b", None)]


@pytest.mark.parametrize("bad", [None, "", "a/b", "../up", "_x", ".x", "f1"])
def test_a_failed_task_leaves_nothing(spark, tmp_path, bad):
    path = tmp_path / "out"
    with pytest.raises(Exception, match="no name for a file|two files are named"):
        files.write(made(spark, [("f1", "1"), ("f2", "2"), ("f3", "3"), (bad, "x")]), str(path))
    assert not path.exists() or os.listdir(path) == []
    assert os.listdir(tmp_path) in ([], ["out"])


def test_lost_rows_leave_nothing(spark, tmp_path):
    path = tmp_path / "out"
    rows = spark.range(200).select(F.concat(F.lit("f"), "id").alias("file"), F.when(F.col("id") == 150, F.raise_error(F.lit("lost"))).otherwise("t").alias("content"))
    with pytest.raises(Exception, match="lost"):
        files.write(rows, str(path))
    assert not path.exists() or os.listdir(path) == []


def test_existing_files(spark, tmp_path):
    path = str(tmp_path / "out")
    files.write(made(spark, [("a", "1"), ("b", "1")]), path)
    with pytest.raises(Exception, match="exist"):
        files.write(made(spark, [("b", "2"), ("c", "2")]), path)
    assert sorted(map(tuple, files.read(spark, path).collect())) == [("a", "1"), ("b", "1")]
    files.write(made(spark, [("b", "2"), ("c", "2")]), path, overwrite=True)
    assert sorted(map(tuple, files.read(spark, path).collect())) == [("a", "1"), ("b", "2"), ("c", "2")]
    files.write(made(spark, []), path)
    assert sorted(os.listdir(path)) == ["a", "b", "c"]


def test_spread_files(spark, tmp_path):
    rows = [(f"d-{i}.xml", "ы\r\n" * (i % 7) if i % 5 else None) for i in range(3000)]
    path = tmp_path / "out"
    files.write(made(spark, rows), str(path), spread=True)
    folders = sorted(path.iterdir())
    assert all(files.PART.fullmatch(p.name) for p in folders) and len(folders) < 200
    assert sorted(p.name for f in folders for p in f.iterdir()) == sorted(n for n, _ in rows)
    assert sorted(map(tuple, files.read(spark, str(path), spread=True).collect())) == sorted((n, t or "") for n, t in rows)
    with pytest.raises(Exception, match="exist"):
        files.write(made(spark, [("other", "1")]), str(path), spread=True)
    with pytest.raises(Exception, match="do not replace"):
        files.write(made(spark, [("other", "1")]), str(path), overwrite=True, spread=True)
    assert sorted(path.iterdir()) == folders
    files.write(made(spark, []), str(tmp_path / "none"), spread=True)
    assert files.read(spark, str(tmp_path / "none"), spread=True).count() == 0


@pytest.mark.parametrize("bad", [None, "a/b", "_x", "f1"])
def test_a_failed_spread_task_leaves_nothing(spark, tmp_path, bad):
    with pytest.raises(Exception, match="no name for a file|two files are named"):
        files.write(made(spark, [("f1", "1"), ("f2", "2"), (bad, "x")]), str(tmp_path / "out"), spread=True)
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []


def test_a_spread_commit_moves_and_lists_folders_only(tmp_path, monkeypatch):
    """The driver's part must not grow with the files."""
    writer = files.Writer(str(tmp_path), False, spread=True)
    staged = []
    for task in range(2):
        own = tmp_path / writer.staging / f"{task}-{task}"
        for k in range(3):
            (own / str(k)).mkdir(parents=True)
            for i in range(50):
                (own / str(k) / f"{task}-{k}-{i}").write_text("x")
        staged.append(files.Staged(str(own), 150, task, 3))
    seen = []

    class Counted:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            def call(*args):
                out = getattr(self.system, name)(*args)
                seen.extend(out if name == "get_file_info" and isinstance(out, list) else [name])
                return out

            return call

    monkeypatch.setattr(files, "opened", lambda path: (Counted(fs.LocalFileSystem()), path))
    writer.commit(staged)
    assert len(files.Reader(str(tmp_path), files.SPLIT, spread=True).partitions()) == 6
    assert len(seen) < 30
    assert len([p for p in Path(tmp_path).rglob("*") if p.is_file()]) == 300
