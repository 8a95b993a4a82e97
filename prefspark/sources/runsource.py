"""Run folders ``<root>/<run>/<file>`` as a Spark data source.

Rows are (run, file, content).  The reader lists the run folders' names, cuts
them into ranges and opens the files in the tasks, so a missing file costs one
look-up and an empty file is a row as any other.  The writer puts each row's
file in place from the task that holds it: under a temporary name first, then
by one rename, so a task that runs twice leaves one whole file; the commit
counts the files and marks the folder with ``_SUCCESS``.

Folders are reached through ``pyarrow.fs`` (local and shared paths, ``hdfs:``,
``s3:``, ``gs:``).
"""

from __future__ import annotations

import json
import re
import uuid
import weakref
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "run_folders"
SCHEMA = "run string, file string, content binary"
#: run folders that one task reads, and bytes of a batch it hands on
RUNS_PER_TASK = 512
BATCH_BYTES = 8 << 20
MARK = "_SUCCESS"


def _filesystem(root: str):
    from pyarrow import fs
    if re.match(r"^(file:)?/", root):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", root).rstrip("/")
    system, path = fs.FileSystem.from_uri(root)
    return system, path.rstrip("/")


@dataclass
class RunRange(InputPartition):
    runs: list[str]


class RunFolderReader(DataSourceReader):
    def __init__(self, root: str, files: list[str], per_task: int):
        self.root, self.files, self.per_task = root, files, per_task

    def partitions(self) -> list[RunRange]:
        from pyarrow import fs
        system, path = _filesystem(self.root)
        found = system.get_file_info(fs.FileSelector(path, recursive=False))
        # hidden folders are not runs
        runs = sorted(f.base_name for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith("."))
        return [RunRange(runs[i:i + self.per_task]) for i in range(0, len(runs), self.per_task)] or [RunRange([])]

    def read(self, partition: RunRange) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        system, path = _filesystem(self.root)
        schema = pa.schema([("run", pa.string()), ("file", pa.string()), ("content", pa.binary())])
        rows, size = [], 0
        for run in partition.runs:
            for info in system.get_file_info([f"{path}/{run}/{name}" for name in self.files]):
                if info.type != fs.FileType.File:
                    continue
                with system.open_input_stream(info.path) as f:
                    content = f.read()
                rows.append((run, info.base_name, content))
                size += len(content)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: int


class RunFolderWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator) -> Written:
        system, path = _filesystem(self.root)
        count = 0
        for row in iterator:
            if row.content is None:
                continue
            if not row.run or "/" in row.run or "/" in row.file:
                raise ValueError(f"not a folder or file name: {row.run!r}, {row.file!r}")
            folder = f"{path}/{row.run}"
            system.create_dir(folder, recursive=True)
            part = f"{folder}/.{row.file}.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as f:
                f.write(bytes(row.content))
            system.move(part, f"{folder}/{row.file}")
            count += 1
        return Written(count)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _filesystem(self.root)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{MARK}") as f:
            f.write(json.dumps({"files": sum(m.files for m in messages if m is not None)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files that are in place are whole; without the mark the folder
        counts as unfinished."""


class RunFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RunFolderReader:
        return RunFolderReader(self.options["path"], json.loads(self.options["files"]), int(self.options["runsPerTask"]))

    def writer(self, schema, overwrite: bool) -> RunFolderWriter:
        return RunFolderWriter(self.options["path"])


_registered: weakref.WeakSet[SparkSession] = weakref.WeakSet()


def _register(spark: SparkSession) -> None:
    if spark not in _registered:
        spark.dataSource.register(RunFolders)
        _registered.add(spark)


def read_run_folders(spark: SparkSession, root: str, files: list[str], runs_per_task: int = RUNS_PER_TASK) -> DataFrame:
    """(run, file, content) of the named files that exist."""
    _register(spark)
    return spark.read.format(NAME).option("files", json.dumps(files)).option("runsPerTask", runs_per_task).load(root)


def write_run_folders(docs: DataFrame, root: str, files: dict[str, str], run: str = "run") -> None:
    """Write one file per row of ``docs`` (one row per run) and entry of
    ``files`` (column -> file name); null texts are left out."""
    _register(docs.sparkSession)

    def one(col: str, name: str) -> Column:
        return F.struct(F.lit(name).alias("file"), F.encode(F.col(col), "utf-8").alias("content"))
    rows = docs.select(F.col(run).alias("run"), F.explode(F.array(*[one(c, n) for c, n in files.items()])).alias("f"))
    rows.select("run", "f.file", "f.content").where("content is not null").write.format(NAME).mode("append").save(root)
