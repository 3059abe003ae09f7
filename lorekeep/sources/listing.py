"""A data source that lists every file below a folder, whatever its name and size.

Spark's own file sources leave out names that start with ``_`` or ``.`` and empty files. This one lists them too. Folders are
partitions: the driver opens folders level by level until there are enough of them for the tasks, and tasks list what lies
below. Listings are narrow; contents are read afterwards, by tasks that get about equal numbers of bytes and files.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lorekeep.operators.common import materialize

SOURCE = "lorekeep_files"
SCHEMA = "path string, length long, modified long"
#: Folders that the driver opens at most a level beyond, files of a listing batch.
FOLDERS, LISTED = 64, 10_000
#: What a task reads about: bytes and files; bytes of contents in a batch.
TASK_BYTES, TASK_FILES, BATCH_BYTES = 128_000_000, 2000, 32_000_000
#: Seconds that a file must have been left alone before a stream takes it.
SETTLED = 2.0

_ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.int64())])


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what comes before that path in the spelling of scans."""
    path = re.sub("^file:/+", "/", path)
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool, after: int = -(2**62), until: int = 2**62):
        self.path, self.deep, self.after, self.until = path, deep, after, until


def _folders(root: str) -> list[tuple[str, bool]]:
    """Folders that cover everything below ``root`` once: with all that lies below (True), or for their own files only."""
    system, inner, _ = opened(root)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        raise FileNotFoundError(root)
    found, level = [], [inner]
    while level and len(level) < FOLDERS:
        found += [(p, False) for p in level]
        level = [i.path for p in level for i in system.get_file_info(fs.FileSelector(p)) if i.type == fs.FileType.Directory]
    return found + [(p, True) for p in level]


def _listed(root: str, part: _Folder) -> Iterator[pa.RecordBatch]:
    system, _, before = opened(root)
    rows = []
    for info in system.get_file_info(fs.FileSelector(part.path, recursive=part.deep, allow_not_found=True)):
        if info.type == fs.FileType.File and part.after < (info.mtime_ns or 0) <= part.until:
            rows.append((before + info.path, info.size, info.mtime_ns or 0))
    for at in range(0, len(rows), LISTED):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + LISTED]), _ARROW)], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        return [_Folder(*folder) for folder in _folders(self.root)]

    def read(self, partition):
        return _listed(self.root, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are times of modification in nanoseconds; a batch holds the files changed between two of them."""

    def __init__(self, root: str, settled: float):
        self.root, self.settled = root, settled

    def initialOffset(self):
        return {"until": -(2**62)}

    def latestOffset(self):
        return {"until": int((time.time() - self.settled) * 1e9)}

    def partitions(self, start, end):
        return [_Folder(*folder, start["until"], end["until"]) for folder in _folders(self.root)]

    def read(self, partition):
        return _listed(self.root, partition)


class AllFiles(DataSource):
    @classmethod
    def name(cls):
        return SOURCE

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def streamReader(self, schema):
        return _StreamReader(self.options["path"], float(self.options.get("settled", SETTLED)))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modified`` (nanoseconds) of every file below ``path``."""
    spark.dataSource.register(AllFiles)
    return spark.read.format(SOURCE).load(path)


def stream_list(spark: SparkSession, path: str, settled: float = SETTLED) -> DataFrame:
    """The same as a stream: files by time of modification, once they were left alone for ``settled`` seconds.

    A file that is moved in with an older time than the last batch is not seen; a batch run over the folder finds it.
    """
    spark.dataSource.register(AllFiles)
    return spark.readStream.format(SOURCE).option("settled", settled).load(path)


def _contents(batches):
    for batch in batches:
        held, size = [], 0
        for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
            if held and size + length > BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
            system, inner, _ = opened(path)
            with system.open_input_stream(inner) as stream:
                content = stream.read()
            held.append((path, content, len(content)))
            size += len(content)
        if held:
            yield _batch(held)


def _batch(rows) -> pa.RecordBatch:
    path, content, length = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(content, pa.binary()), pa.array(length, pa.int64())], ["path", "content", "length"])


def with_contents(listed: DataFrame) -> DataFrame:
    """``path, content, length`` of listed files; only paths are dealt, contents stay in the task that reads them."""
    totals = listed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    tasks = 1 + totals["n"] // TASK_FILES + totals["bytes"] // TASK_BYTES
    dealt = listed.select("path", "length").repartition(tasks, F.xxhash64("path"))
    return dealt.mapInArrow(_contents, "path string, content binary, length long")


def read_all_files(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """``path, content, length`` of every file below ``path``. The listing is written once, so that all uses agree."""
    return with_contents(materialize(list_files(spark, path), fallback))
