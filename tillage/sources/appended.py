"""Logs that grow in place, as a Spark data source whose offsets are byte positions.

    appended.register(spark)
    spark.read.format("appended_log").load("/logs/jobs.jsonl")          # all whole lines now
    spark.readStream.format("appended_log").load("/logs")               # and those that are added

Rows are (value, file, start): a line without its end, the file and the byte at which the line starts, which orders the lines
of a file. Only lines that are finished by a newline are given; a torn tail waits for the batch after its end is written. New bytes
are dealt to tasks in blocks, so a large log is no single task. Offsets are kept by Spark's checkpoint, so after a restart each
line still comes once.

The path is one file or a folder (hidden files left out) that driver and executors reach by pyarrow's file systems: a shared local path or a URI such as
hdfs:// or s3://. Files may only grow: one that shrinks stops the query, and a renamed one is a new file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "value string, file string, start bigint"
BLOCK_BYTES = 32 << 20
#: Bytes that are read at a time.
CHUNK = 1 << 20
#: Lines of a batch that leaves the reader.
LINES = 10_000


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def file_sizes(path: str) -> dict[str, int]:
    """The files of the log and their sizes."""
    fs, root = file_system(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return {info.path: info.size}
    if info.type == pafs.FileType.NotFound:
        return {}
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return {f.path: f.size for f in found if f.type == pafs.FileType.File and not any(p[:1] in "._" for p in f.path[len(root) :].split("/") if p)}


def _end_of_lines(fs: pafs.FileSystem, file: str, size: int, least: int) -> int:
    """The place after the last newline before size, least if there is none after it."""
    with fs.open_input_file(file) as f:
        end = size
        while end > least:
            begin = max(least, end - CHUNK)
            at = f.read_at(end - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return least


@dataclass
class Block(InputPartition):
    """The lines of a file that start in [lo, hi). Lines start at `first` and end before `last`."""

    file: str
    lo: int
    hi: int
    first: int
    last: int


def _blocks(start: dict, end: dict, size: int) -> list[Block]:
    out = []
    for file, last in sorted(end.items()):
        first = start.get(file, 0)
        if last < first:
            raise ValueError(f"{file} is shorter than what was read of it: {last} of {first} bytes")
        out += [Block(file, lo, min(lo + size, last), first, last) for lo in range(first, last, size)]
    return out


def _lines(path: str, block: Block) -> Iterator[tuple[bytes, int]]:
    fs, _ = file_system(path)
    with fs.open_input_file(block.file) as f:
        # One byte back: where the block starts right after a newline, its first line is its own.
        at = block.lo if block.lo == block.first else block.lo - 1
        skip, rest, starts = at < block.lo, b"", at
        while starts < block.hi and at < block.last:
            data = f.read_at(min(CHUNK, block.last - at), at)
            if not data:
                raise ValueError(f"{block.file} ends before byte {block.last}")
            at += len(data)
            *whole, rest = (rest + data).split(b"\n")
            for line in whole:
                if skip:
                    skip = False
                elif starts < block.hi:
                    yield line, starts
                starts += len(line) + 1


class _Read:
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.size = int(options.get("blockbytes", BLOCK_BYTES))

    def ends(self, known: dict[str, int]) -> dict[str, int]:
        fs, _ = file_system(self.path)
        out = dict(known)
        for file, size in file_sizes(self.path).items():
            if size < known.get(file, 0):
                raise ValueError(f"{file} has shrunk to {size} bytes, {known[file]} were read")
            out[file] = _end_of_lines(fs, file, size, known.get(file, 0))
        return out

    def read(self, block: Block | None) -> Iterator[pa.RecordBatch]:
        values, starts = [], []
        if block is None:  # no files: Spark reads one partition of none
            return

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([block.file] * len(values), pa.string()), pa.array(starts, pa.int64())], names=["value", "file", "start"])

        for line, start in _lines(self.path, block):
            values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
            starts.append(start)
            if len(values) == LINES:
                yield made()
                values, starts = [], []
        if values:
            yield made()


class _Batch(_Read, DataSourceReader):
    def partitions(self) -> Sequence[Block]:
        return _blocks({}, self.ends({}), self.size)


class _Stream(_Read, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.ends(self.known)

    def partitions(self, start: dict, end: dict) -> Sequence[Block]:
        self.known = self.known | end
        return _blocks(start, end, self.size)


class AppendedLog(DataSource):
    """Options: path, and blockBytes, the bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "appended_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AppendedLog)
