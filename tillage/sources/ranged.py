"""Files of any size as ranges of bytes, dealt to tasks.

Spark's own binary source holds a file in one row, so a file of some gigabytes is out of its reach. Here a row is a range: its place, its
SHA-256 and, if asked, its bytes. A task reads a range in small pieces and holds one piece. Small files share a task.

    ranged.register(spark)
    spark.read.format("ranged_files").option("rangeBytes", 64 << 20).load("/bundle")

A file's ranges make a tree of digests (`roots`), which can be checked range by range, so a damaged one is found without reading the rest
again. A plain SHA-256 of a whole file can't be split: `whole_digests` streams each file through one task. `heads` reads the first bytes only. Paths are those
of `sources.appended`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tillage.sources.appended import file_sizes, file_system

SCHEMA = "path string, size bigint, start bigint, length bigint, sha256 string, content binary"
RANGE_BYTES = 64 << 20
#: Bytes that are read at a time, and ranges of a node of the tree.
PIECE = 1 << 20
FAN = 1024


@dataclass
class Ranges(InputPartition):
    """(file, its size, start, length) of some ranges."""

    items: list[tuple[str, int, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.size = int(options.get("rangebytes", RANGE_BYTES))
        self.most = int(options["firstbytes"]) if "firstbytes" in options else None
        self.content = options.get("content", "false").lower() == "true"
        self.digest = options.get("digest", "true").lower() == "true"
        self.whole = options.get("whole", "false").lower() == "true"

    def partitions(self) -> Sequence[Ranges]:
        out, held, full = [], [], 0
        for file, size in sorted(file_sizes(self.path).items()):
            end = size if self.most is None else min(size, self.most)
            step = max(1, end) if self.whole else self.size
            for start in range(0, max(1, end), step):  # an empty file is one empty range
                length = min(step, end - start)
                if held and full + length > self.size:
                    out.append(Ranges(held))
                    held, full = [], 0
                held.append((file, size, start, length))
                full += length
        return [*out, Ranges(held)] if held else out

    def read(self, partition: Ranges | None) -> Iterator[tuple]:
        fs, _ = file_system(self.path)
        for file, size, start, length in partition.items if partition else ():  # no files: Spark reads one partition of none
            digest, parts = hashlib.sha256(), []
            with fs.open_input_file(file) as f:
                at = start
                while at < start + length:
                    piece = f.read_at(min(PIECE, start + length - at), at)
                    if not piece:
                        raise ValueError(f"{file} ends before byte {start + length}")
                    at += len(piece)
                    if self.digest:
                        digest.update(piece)
                    if self.content:
                        parts.append(piece)
            content = b"".join(parts) if self.content else None
            yield file, size, start, length, digest.hexdigest() if self.digest else None, content


class RangedFiles(DataSource):
    """Options: path, rangeBytes, firstBytes (no more of a file), content (give the bytes), digest (false: no SHA-256), whole (a file is one range)."""

    @classmethod
    def name(cls) -> str:
        return "ranged_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RangedFiles)


def _load(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark)
    reader = spark.read.format("ranged_files")
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load(path)


def chunk_digests(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, size, start, length, sha256) of each range of the files at path, each read once."""
    return _load(spark, path, rangeBytes=range_bytes).drop("content")


def whole_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file as a whole, read in one task."""
    rows = _load(spark, path, whole="true")
    return rows.select("path", F.col("size").alias("bytes"), "sha256")


def heads(spark: SparkSession, path: str, n: int = 16) -> DataFrame:
    """(path, bytes, head): the size and the first n bytes of each file, of which no more is read."""
    rows = _load(spark, path, firstBytes=n, rangeBytes=1 << 20, content="true", digest="false", whole="true")
    return rows.select("path", F.col("size").alias("bytes"), F.col("content").alias("head"))


def checked_heads(found: DataFrame, magic: bytes, least: int = 0) -> DataFrame:
    """heads' rows with status: `small` if a file has fewer than `least` bytes, `kind` if it doesn't begin with magic, else `ok`."""
    small = F.col("bytes") < max(least, len(magic))
    right = F.substring("head", 1, len(magic)) == F.lit(magic)
    return found.withColumn("status", F.when(small, "small").when(~right, "kind").otherwise("ok"))


def roots(chunks: DataFrame, fan: int = FAN) -> DataFrame:
    """(path, bytes, chunks, root) of each file: the digests of `fan` ranges in order, put together, make one of the level above, up to one.

    A file of one range has that range's digest. No group has more than fan rows, whatever the size of a file.
    """
    sizes = chunks.groupBy("path").agg(F.first("size").alias("bytes"), F.count("*").alias("chunks"), F.max("length").alias("_step"))
    level = chunks.join(sizes.select("path", "_step"), "path").select("path", F.when(F.col("_step") > 0, F.floor(F.col("start") / F.col("_step"))).otherwise(0).cast("bigint").alias("i"), "sha256")
    most = sizes.agg(F.max("chunks")).first()[0] or 0
    while most > 1:
        node = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sha256"))), lambda x: x["sha256"]), "")
        up = level.groupBy("path", F.floor(F.col("i") / fan).cast("bigint").alias("i")).agg(node.alias("all"), F.count("*").alias("n"), F.first("sha256").alias("only"))
        # A file that is down to one node is done.
        level = up.withColumn("alone", F.count("*").over(Window.partitionBy("path"))).select("path", "i", F.when((F.col("n") == 1) & (F.col("alone") == 1), F.col("only")).otherwise(F.sha2("all", 256)).alias("sha256"))
        most = -(-most // fan)
    return sizes.drop("_step").join(level.select("path", F.col("sha256").alias("root")), "path")


def verify_chunks(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, start, length, status) of each range of a manifest, both as chunk_digests: `ok`, `corrupt`, `missing` (the file isn't there) or `size`
    (the file has another size), and `extra` for ranges of files that the manifest doesn't have."""
    m = manifest.select("path", "start", "length", F.col("size").alias("_size"), F.col("sha256").alias("_want"))
    f = found.select("path", "start", F.col("size").alias("_is"), F.col("length").alias("_l"), F.col("sha256").alias("_have"))
    there = found.select("path", F.col("size").alias("_file")).distinct()
    known = manifest.select("path").distinct().withColumn("_known", F.lit(True))
    both = m.join(f, ["path", "start"], "full").join(there, "path", "left").join(known, "path", "left")
    status = (
        F.when(F.col("_want").isNull(), F.when(F.col("_known"), "size").otherwise("extra"))
        .when(F.col("_file").isNull(), "missing")
        .when(F.col("_file") != F.col("_size"), "size")
        .when(F.col("_want") == F.col("_have"), "ok")
        .otherwise("corrupt")
    )
    return both.select("path", "start", F.coalesce("length", "_l").alias("length"), status.alias("status"))
