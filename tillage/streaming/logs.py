"""The work log as a stream: each micro-batch folds into a table of the latest record of each key.

The table is a set of runs, each holding the last record of each key of some consecutive batches. Batch n (from 1) writes one run,
which takes in the runs of the FAN^k batches up to it for the largest FAN^k that divides n. So which runs make up a version
follows from its number alone, a version has fewer than FAN runs for each power, and a record is written once for each power. A run counts once
Spark has finished it (_SUCCESS), so a reader sees a version whole or not at all, and keeps it while newer ones are made: what a run has
taken in is removed KEEP versions later.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tillage.operators.state import latest_per_key
from tillage.sources import appended

FAN = 8
KEEP = 8
SEQ = "struct<file:string,start:bigint>"


def runs_of(n: int, fan: int = FAN) -> list[tuple[int, int]]:
    """The runs (first and last batch, from 1) of version n: n written in powers of fan."""
    out, at, power = [], 0, 1
    while power * fan <= n:
        power *= fan
    while power:
        for _ in range((n - at) // power):
            out.append((at + 1, at + power))
            at += power
        power //= fan
    return out


def _folders(spark: SparkSession, target: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, ([s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else [])


def _finished(spark: SparkSession, target: str) -> set[tuple[int, int]]:
    """The finished runs under target. Their number is bounded, so the driver can list them."""
    fs, folders = _folders(spark, target)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = ((re.fullmatch(r"run=(\d+)-(\d+)", f.getName()), f) for f in folders)
    return {(int(m[1]), int(m[2])) for m, f in found if m and fs.exists(path(f, "_SUCCESS"))}


def versions(spark: SparkSession, target: str, fan: int = FAN) -> list[int]:
    """The versions that can be read, in order."""
    done = _finished(spark, target)
    return sorted(n for n in {last for _, last in done} if done.issuperset(runs_of(n, fan)))


def latest_table(spark: SparkSession, target: str, schema: StructType, key: str, seq: str, version: int | None = None, fan: int = FAN) -> DataFrame:
    """The latest record of each key in a version, the newest if none is named; empty before the first."""
    if version is None:
        version = max(versions(spark, target, fan), default=0)
    if not version:
        return spark.createDataFrame([], schema)
    runs = runs_of(version, fan)
    rows = spark.read.schema(schema).parquet(*[f"{target}/run={a}-{b}" for a, b in runs])
    return rows if len(runs) == 1 else latest_per_key(rows, key, seq)


def _fold(spark: SparkSession, target: str, schema: StructType, key: str, seq: str, fan: int, keep: int):
    def fold(rows: DataFrame, batch: int) -> None:
        n = batch + 1
        (first, _), before = runs_of(n, fan)[-1], runs_of(n - 1, fan)
        taken = [r for r in before if r[0] >= first]
        if taken:
            rows = rows.unionByName(spark.read.schema(schema).parquet(*[f"{target}/run={a}-{b}" for a, b in taken]))
        latest_per_key(rows.select(*schema.names), key, seq).write.mode("overwrite").parquet(f"{target}/run={first}-{n}")
        # A batch may run again, and readers may hold the versions before: only what no kept version has goes.
        live = {r for v in range(max(0, n - keep), n + 1) for r in runs_of(v, fan)}
        fs, folders = _folders(spark, target)
        for f in folders:
            m = re.fullmatch(r"run=(\d+)-(\d+)", f.getName())
            if m and (int(m[1]), int(m[2])) not in live and int(m[2]) <= n:
                fs.delete(f, True)

    return fold


def follow_latest(
    spark: SparkSession, source: str, schema: StructType, key: str, seq: str, target: str, checkpoint: str, fan: int = FAN, keep: int = KEEP
) -> StreamingQuery:
    """Take in the JSON-lines files that are new in source, and keep the latest record of each key by seq under target (see latest_table).

    Rows without a key are left out. A target belongs to one checkpoint. A batch that runs again after a failure reads the runs of earlier batches only
    and gives the same. Run it as often as there is news; it stops when all is taken in.
    """
    lines = spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(source)
    return lines.writeStream.foreachBatch(_fold(spark, target, schema, key, seq, fan, keep)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_schema(schema: str) -> StructType:
    """schema with seq, a record's file and the byte at which its line starts."""
    return StructType.fromDDL(f"{schema}, seq {SEQ}")


def parsed_lines(lines: DataFrame, schema: str, key: str) -> DataFrame:
    """Rows of schema and seq from rows of an appended log; blank, malformed and keyless lines are left out."""
    rows = lines.filter(F.trim("value") != "").withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    return rows.filter(F.col(f"r.{key}").isNotNull()).select("r.*", F.struct("file", "start").alias("seq"))


def follow_appended(
    spark: SparkSession, source: str, schema: str, key: str, target: str, checkpoint: str, block_bytes: int | None = None, fan: int = FAN, keep: int = KEEP
) -> StreamingQuery:
    """Take in the lines that were added to a log since the last run, and keep the latest record of each key under target.

    The log is a file that is appended to, or a folder of them; see `sources.appended` for torn tails and offsets. Later lines win; of several
    files the one whose name is greater. Read the table with latest_table(spark, target, log_schema(schema), key, "seq").
    """
    appended.register(spark)
    stream = spark.readStream.format("appended_log").option("path", source)
    lines = (stream.option("blockBytes", block_bytes) if block_bytes else stream).load()
    fold = _fold(spark, target, log_schema(schema), key, "seq", fan, keep)
    return parsed_lines(lines, schema, key).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, key, n) of a stream of events, final once the watermark passes."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
