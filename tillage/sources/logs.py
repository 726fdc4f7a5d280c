"""Append-only JSON-lines logs. Torn and malformed lines are skipped, unknown fields dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of an item and of a frontier entry.
JOB = (
    "id string, kind string, url string, key string, step string, status string, title string, speaker string, date string, campus string, "
    "series string, audio_url string, page_path string, audio_path string, transcript_path string, alt_urls array<string>, "
    "scripture_refs array<string>, error string, updated string"
)
CATALOG = "url string, state string, source string, note string, updated string"


def read_log(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The log's records that have a key, with seq, their place: the file's name and the line's offset order them.

    The text source splits a large log over tasks, and Spark tells a line's place by a number that grows within a
    file, so replaying takes no pass over the log on one machine.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"))
    parsed = lines.filter(F.trim("value") != "").withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    return parsed.filter(F.col(f"r.{key}").isNotNull()).select("r.*", F.struct("_file", "_start", "_line").alias("seq"))


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    from tillage.operators.state import latest_per_key

    return latest_per_key(read_log(spark, path, JOB, "id"), "id", "seq").drop("seq")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    from tillage.operators.state import latest_per_key

    return latest_per_key(read_log(spark, path, CATALOG, "url"), "url", "seq").drop("seq")
