"""A passage table in Parquet, with versions and a partition for each collection, so that a collection's filter prunes files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.sources.versions import Versions, partition_value

SCHEMA = (
    "id string, text string, title string, citation string, url string, date string, speaker string, series string, campus string, book_id string, "
    "chapter int, verse_start int, verse_end int, scripture_refs array<string>, primary_refs array<string>, source_id string, vector array<float>, collection string"
)


def replace_folder(spark: SparkSession, live: str, rebuilt: str) -> None:
    """Put a finished folder in the place of another one. The old one stands aside (hidden from readers) until the new one is in
    place, and comes back if that fails."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, old = path(rebuilt), path(live)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = path(old.getParent(), ".before-" + old.getName().replace("=", "-"))
    if fs.exists(aside) and fs.exists(old):
        fs.delete(aside, True)
    if fs.exists(old) and not fs.rename(old, aside):
        raise OSError(f"{live} can't be moved aside")
    try:
        if not fs.exists(new) or not fs.rename(new, old):
            raise OSError(f"{rebuilt} can't be moved to {live}")
    except Exception:
        if fs.exists(aside) and not fs.exists(old):
            fs.rename(aside, old)
        raise
    fs.delete(aside, True)


def write_manifest(spark: SparkSession, path: str, model: str, revision: str, dimension: int, counts: dict[str, int], **more: str) -> None:
    """One row of JSON that says which model made an index and what is in it."""
    from tillage.operators.bundle import model_fingerprint

    row = {"model": model, "revision": revision, "dimension": dimension, "fingerprint": model_fingerprint(model, revision, dimension), "counts": counts, **more}
    spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest, None where there is none."""
    try:
        found = spark.read.text(path).head(1)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return json.loads(found[0]["value"]) if found else None


class PassageStore:
    """Appends, replacements and scans of passages under a path that all executors see. Each change is one version of the table (see
    `versions`): readers see it whole or not at all, and writers that meet don't lose each other's."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def exists(self) -> bool:
        return self.versions.newest() > 0

    def table(self, version: int | None = None) -> DataFrame:
        """All passages of a version, the newest if none is named; columns that older files lack are empty."""
        return self.versions.read(SCHEMA, version)

    def _rows(self, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
        """chunks with their vectors (id, vector). A chunk without a vector, a vector without a chunk and an id with
        several vectors or chunks are errors."""
        one = vectors.groupBy("id").agg(F.first("vector").alias("vector"), F.count("*").alias("_n"))
        per = chunks.groupBy("id").agg(F.count("*").alias("_m"))
        wrong = per.join(one, "id", "full").filter("coalesce(_n, 0) <> 1 or coalesce(_m, 0) <> 1").select("id", "_n").head(1)
        if wrong:
            raise ValueError(f"no vector for {wrong[0]['id']}" if wrong[0]["_n"] is None else f"chunks and vectors don't match at {wrong[0]['id']}")
        both = chunks.join(one.drop("_n"), "id", "left").withColumn("vector", F.coalesce("vector", F.raise_error(F.concat(F.lit("no vector for "), "id")).cast("array<float>")))
        names = [c.strip().split()[0] for c in SCHEMA.split(", ")]
        kinds = dict(c.strip().split(" ", 1) for c in SCHEMA.split(", "))
        return both.select(*[(F.col(c) if c in both.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names])

    def add(self, chunks: DataFrame, vectors: DataFrame) -> int:
        """Append chunks with their vectors; gives the version."""
        new = self.versions.write(self._rows(chunks, vectors), "collection")
        return self.versions.change(lambda base: self.versions.folders(base) + new)

    def _without(self, base: int, gone: DataFrame) -> list[str]:
        """The folders of a version without all passages of some sources; only collections that hold one are written anew."""
        folders, rows = self.versions.folders(base), self.table(base)
        if not folders:
            return folders
        hit = [r["collection"] for r in rows.join(gone, "source_id", "left_semi").select("collection").distinct().collect()]  # collections are few
        if not hit:
            return folders
        touched = F.col("collection").isin([c for c in hit if c is not None]) | (F.col("collection").isNull() & F.lit(None in hit))
        left = rows.filter(touched).join(gone, "source_id", "left_anti")
        return [f for f in folders if partition_value(f) not in hit] + self.versions.write(left, "collection")

    def replace_sources(self, source_ids: DataFrame) -> int:
        """Drop all passages of the given sources (source_id), in every collection; gives the version. A null source_id names none."""
        gone = source_ids.select("source_id").distinct()
        return self.versions.change(lambda base: self._without(base, gone))

    def put(self, chunks: DataFrame, vectors: DataFrame) -> int:
        """Put chunks with their vectors in the place of all passages of their sources, in one version."""
        new, gone = self.versions.write(self._rows(chunks, vectors), "collection"), chunks.select("source_id").distinct()
        return self.versions.change(lambda base: self._without(base, gone) + new)

    def scan(self, collection: str, where=None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """A collection's passages; filter and columns reach the Parquet scan."""
        rows = self.table().filter(F.col("collection") == collection)
        rows = rows.filter(where) if where is not None else rows
        rows = rows.select(*columns) if columns else rows
        return rows.limit(limit) if limit else rows

    def has_source(self, collection: str, source_id: str) -> bool:
        return self.scan(collection, F.col("source_id") == source_id, ["source_id"], 1).count() > 0
