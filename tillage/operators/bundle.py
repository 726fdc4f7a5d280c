"""Manifests of bundles: identity, counts and checksums, and their verification."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def model_fingerprint(model: str, revision: str, dimension: int) -> str:
    """The first 16 hex digits of the SHA-256 of `model@revision/dimension`."""
    return hashlib.sha256(f"{model}@{revision}/{dimension}".encode()).hexdigest()[:16]


def assert_same_model(index: dict | None, model: str, revision: str, dimension: int) -> None:
    """Refuse an index that another embedding model made; an index without a manifest passes."""
    if index and (index.get("model"), index.get("revision"), index.get("dimension")) != (model, revision, dimension):
        raise ValueError(f"the index was made by {index.get('model')}@{index.get('revision')}/{index.get('dimension')}; rebuild it or use that model")


def with_checked_dimension(table: DataFrame, vector: str, dimension: int) -> DataFrame:
    """table, which fails as it runs if a vector has another size."""
    return table.withColumn(vector, F.when(F.size(vector) == dimension, F.col(vector)).otherwise(F.raise_error(F.lit(f"a vector hasn't {dimension} components"))))


def checksums(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of files as spark.read.format("binaryFile") gives them."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("bytes"))


def totals(sums: DataFrame) -> DataFrame:
    return sums.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), F.count("*").alias("file_count"))


def verify(manifest: DataFrame, found: DataFrame, quick: bool = False) -> DataFrame:
    """(path, status) for each file of the manifest: missing, corrupt (size), corrupt (hash; not if quick) or ok."""
    f = found.select(F.col("path").alias("_path"), F.col("sha256").alias("_sha"), F.col("bytes").alias("_bytes"))
    status = F.when(F.col("_path").isNull(), "missing").when(F.col("_bytes") != F.col("bytes"), "corrupt (size)")
    status = status if quick else status.when(F.col("_sha") != F.col("sha256"), "corrupt (hash)")
    return manifest.join(f, F.col("path") == F.col("_path"), "left").select("path", status.otherwise("ok").alias("status"))


def compare_counts(expected: DataFrame, actual: DataFrame, key: str = "collection", n: str = "n") -> DataFrame:
    """(key, expected, actual) where they differ; a key that one side lacks counts as 0."""
    a = expected.select(key, F.col(n).alias("expected"))
    b = actual.select(key, F.col(n).alias("actual"))
    both = a.join(b, key, "full").fillna(0, ["expected", "actual"])
    return both.filter("expected <> actual")


def collection_counts(table: DataFrame, names: list[str]) -> DataFrame:
    """(collection, n) for all names, also those without rows."""
    every = table.sparkSession.createDataFrame([(c,) for c in names], "collection string")
    return every.join(table.groupBy("collection").agg(F.count("*").alias("n")), "collection", "left").fillna(0, ["n"])


def guard_books(verses: DataFrame, expected: int = 66) -> DataFrame:
    """One row: books, missing and ok, whether at least `expected` books are there."""
    from tillage.functions.refs import canon

    n = verses.agg(F.count_distinct("book").alias("books"))
    missing = canon(verses.sparkSession).join(verses.select("book").distinct(), "book", "left_anti")
    names = missing.agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]).alias("missing"))
    return n.crossJoin(names).withColumn("ok", F.col("books") >= expected)  # one row beside one row
