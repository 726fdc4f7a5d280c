"""Pieces that several of the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.tables import scratch_dir


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that training never sees: crc32(doc_id as text) mod 5 = 0.

    A null id counts as not held out.
    """
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Groups of a sample whose sizes are looked up; the sizes of further, smaller ones don't matter for their result.
MOST_GROUPS = 10_000


def bounded_sample(rows: DataFrame, group: str, key: str, per_group: int, seed: int) -> DataFrame:
    """rows with _hash, at most per_group distinct ones of each group: those with the smallest hashes of key, repeatable.

    The different keys of each group are estimated first, within a few hundredths; repeats of a key don't count. Of a large group only the rows
    whose hash lies in a share that holds about twice per_group keys are ranked, so no task gathers a group however large it is, and no group
    gets fewer than min(per_group, its keys). Rows that are equal count once.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(F.col(key), F.lit(seed)))
    sizes = rows.groupBy(F.col(group).alias("_group")).agg(F.approx_count_distinct(key).alias("_size")).orderBy(F.desc("_size"), "_group").limit(MOST_GROUPS)
    share = F.coalesce((2.0 * per_group + 64) / F.greatest("_size", F.lit(1)), F.lit(1.0))
    near = hashed.join(F.broadcast(sizes), F.col(group).eqNullSafe(F.col("_group")), "left").filter(F.col("_hash") / float(1 << 64) + 0.5 < share)
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_hash", key))
    return near.drop("_group", "_size").distinct().withColumn("_rank", rank).filter(F.col("_rank") <= per_group).drop("_rank")


def filter_texts(docs: DataFrame, accept: Callable[[str | None], bool], text: str = "text") -> DataFrame:
    """The rows whose text is accepted, with all their columns, whatever these are called."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([bool(accept(t)) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
