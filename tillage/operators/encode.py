"""Vectors of texts by latent semantic analysis: a truncated SVD of TF-IDF, learned in Spark from all texts.

Words are hashed to a fixed number of terms, so everything that a task or the driver holds is bounded by parameters: a basis
has `terms` rows and some hundred columns. The SVD is randomised, by a block Krylov space: starting from random directions, each pass over the
texts multiplies the last ones by the Gram matrix, summed up in the tasks that hold the texts and then once for each block of terms.
The leading directions within all of these, and the singular values, come from a small matrix. The text-by-term matrix is never formed, nor is anything of the size of
the corpus sent anywhere but between tasks and the written table of term counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.operators.bundle import assert_same_model, with_checked_dimension
from tillage.sources.store import PassageStore, read_manifest, write_manifest
from tillage.tables import kept_table

DIMENSION = 64
TERMS = 1 << 14
#: Columns beyond the dimension, and passes after the first: more of either bring small singular values closer.
OVERSAMPLE = 16
POWER = 2
#: Texts, and terms of theirs, that are multiplied at a time, and rows of the basis that travel together.
BATCH_TEXTS = 256
BATCH_TERMS = 1 << 16
BLOCK = 256
#: Tasks of a pass for each core.
TASKS = 3
MODEL = "hashed-tfidf-svd"


def term_numbers(text: Column, terms: int = TERMS) -> Column:
    """The number of each word (letters and digits, lower case) of a text; null has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(terms)).cast("int"))


def term_counts(texts: DataFrame, key: str, text: str, terms: int = TERMS) -> DataFrame:
    """(key, terms, counts) of each row: its different terms and how often each occurs."""
    rows = texts.select(F.col(key).alias("key"), term_numbers(F.col(text), terms).alias("numbers"))
    return rows.mapInArrow(_counted, f"key {rows.schema['key'].dataType.simpleString()}, terms array<int>, counts array<int>")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, terms, counts) of rows (key, term numbers), some hundred at a time."""
    for b in (whole.slice(at, BATCH_TEXTS) for whole in batches for at in range(0, whole.num_rows, BATCH_TEXTS)):
        found = [np.unique(np.asarray(x.values), return_counts=True) for x in b.column(1)]
        made = [pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["key", "terms", "counts"])


def _sparse(b: pa.RecordBatch, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, weights, bounds of the rows) of some rows at a time; rows with a term have length one."""
    at = 0
    sizes = np.diff(np.asarray(b.column(1).offsets))
    while at < len(sizes):
        ends = np.cumsum(sizes[at:])
        n = max(1, min(BATCH_TEXTS, int(np.searchsorted(ends, BATCH_TERMS, "right"))))
        part = b.slice(at, n)
        t, c = np.asarray(part.column(1).flatten()), np.asarray(part.column(2).flatten())
        bounds = np.concatenate([[0], ends[:n]])
        w = (1 + np.log(np.maximum(c, 1))) * idf[t]
        of = np.repeat(np.arange(n), np.diff(bounds))
        length = np.sqrt(np.bincount(of, w * w, n))
        yield t, w / np.maximum(length[of], 1e-300), bounds
        at += n


def _dense(t: np.ndarray, w: np.ndarray, bounds: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(the terms that rows use, the rows as a matrix over these). Some hundred texts share most of their words, so this is small, and its products are
    several times as fast as sums over single terms."""
    used = np.zeros(terms, bool)
    used[t] = True
    place = np.cumsum(used) - 1
    rows = np.zeros((len(bounds) - 1, int(place[-1]) + 1))
    rows[np.repeat(np.arange(len(rows)), np.diff(bounds)), place[t]] = w
    return np.flatnonzero(used), rows


def _gram_times(counts: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A basis for the weighted rows A of counts.

    Each task sends one matrix of the basis's size, so there are only a few tasks for each core, however many files there are."""
    terms, width = basis.shape
    counts = counts.coalesce(TASKS * counts.sparkSession.sparkContext.defaultParallelism)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((terms, width))
        for b in batches:
            for part in _sparse(b, idf):
                used, rows = _dense(*part, terms)
                total[used] += rows.T @ (rows @ basis[used])
        for at in range(0, terms, BLOCK):
            if total[at : at + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([total[at : at + BLOCK].astype("<f4").tobytes()], pa.binary())], names=["block", "sums"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, sums in zip(b.column(0).to_pylist(), b.column(1)):
                total[block] = total.get(block, 0) + np.frombuffer(sums.as_buffer(), "<f4").astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "sums"])

    kind = "block int, sums binary"
    out = np.zeros((terms, width))
    dealt = counts.mapInArrow(partial, kind).repartition(-(-terms // BLOCK), "block")  # a stated number, or small partitions would be joined into one task's batch
    for r in dealt.mapInArrow(summed, kind).collect():  # terms x width numbers
        part = np.frombuffer(r["sums"]).reshape(-1, width)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
    return out


def _new_directions(z: np.ndarray, bases: list[np.ndarray]) -> np.ndarray:
    """Orthonormal columns that span what z has beyond bases."""
    size = np.abs(z).max(initial=0)
    for _ in range(2):
        for b in bases:
            z = z - b @ (b.T @ z)
        z, r = np.linalg.qr(z)
        z = z[:, np.abs(np.diag(r)) > 1e-9 * max(size, 1e-300)]
        size = 1.0
    return z[:, : z.shape[0] - sum(b.shape[1] for b in bases)]


@dataclass
class Encoder:
    """idf: of each term. basis: terms x dimension, a term's share in each direction. singular: the singular values, largest first."""

    idf: np.ndarray
    basis: np.ndarray
    singular: np.ndarray

    @property
    def dimension(self) -> int:
        return self.basis.shape[1]

    @property
    def revision(self) -> str:
        return hashlib.sha256(self.idf.astype("<f4").tobytes() + self.basis.astype("<f4").tobytes()).hexdigest()[:12]

    def encode(self, texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        """(key, vector) of each row of texts, vectors of length one. A text without a known word, a null one too, gets zeros. Repeated rows get equal vectors.

        Terms are counted where they are weighed: two functions in a row would each have a worker of its own for each core."""
        rows = texts.select(F.col(key).alias("key"), term_numbers(F.col(text), len(self.idf)).alias("numbers"))
        idf, basis = self.idf, self.basis

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _counted(batches):
                y = np.zeros((0, basis.shape[1]))
                for part in _sparse(b, idf):
                    used, rows = _dense(*part, len(idf))
                    y = np.concatenate([y, rows @ basis[used]])
                length = np.sqrt((y * y).sum(1, keepdims=True))
                y = np.where(length > 1e-12, y / np.maximum(length, 1e-12), 0).astype(np.float32)
                offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], names=[key, "vector"])

        return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, vector array<float>")

    def save(self, spark: SparkSession, path: str) -> None:
        """The model as a table of terms and a manifest with its identity."""
        rows = [(i, float(self.idf[i]), self.basis[i].tolist()) for i in range(len(self.idf))]
        spark.createDataFrame(rows, "term int, idf double, basis array<double>").write.mode("overwrite").parquet(f"{path}/terms")
        singular = ",".join(map(repr, self.singular.tolist()))
        write_manifest(spark, f"{path}/manifest", MODEL, self.revision, self.dimension, {"terms": len(rows)}, singular=singular)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Encoder:
        """A saved model; one whose terms don't have the identity that its manifest states is refused."""
        manifest = read_manifest(spark, f"{path}/manifest")
        if manifest is None:
            raise ValueError(f"no model at {path}")
        rows = spark.read.parquet(f"{path}/terms").orderBy("term").collect()  # as many as the model has terms
        found = Encoder(np.array([r["idf"] for r in rows]), np.array([r["basis"] for r in rows]), np.array([float(x) for x in manifest["singular"].split(",")]))
        assert_same_model(manifest, MODEL, found.revision, found.dimension)
        return found


def fit_encoder(
    texts: DataFrame, text: str = "text", dimension: int = DIMENSION, terms: int = TERMS, oversample: int = OVERSAMPLE, power: int = POWER, seed: int = 1
) -> Encoder:
    """An encoder learned from all rows of texts; null texts count as empty. Without any word its basis is zero.

    A row's weights are (1 + ln count) x idf, idf = 1 + ln((1 + rows) / (1 + rows with the term)), scaled to length one. Signs are
    chosen so that each direction's largest share is positive.
    """
    if dimension > terms:
        raise ValueError(f"{terms} terms can't give {dimension} directions")
    counts = kept_table(term_counts(texts.withColumn("_row", F.lit(0)), "_row", text, terms), "term-counts")
    n = counts.count()
    df = np.zeros(terms)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as many rows as terms, at most
        df[r["t"]] = r["count"]
    idf = np.where(df > 0, 1 + np.log((1 + n) / (1 + df)), 0.0)
    z = np.random.default_rng(seed).normal(size=(terms, min(terms, dimension + oversample)))
    bases, images = [], []
    for _ in range(power + 1):
        q = _new_directions(z, bases)
        if not q.shape[1]:
            break
        z = _gram_times(counts, idf, q)
        bases.append(q)
        images.append(z)
    basis = np.concatenate(bases, 1)
    gram = basis.T @ np.concatenate(images, 1)
    values, turn = np.linalg.eigh((gram + gram.T) / 2)
    lead = np.argsort(values)[::-1][:dimension]
    basis, values = basis @ turn[:, lead], np.maximum(values[lead], 0)
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(dimension)])
    basis[:, values <= 1e-10 * max(values.max(initial=0), 1e-300)] = 0
    return Encoder(idf, basis, np.sqrt(values))


def index_passages(store: PassageStore, chunks: DataFrame, encoder: Encoder, manifest: str) -> None:
    """Put chunks (id, text, source_id and the store's other columns) into the store with their vectors, in the place of what it
    has of their sources, in one version. A store that another model filled is refused, as is a vector of another size.
    """
    spark = chunks.sparkSession
    assert_same_model(read_manifest(spark, manifest), MODEL, encoder.revision, encoder.dimension)
    rows = kept_table(chunks, "chunks")
    vectors = kept_table(with_checked_dimension(encoder.encode(rows), "vector", encoder.dimension), "vectors")
    store.put(rows, vectors)
    counts = {r["collection"]: r["count"] for r in store.table().groupBy("collection").count().collect()}  # collections are few
    write_manifest(spark, manifest, MODEL, encoder.revision, encoder.dimension, counts)
