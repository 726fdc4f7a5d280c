"""Exact centroid clustering in whole numbers, by Yinyang grouping.

Centroids are clustered into groups once. Each vector keeps an upper bound of the distance to its centroid and, for every group,
one lower bound of the distance to the group's other centroids. After centroids move, the bounds move by as much. While the
smallest lower bound stays above the upper bound, no centroid can have come nearer (the global filter); else the upper bound is made exact, and
only groups whose bound isn't above it are scanned, exactly (the group filter). Assignments equal those of a full scan, ties included.

A round is one narrow map over the vectors, which carry their bounds, and a sum per cluster, added up in each task before the
shuffle. Only centroids and their sums, k x d numbers, pass through the driver. Rounds are held by persist, so nothing is
written again in each round; a lost executor costs its partitions, which a few narrow maps over the written vectors make anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import written

K = 40
ROUNDS = 5
DIM = 64
#: Centroids of a group on average, and rounds that cluster the centroids.
GROUP_SIZE = 10
GROUP_ROUNDS = 5
SCALE = 256
#: Components beyond this are refused: squared distances of 64 of them would no longer fit a bigint.
MOST = 1 << 27
#: Below this largest component, dot products are exact in double precision.
EXACT = 1 << 22
#: Bounds are widened by this share for rounding; a tie is always scanned.
SLACK = 1e-9
ROWS = 4096


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; the query stops where one is too large to be measured."""
    floor = lambda x: F.floor(x.cast("double") * scale)
    fits = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) <= MOST)
    return F.when(fits, F.transform(vector, lambda x: floor(x).cast("int"))).otherwise(F.raise_error(F.lit(f"components must not exceed {MOST} / {scale}")).cast("array<int>"))


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has dim components, none null or non-finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad, F.lit(False))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows to centroids, as int64."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT // max(1, x.shape[1] // 64):
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return (np.einsum("ij,ij->i", xf, xf)[:, None] + np.einsum("ij,ij->i", cf, cf)[None, :] - 2 * (xf @ cf.T)).astype(np.int64)
    x, c = x.astype(np.int64), c.astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def group_centroids(centroids: np.ndarray, size: int = GROUP_SIZE, rounds: int = GROUP_ROUNDS) -> np.ndarray:
    """The group of each centroid, by a few rounds of plain k-means over them from evenly spaced ones."""
    k = len(centroids)
    t = max(1, k // size)
    c = centroids.astype(np.float64)
    means = c[np.arange(t) * k // t]
    for _ in range(rounds):
        of = ((c[:, None, :] - means[None, :, :]) ** 2).sum(2).argmin(1)
        means = np.stack([c[of == g].mean(0) if (of == g).any() else means[g] for g in range(t)])
    return of


def first_bounds(x: np.ndarray, centroids: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper bound, lower bounds) by a full scan."""
    d = squared(x, centroids)
    own = d.argmin(1)
    upper = np.sqrt(d[np.arange(len(x)), own].astype(np.float64)) * (1 + SLACK)
    return own, upper, _lower(d, own, groups)


def _lower(d: np.ndarray, own: np.ndarray, groups: np.ndarray) -> np.ndarray:
    others = np.sqrt(d.astype(np.float64)) * (1 - SLACK)
    others[np.arange(len(d)), own] = np.inf
    return np.stack([others[:, groups == g].min(1, initial=np.inf) for g in range(groups.max() + 1)], 1)


def next_bounds(
    x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray, groups: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Those of the round before, after the centroids moved from old to new, and the number of distances measured."""
    moved = np.sqrt(((new.astype(np.float64) - old) ** 2).sum(1)) * (1 + SLACK)
    own, upper, lower = own.copy(), upper + moved[own], lower.copy()
    for g in range(lower.shape[1]):
        lower[:, g] -= moved[groups == g].max(initial=0)
    measured = 0
    look = np.flatnonzero(~(lower.min(1) > upper))
    if not len(look):
        return own, upper, lower, measured
    exact = np.empty(len(look), np.int64)
    for c in np.unique(own[look]).tolist():
        of = own[look] == c
        exact[of] = squared(x[look[of]], new[c : c + 1])[:, 0]
    measured += len(look)
    upper[look] = np.sqrt(exact.astype(np.float64)) * (1 + SLACK)
    before, best, best_d = own[look].copy(), own[look].copy(), exact.copy()
    scanned = ~(lower[look] > upper[look][:, None])
    seen: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for g in range(lower.shape[1]):
        at, members = np.flatnonzero(scanned[:, g]), np.flatnonzero(groups == g)
        if len(at) and len(members):
            d = squared(x[look[at]], new[members])
            measured += d.size
            seen[g] = at, members, d
            near = d.argmin(1)
            nd, nc = d[np.arange(len(at)), near], members[near]
            nearer = (nd < best_d[at]) | ((nd == best_d[at]) & (nc < best[at]))
            best[at[nearer]], best_d[at[nearer]] = nc[nearer], nd[nearer]
    own[look] = best
    upper[look] = np.sqrt(best_d.astype(np.float64)) * (1 + SLACK)
    changed = np.flatnonzero(best != before)
    left = np.sqrt(exact[changed].astype(np.float64)) * (1 - SLACK)
    lower[look[changed], groups[before[changed]]] = np.minimum(lower[look[changed], groups[before[changed]]], left)
    for g, (at, members, d) in seen.items():
        others = np.sqrt(d.astype(np.float64)) * (1 - SLACK)
        others[members[None, :] == best[at][:, None]] = np.inf
        lower[look[at], g] = others.min(1)
    return own, upper, lower, measured


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    flat = np.asarray(column.flatten()).astype(dtype)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel(), kind))


def _assigned(state: DataFrame, key: str, old: np.ndarray | None, new: np.ndarray, groups: np.ndarray) -> DataFrame:
    """state with cluster, upper and lower after the centroids became new; where old is None, by a full scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                x = _matrix(part.column(1), np.int32)
                if old is None:
                    own, upper, lower = first_bounds(x, new, groups)
                else:
                    own, upper, lower, _ = next_bounds(x, np.asarray(part.column(2)), np.asarray(part.column(3)), _matrix(part.column(4), np.float64), old, new, groups)
                made = [pa.array(own.astype(np.int32)), pa.array(upper), _lists(lower, pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=[key, "x", "cluster", "upper", "lower"])

    kind = state.schema[key].dataType.simpleString()
    return state.mapInArrow(run, f"`{key}` {kind}, x array<int>, cluster int, upper double, lower array<double>")


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster that has vectors, exactly; others stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            own, x = np.asarray(b.column(1)), _matrix(b.column(0), np.int64)
            np.add.at(sums, own, x)
            counts += np.bincount(own, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), _lists(sums[some], pa.int64())], names=["cluster", "n", "sums"])

    parts = state.select("x", "cluster").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    total = parts.select("cluster", "n", F.posexplode("sums").alias("i", "v")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    new = centroids.copy()
    for r in total.collect():  # k x d rows
        new[r["cluster"], r["i"]] = int(r["v"]) // r["n"]
    return new


def yinyang_clusters(
    embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, vector: str = "embedding", key: str = "vec_id", seed: str = "2:", group_size: int = GROUP_SIZE
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that can be clustered.

    Vectors that aren't of exactly dim components or hold a null or non-finite one are left out. Components become
    floor(256 * x); one beyond 2^27 then stops the query, as distances would not fit a bigint. The first centroids are the k vectors with the smallest
    SHA-256 of seed and key (ties: the smaller vector); a null key never starts one. With fewer vectors there are
    as many centroids. Vectors that repeat a key are vectors of their own, and equal ones get equal results; equal first
    centroids leave the later one empty. Distances are squared; ties go to the smaller cluster. Other columns are ignored, and an empty table, or one without
    a key, gives no rows.
    """
    rows = embeddings.select(F.col(key).alias(key), F.col(vector).alias("_v")).filter(usable(F.col("_v"), dim))
    vectors = written(rows.select(key, whole_numbers(F.col("_v")).alias("x")), "whole-vectors")
    hashed = vectors.filter(F.col(key).isNotNull()).withColumn("h", F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256))
    first = [r["x"] for r in hashed.orderBy("h", "x").limit(k).collect()]  # k rows
    out = f"`{key}` {vectors.schema[key].dataType.simpleString()}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        return vectors.sparkSession.createDataFrame([], out)
    centroids = np.array(first, np.int64)
    groups = group_centroids(centroids, group_size)
    state = _assigned(vectors, key, None, centroids, groups).persist(StorageLevel.MEMORY_AND_DISK)
    before = None
    for _ in range(rounds):
        new = _means(state, centroids)  # this also fills state's store, so the one before can go
        if before is not None:
            before.unpersist()
        before, state = state, _assigned(state, key, centroids, new, groups).persist(StorageLevel.MEMORY_AND_DISK)
        centroids = new
    final = centroids

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, x = np.asarray(b.column(2)), _matrix(b.column(1), np.int64)
            apart = x - final[own]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array((apart * apart).sum(1))], names=[key, "cluster", "distance"])

    found = written(state.select(key, "x", "cluster").mapInArrow(measured, out.split(", cluster_inertia")[0]), "clusters")
    for held in (before, state):
        if held is not None:
            held.unpersist()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    named = vectors.sparkSession.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.crossJoin(F.broadcast(sums.agg(F.sum("cluster_inertia").alias("inertia")))).join(named, "cluster")
    return found.join(F.broadcast(sums), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> str:
    d2 = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT vec_id, row_id, x, (arg_min({{'n': n, 'd': {d2}}}, ({d2}, n))) AS best FROM v, c{i} GROUP BY vec_id, row_id, x)")
        if i < rounds:
            mean = f"(SELECT n, list(CAST(floor_sum AS BIGINT) ORDER BY i) AS c FROM (SELECT best.n AS n, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum FROM a{i}, range(1, {dim + 1}) t(i) GROUP BY best.n, i) GROUP BY n)"
            steps.append(f"m{i} AS {mean}, c{i + 1} AS (SELECT c{i}.n, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (n))")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, c) - 1 AS n, c FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, x AS c FROM v WHERE vec_id IS NOT NULL ORDER BY h, c LIMIT {k})),
{", ".join(steps)},
last AS (SELECT vec_id, best.n AS n, best.d AS d FROM a{rounds}),
s AS (SELECT n, sum(d) AS s FROM last GROUP BY n)
SELECT vec_id, CAST(last.n AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM last) AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM last JOIN s ON s.n = last.n JOIN c{rounds} f ON f.n = last.n
"""


SQL = _sql()
