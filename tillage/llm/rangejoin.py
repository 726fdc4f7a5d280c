"""Embedding near-duplicates by an exact metric range join.

Vectors are scaled to length one, where a cosine of c is a distance of
sqrt(2 - 2c) = r. Every label has pivots, more of them the more vectors it has; a vector's home is the cell
of its nearest pivot. Let y, within r of x, live in the cell of pivot j. By the triangle inequality
d(x, j) - d(x, home) <= 2r and d(x, j) <= r + the cell's radius; and as y lies on the other side of the plane
between the two pivots, x is no farther than r from that plane:
(d(x, j)^2 - d(x, home)^2) / (2 d(home, j)) <= r. x is replicated to the cells for which all three hold, so
all neighbours of a vector are in its home cell, and cells join independently.

Pivots meet the vectors in tasks of bounded size and never pass through the driver. Equal vectors are one class with a
number of copies. A cell is cut into blocks of bounded size, each pair of which is one task's matrix product, so a
hot cell spreads over tasks. A block pair gives a count for each vector and a spanning forest of its links, never the
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.llm.common import written
from tillage.llm.components import connected_components

COSINE = 0.93
#: A label of n vectors has sqrt(n) x PIVOT_SHARE pivots, LEAST_PIVOTS at least (or all its vectors, if they are fewer).
PIVOT_SHARE = 1 / 16
LEAST_PIVOTS = 4
#: Vectors that meet their label's pivots in one task, or TASK_PIVOTS for each pivot if that is more.
TASK_ROWS = 20_000
TASK_PIVOTS = 16
#: Vectors of a block, and numbers in them at most (long vectors make smaller blocks).
BLOCK_ROWS = 8192
BLOCK_NUMBERS = 1 << 22
#: Slack for rounding in distances; what is linked is decided by the cosine itself.
SLACK = 1e-6


def usable(vector: str) -> Column:
    """Whether a vector can link: not null, not empty or zero, all components finite."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten()).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def with_pivots(classes: DataFrame, share: float = PIVOT_SHARE, least: int = LEAST_PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(classes, pivots). classes has label, dim and part, to which its rows are dealt; pivots has p_label, p_dim, p_part, place and
    pivot, each pivot in every part of its label. A label's pivots are those of its vectors with the smallest hashes."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("k", F.least(F.col("n"), F.greatest(F.lit(least), F.ceil(F.sqrt("n") * share))))
    sizes = sizes.withColumn("parts", F.ceil(F.col("n") / F.greatest(F.lit(TASK_ROWS), F.col("k") * TASK_PIVOTS)).cast("int"))
    at = classes.join(sizes, ["label", "dim"])
    hashed = at.withColumn("h", F.xxhash64("class_id", F.lit(23)))
    near = hashed.filter(F.col("h") / float(1 << 64) + 0.5 < (F.col("k") * 2 + 64) / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("label", "dim").orderBy("h", "class_id"))
    pivots = near.withColumn("place", rank).filter("place <= k")
    pivots = pivots.select(F.col("label").alias("p_label"), F.col("dim").alias("p_dim"), F.col("place").alias("place"), F.col("embedding").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p_part"))
    return at.withColumn("part", F.pmod(F.xxhash64("class_id", F.lit(29)), F.col("parts")).cast("int")).drop("n", "k", "parts"), pivots


def _cells(classes: DataFrame, pivots: DataFrame, r: float) -> DataFrame:
    """classes with home (the place of the nearest pivot), to_home (its distance), and for the cells that may need
    a replica cells and to_cells, their distances."""
    names = ["label", "dim", "class_id", "copies", "embedding"]
    kinds = ", ".join(f"`{n}` {classes.schema[n].dataType.simpleString()}" for n in names)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(names).combine_chunks()
        order = np.argsort(np.asarray(right.column("place")))
        p = _units(right.column("pivot").combine_chunks().take(pa.array(order)))
        homes, to_home, counts, cells, far = [], [], [], [], []
        for at in range(0, len(left), 512):
            x = _units(left.column("embedding").slice(at, 512).combine_chunks())
            d2 = np.maximum(2 - 2 * (x @ p.T), 0)
            home = d2.argmin(1)
            d, own2 = np.sqrt(d2), d2[np.arange(len(x)), home]
            own = np.sqrt(own2)
            apart = np.sqrt(np.maximum(2 - 2 * (p[home] @ p.T), 0))
            plane = (d2 - own2[:, None]) / np.maximum(2 * apart, 1e-9)
            need = (d - own[:, None] <= 2 * r + SLACK) & ((plane <= r + SLACK) | (apart <= 1e-4))
            homes.append(home)
            to_home.append(own)
            counts.append(need.sum(1))
            cells.append(np.nonzero(need)[1])
            far.append(d[need])
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32))
        made = {
            "home": pa.array(np.concatenate(homes).astype(np.int32)),
            "to_home": pa.array(np.concatenate(to_home)),
            "cells": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(cells).astype(np.int32))),
            "to_cells": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(far))),
        }
        for name, column in made.items():
            left = left.append_column(name, column)
        return left

    return classes.groupBy("label", "dim", "part").cogroup(pivots.groupBy("p_label", "p_dim", "p_part")).applyInArrow(run, f"{kinds}, home int, to_home double, cells array<int>, to_cells array<double>")


def cell_members(classes: DataFrame, cosine: float = COSINE, share: float = PIVOT_SHARE, least: int = LEAST_PIVOTS) -> DataFrame:
    """(label, dim, cell, class_id, copies, embedding, is_home): each class in its home cell and, as a replica, in the
    cells that may hold a neighbour of it."""
    r = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    homes = written(_cells(*with_pivots(classes, share, least), r), "homes")
    radius = homes.groupBy("label", "dim", F.col("home").alias("cell")).agg(F.max("to_home").alias("radius"))
    member = homes.select("label", "dim", "class_id", "copies", "embedding", "home", F.explode(F.arrays_zip("cells", "to_cells")).alias("c"))
    member = member.withColumn("cell", F.col("c.cells")).join(radius, ["label", "dim", "cell"]).filter(F.col("c.to_cells") <= F.col("radius") + r + SLACK)
    return written(member.select("label", "dim", "cell", "class_id", "copies", "embedding", (F.col("cell") == F.col("home")).alias("is_home")), "members")


def range_links(classes: DataFrame, cosine: float = COSINE, share: float = PIVOT_SHARE, least: int = LEAST_PIVOTS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(counts, links) of classes (class_id, label, dim, copies, embedding).

    counts: class_id and n, the vectors other than its own copies that a class links with, in parts that add
    up. links: a and b, enough to join all classes that a chain of links joins.
    """
    member = cell_members(classes, cosine, share, least)
    block = F.least(F.lit(block_rows), F.greatest(F.lit(64), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dim"))))
    sizes = member.groupBy("label", "dim", "cell").agg(F.count_if("is_home").alias("h"), F.count("*").alias("m"))
    sizes = sizes.select("label", "dim", "cell", F.ceil(F.col("h") / block).cast("int").alias("nh"), F.ceil(F.col("m") / block).cast("int").alias("nm")).filter("nh > 0")
    at = member.join(sizes, ["label", "dim", "cell"]).withColumn("x", F.xxhash64("class_id"))
    left = at.filter("is_home").withColumn("i", F.pmod("x", F.col("nh")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nm") - 1)))
    right = at.withColumn("j", F.pmod("x", F.col("nm")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)))
    key = ["label", "dim", "cell", "i", "j"]
    pick = [*key, "class_id", "copies", "embedding"]
    both = left.select(*pick, F.lit(True).alias("is_left")).unionByName(right.select(*pick, F.lit(False).alias("is_left")))

    def run(table: pa.Table) -> pa.Table:
        is_left = table.column("is_left").to_numpy(zero_copy_only=False).astype(bool)
        ids, copies = np.asarray(table.column("class_id")), np.asarray(table.column("copies"))
        x = _units(table.column("embedding").combine_chunks())
        a, b = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        counts, src, dst = np.zeros(len(a), np.int64), [], []
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for at in range(0, len(a), 512):
            rows = a[at : at + 512]
            near = (x[rows] @ x[b].T >= cosine) & (ids[rows][:, None] != ids[b][None, :])
            counts[at : at + 512] = near @ copies[b]
            for i, hits in zip(ids[rows].tolist(), near):
                for k in ids[b[hits]].tolist() if hits.any() else ():
                    ri, rk = root(i), root(k)
                    if ri != rk:
                        parent[max(ri, rk)] = min(ri, rk)
                        src.append(i)
                        dst.append(k)
        n = len(src)
        return pa.table(
            {
                "class_id": pa.concat_arrays([pa.array(ids[a], pa.int64()), pa.array(src, pa.int64())]),
                "n": pa.concat_arrays([pa.array(counts, pa.int64()), pa.nulls(n, pa.int64())]),
                "other": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(dst, pa.int64())]),
            }
        )

    found = written(both.groupBy(*key).applyInArrow(run, "class_id bigint, n bigint, other bigint"), "range-links")
    counts = found.filter("n IS NOT NULL").groupBy("class_id").agg(F.sum("n").alias("n"))
    return counts, found.filter("other IS NOT NULL").select(F.col("class_id").alias("a"), F.col("other").alias("b"))


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, share: float = PIVOT_SHARE, least: int = LEAST_PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of embeddings.

    Vectors of one label (not null) and one size link at a cosine of `cosine` or more, in double
    precision; a cosine that is just `cosine` links. Vectors that are null, empty or zero, hold null or non-finite components, or have
    no label link with nothing, copies included. component_id is the smallest vec_id reachable by links,
    kept whether that is the row's own. A row with a null vec_id links with nothing and has a null component_id.
    Rows that repeat a vec_id with the same label and vector are copies and link with each other; with other vectors they are
    one node of the links, whose numbers add up. Further columns are ignored; an empty table gives no rows.
    """
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label"), F.col("embedding"))
    rows = rows.withColumn("ok", usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    numbers = F.transform("embedding", lambda x: x.cast("double") + 0.0)
    rows = written(rows.withColumn("same", F.when(F.col("ok"), F.sha2(F.to_json(F.struct(numbers.alias("e"))), 256))), "vectors")
    classes = written(
        rows.filter("ok").groupBy("label", "same").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding")),
        "vector-classes",
    )
    counts, links = range_links(classes.select("class_id", "label", "dim", "copies", "embedding"), cosine, share, least, block_rows)
    components = connected_components(links)
    of_class = (
        classes.select("label", "same", "class_id", "copies")
        .join(counts, "class_id", "left")
        .join(components, F.col("class_id") == F.col("node"), "left")
        .select("label", "same", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    )
    joined = rows.drop("embedding").join(of_class, ["label", "same"], "left")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
