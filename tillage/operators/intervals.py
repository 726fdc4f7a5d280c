"""Overlaps of references within hot chapters: a join in bins of verses, and counts without pairs.

References have columns book, chapter, vs, ve; a null vs is the whole chapter. Verse numbers are not negative, and arrays as long as
the greatest of a chapter are held, which is some hundred numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.tables import kept_table

#: Verses of a bin, lines of a block, and pairs of lines that are compared at a time.
BIN = 8
BLOCK = 4096
PAIRS = 1 << 20
_WHOLE = np.iinfo(np.int32).max
_NONE = np.iinfo(np.int64).max


def overlapping(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """a joined to b where references overlap, as `links.overlapping` does, with the verses in bins as part of the key.

    A reference stands in each bin that it reaches and a pair is given in the first bin that both reach, so it comes once, and a hot chapter is
    dealt to as many keys as it has bins. Whole chapters meet the others of the chapter by the chapter alone.
    """
    ref = ("book", "chapter", "vs", "ve")
    other = b.withColumnsRenamed({c: f"_{c}" for c in ref})
    same = (F.col("book") == F.col("_book")) & (F.col("chapter") == F.col("_chapter"))
    lo = lambda c: F.floor(F.col(c) / width).cast("int")
    bins = lambda df, s, e, name: df.filter(F.col(s).isNotNull()).withColumn(name, F.explode(F.sequence(lo(s), F.greatest(lo(s), lo(e)))))
    at = bins(a, "vs", "ve", "_bin").join(bins(other, "_vs", "_ve", "_bin2"), same & (F.col("_bin") == F.col("_bin2")) & (F.col("vs") <= F.col("_ve")) & (F.col("_vs") <= F.col("ve")))
    binned = at.filter(F.col("_bin") == F.greatest(lo("vs"), lo("_vs"))).drop("_bin", "_bin2")
    whole = a.join(other, same & (F.col("vs").isNull() | F.col("_vs").isNull()))
    return binned.unionByName(whole).drop("_book", "_chapter", "_vs", "_ve")


def _ends(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first verse, last verse) of rows; a whole chapter is 0 to _WHOLE."""
    t = t.combine_chunks()
    null = t.column("vs").is_null().to_numpy(zero_copy_only=False)
    vs = np.where(null, 0, t.column("vs").fill_null(0).to_numpy().astype(np.int64))
    ve = np.where(null, _WHOLE, t.column("ve").fill_null(0).to_numpy().astype(np.int64))
    return t.column("_order").to_numpy().astype(np.int64), vs, ve


def _whole_runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, bounds of the runs of an equal key) of rows sorted by key; no run is cut."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = (pa.concat_tables([held, t]) if held else t).combine_chunks()
        new = np.zeros(t.num_rows - 1, bool)
        for c in key:
            new |= pc.not_equal(t.column(c)[1:], t.column(c)[:-1]).to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(new) + 1])
        if len(bounds) > 1:
            yield t.slice(0, int(bounds[-1])).combine_chunks(), bounds
        held = t.slice(int(bounds[-1]))
    if held:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def _within(line: np.ndarray, vs: np.ndarray, ve: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many later lines of its run overlap each line, and the first of them; the lines of a run are in order. PAIRS pairs are compared at a time."""
    n = len(line)
    behind = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n) - 1
    ends = np.cumsum(behind)
    count, following = np.zeros(n, np.int64), np.full(n, _NONE)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        size = behind[at:to]
        i = np.repeat(np.arange(at, to), size)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
        meet = (line[j] > line[i]) & (vs[j] <= ve[i]) & (vs[i] <= ve[j])
        of, first = np.unique(i[meet], return_index=True)
        count[at:to] = np.bincount(i[meet] - at, minlength=to - at)
        following[of] = line[j[meet][first]]
        at = to
    return count, following


def _widened(x: np.ndarray, size: int, between: int) -> np.ndarray:
    """Sums by verse for more verses; the last place, which stands for whole chapters, stays the last."""
    return np.concatenate([x[:-1], np.full(size - len(x), between, np.int64), x[-1:]])


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of x[lo..hi], both included, for each pair, by minima of powers of two."""
    levels = [x]
    while 2 * (1 << len(levels) - 1) <= len(x):
        last, step = levels[-1], 1 << len(levels) - 1
        levels.append(np.minimum(last[:-step], last[step:]))
    k = np.frexp((hi - lo + 1).astype(float))[1] - 1
    out = np.empty(len(lo), np.int64)
    for level in np.unique(k).tolist():
        of = k == level
        out[of] = np.minimum(levels[level][lo[of]], levels[level][hi[of] - (1 << level) + 1])
    return out


def _record(keys: pa.Table, names: list[str], made: list[pa.Array]) -> pa.RecordBatch:
    """The key columns of rows with further ones, as one batch."""
    t = keys.combine_chunks()
    return pa.RecordBatch.from_arrays([*(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns), *made], names=[*t.column_names, *names])


def later_overlaps(refs: DataFrame, by: str, order: str, block: int = BLOCK) -> DataFrame:
    """(by, book, chapter, order, later, next) of refs (by, order and a reference): how many references of the same `by` that come after overlap
    each one, and the order of the first, null if there is none. Rows of equal order are not after each other.

    Nothing is paired across blocks: lines are dealt to blocks by their order (whole numbers from 0, best without gaps). Lines of one block and chapter are compared
    with each other, those of many chapters at once. Where a chapter has several blocks, each is summed up by verse: how many
    start and end there and which line covers it first. Sums over all later blocks then give a line's further count as all later ones less those
    that end before it and those that start behind it. So a chapter with very many lines spreads over blocks, and what meets in one place is
    a row of sums for each block. Rows with a null `by`, order, book or chapter have no partner and are left out.
    """
    key = [by, "book", "chapter"]
    rows = refs.withColumn("_order", F.col(order).cast("bigint")).withColumn("_block", F.floor(F.col("_order") / block))
    usable = F.lit(True)
    for c in [*key, "_order"]:
        usable = usable & F.col(c).isNotNull()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    keyed = ", ".join(f"`{c}` {kinds[c]}" for c in key)
    # Lines of equal order stay in the order of their rows.
    least = kept_table(rows.filter(usable).select(*key, "_block", "_order", F.monotonically_increasing_id().alias("_row"), "vs", "ve"), "lines")
    # Sums travel as bytes: Spark's Arrow writer passes over all null arrays of a batch again for each row.
    packed = lambda *x: np.stack(x).astype("<i8").tobytes()
    unpacked = lambda x: np.frombuffer(x, "<i8").reshape(3, -1)  # noqa: E731  starts, ends and first

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _whole_runs(batches, [*key, "_block"]):
            line, vs, ve = _ends(t)
            sums = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                s, e = vs[lo:hi], ve[lo:hi]
                size = int(max(s.max(), np.where(e == _WHOLE, 0, e).max())) + 2
                e = np.minimum(e, size - 1)  # the last place stands for whole chapters
                first = np.full(size, _NONE)
                for i in range(hi - lo - 1, -1, -1):
                    first[s[i] : e[i] + 1] = line[lo + i]
                sums.append(packed(np.bincount(s, minlength=size), np.bincount(e, minlength=size), first))
            yield _record(t.take(pa.array(bounds[:-1])).select([*key, "_block"]), ["n", "sums"], [pa.array(np.diff(bounds)), pa.array(sums, pa.binary())])

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block the sums over all later ones, which come before it: how many there are, end before and start behind each verse, and the first that covers it."""
        of, n, starts, ends, first = None, 0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, _NONE)
        for b in batches:
            counts, sums = [], []
            for k, m, more in zip(zip(*(b.column(c).to_pylist() for c in key)), b.column("n").to_pylist(), b.column("sums").to_pylist()):
                if k != of:
                    of, n, starts, ends, first = k, 0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, _NONE)
                counts.append(n)
                sums.append(packed(starts.sum() - np.cumsum(starts), np.cumsum(ends) - ends, first))
                s, e, f = unpacked(more)
                size = max(len(s), len(starts))
                n += m
                starts = _widened(starts, size, 0) + _widened(s, size, 0)
                ends = _widened(ends, size, 0) + _widened(e, size, 0)
                first = np.minimum(_widened(first, size, first[-1]), _widened(f, size, f[-1]))
            yield _record(pa.Table.from_batches([b]).select([*key, "_block"]), ["n", "sums"], [pa.array(counts, pa.int64()), pa.array(sums, pa.binary())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _whole_runs(batches, [*key, "_block"]):
            is_line = t.column("n").is_null().to_numpy()
            lines = t.filter(pa.array(is_line)).combine_chunks()
            places = np.concatenate([[0], np.cumsum(is_line)])[bounds]
            line, vs, ve = _ends(lines)
            count, following = _within(line, vs, ve, places)
            for at in np.flatnonzero(~is_line[bounds[:-1]]).tolist():  # a run's sums come first
                lo, hi = int(places[at]), int(places[at + 1])
                n = t.column("n")[int(bounds[at])].as_py()
                starts, ends, first = unpacked(t.column("sums")[int(bounds[at])].as_py())
                top = len(starts) - 1
                a, z = np.minimum(vs[lo:hi], top), np.minimum(ve[lo:hi], top)
                count[lo:hi] += n - ends[a] - np.where(ve[lo:hi] >= top, 0, starts[z])
                following[lo:hi] = np.minimum(following[lo:hi], _range_min(first, a, z))
            yield _record(lines.select([*key, "_order"]), ["later", "next"], [pa.array(count), pa.array(following, mask=count == 0)])

    several = kept_table(least.groupBy(*key).agg(F.min("_block").alias("a"), F.max("_block").alias("z")).filter("a < z").select(*key), "long-chapters")
    place = [*key, "_block"]
    met = least.withColumn("n", F.lit(None).cast("bigint")).withColumn("sums", F.lit(None).cast("binary"))
    if several.head(1):
        long = least.join(several, key, "left_semi").repartition(*place).sortWithinPartitions(*place, "_order", "_row")
        blocks = long.mapInArrow(summed, f"{keyed}, _block bigint, n bigint, sums binary")
        later = blocks.repartition(*key).sortWithinPartitions(*key, F.desc("_block")).mapInArrow(carried, f"{keyed}, _block bigint, n bigint, sums binary").filter("n > 0")
        met = met.unionByName(later.withColumns({c: F.lit(None).cast("bigint") for c in ("_order", "_row")} | {c: F.lit(None).cast(kinds[c]) for c in ("vs", "ve")}))
    found = met.repartition(*place).sortWithinPartitions(*place, F.asc_nulls_first("_order"), "_row").mapInArrow(counted, f"{keyed}, _order bigint, later bigint, next bigint")
    return found.select(by, "book", "chapter", F.col("_order").alias(order), "later", "next")
