"""Periodic runs of words: passages that repeat three times or more in a row.

The words of a text become numbers, and the array of numbers is compared with itself shifted by every lag up to
n / min_exponent. A stretch of equal places of length m at lag p is a run of m + p words with period p; it counts if it is
long enough. A run whose smallest period is q shows at every multiple of q with the same bounds, so of equal bounds the
smallest lag stays.

A stretch that counts holds at least need = (min_exponent - 1) * p equal places, so it holds a place divisible by need. Whole
blocks of lags are compared at these places first, which is n / need comparisons a lag instead of n; a lag is compared in full only
where such a place lies in a long enough stretch that no run found already explains. Nothing is missed by that.

Long texts are dealt to tasks by ranges of lags: their numbers are sent once for each part, parts grow with the text, and the
runs of all parts meet again by the text's digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import written

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: Lags that are compared at a time.
BLOCK = 64
#: A text of more characters is dealt to several tasks, one for each so many.
PART_CHARS = 1 << 20
#: Words that tell whether a place lies in a stretch worth a full comparison.
REACH = 15

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_list(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


class _Scan:
    """Compares one array of word numbers with its shifts and gathers runs as (start, length) -> smallest lag."""

    def __init__(self, ids: np.ndarray, min_length: int, min_exponent: int) -> None:
        self.ids, self.n = ids, len(ids)
        self.last = self.n // min_exponent
        self.padded = np.concatenate([ids, np.full(self.last + BLOCK + REACH + 1, -1, np.int32)])
        self.min_length, self.min_exponent = min_length, min_exponent
        self.runs: dict[tuple[int, int], int] = {}
        self.covered: tuple[np.ndarray, np.ndarray] | None = None

    def need(self, lags: np.ndarray) -> np.ndarray:
        """Equal places that a run of each lag has at least."""
        return np.maximum(np.maximum(self.min_length - lags, (self.min_exponent - 1) * lags), 1)

    def _reach(self, lag: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        """Equal places next to at in one direction, up to REACH."""
        alive, count = np.ones(len(at), bool), np.zeros(len(at), np.int64)
        for o in range(1, REACH + 1):
            p = at + step * o
            alive &= (p >= 0) & (self.padded[p] == self.padded[p + lag])
            if not alive.any():
                break
            count += alive
        return count

    def block(self, lo: int, hi: int) -> None:
        """All lags from lo to hi, both included."""
        lags = np.arange(lo, hi + 1)
        need = self.need(lags)
        grid = np.arange(0, self.n - lo, need.min())
        row, col = np.nonzero(self.padded[grid[None, :] + lags[:, None]] == self.ids[grid][None, :])
        lag, at = lags[row], grid[col]
        if len(lag) and self.covered:
            period, end = (c[at] for c in self.covered)
            new = (period == 0) | (lag % np.maximum(period, 1) != 0) | (at + lag >= end)
            lag, at = lag[new], at[new]
        if not len(lag):
            return
        whole = np.minimum(self.need(lag), REACH + 1)
        after = self._reach(lag, at, 1)
        some = after + REACH + 1 >= whole
        lag, at, whole, after = lag[some], at[some], whole[some], after[some]
        for p in np.unique(lag[after + self._reach(lag, at, -1) + 1 >= whole]).tolist():
            self._full(p)

    def _full(self, p: int) -> None:
        equal = np.zeros(self.n - p + 2, np.int8)
        equal[1:-1] = self.ids[: self.n - p] == self.ids[p:]
        edges = np.flatnonzero(np.diff(equal))
        start, length = edges[::2], edges[1::2] - edges[::2]
        long = length >= self.need(np.array([p]))[0]
        for s, m in zip(start[long].tolist(), length[long].tolist()):
            if self.runs.setdefault((s, m + p), p) < p:
                continue
            self.runs[s, m + p] = p
            if self.covered is None:
                self.covered = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
            period, end = (c[s : s + m + p] for c in self.covered)
            free = period == 0
            period[free], end[free] = p, s + m + p

    def part(self, part: int, parts: int) -> None:
        """The blocks of lags that fall to one of several parts. Each part starts with the smallest lags, which explain the most."""
        for k, lo in enumerate(range(1, self.last + 1, BLOCK)):
            if k == 0 or k % parts == part:
                self.block(lo, min(lo + BLOCK - 1, self.last))


def runs_of(ids: np.ndarray, part: int = 0, parts: int = 1, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run found by one part of the lags, by start, then period."""
    scan = _Scan(ids, min_length, min_exponent)
    if len(ids) >= min_length:
        scan.part(part, parts)
    return sorted(((s, length, p) for (s, length), p in scan.runs.items()), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by one space, without those that a run holds after its first period."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _run_column(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    return pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], _RUN_TYPE)


def _merged(several: list[list[dict]]) -> list[tuple[int, int, int]]:
    best: dict[tuple[int, int], int] = {}
    for runs in several:
        for r in runs:
            at = r["start"], r["length"]
            best[at] = min(best.get(at, r["period"]), r["period"])
    return sorted(((s, length, p) for (s, length), p in best.items()), key=lambda r: (r[0], r[2]))


def _long_runs(texts: DataFrame, part_chars: int, min_length: int, min_exponent: int) -> DataFrame:
    """(_same, found): the runs of each of the distinct long texts, in lists of several parts."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [word_ids(word_list(t)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.large_binary()).cast(pa.binary()), b.column(2)], names=["_same", "ids", "parts"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for same, ids, parts, part in zip(*(b.column(c).to_pylist() for c in range(4))):
                runs = runs_of(np.frombuffer(ids, np.int32), part, parts, min_length, min_exponent)
                yield pa.RecordBatch.from_arrays([pa.array([same]), _run_column([runs])], names=["_same", "runs"])

    parts = F.ceil(F.length("_text") / F.lit(part_chars)).cast("int")
    once = texts.groupBy("_same").agg(F.first("_text").alias("_text")).select("_same", "_text", parts.alias("parts"))
    dealt = once.mapInArrow(numbers, "_same string, ids binary, parts int").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = dealt.repartition(F.col("_same"), F.col("part")).mapInArrow(search, f"_same string, runs {RUNS}")
    return found.groupBy("_same").agg(F.collect_list("runs").alias("found"))


def find_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, runs, collapsed) for each row of docs.

    runs: start, length and period, in words, of every stretch of at least min_length words and min_exponent smallest
    periods that can't be extended, by start, then period. Runs may overlap. collapsed: the words joined by one space, without those
    that a run holds after its first period. Words are runs of anything but ASCII white space. Null and empty texts have no run
    and collapse to an empty text; a null doc_id is kept; repeated rows give equal rows; other columns are ignored; an empty table
    gives an empty result. A text of n words takes about 30 bytes a word in its task, and no text is cut.
    """
    rows = docs.select("doc_id", F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    long = F.coalesce(F.length("_text") > part_chars, F.lit(False))
    schema = f"doc_id {kind}, runs {RUNS}, collapsed string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, kept = [], []
            for t in b.column(1):
                words = word_list(t.as_py())
                found.append(runs_of(word_ids(words), 0, 1, min_length, min_exponent))
                kept.append(collapse(words, found[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), _run_column(found), pa.array(kept, pa.string())], names=["doc_id", "runs", "collapsed"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                runs = _merged(b.column(2)[i].as_py() or [])
                kept = collapse(word_list(b.column(1)[i].as_py()), runs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), _run_column([runs]), pa.array([kept], pa.string())], names=["doc_id", "runs", "collapsed"])

    short = rows.filter(~long).mapInArrow(whole, schema)
    far = rows.filter(long).withColumn("_same", F.sha2("_text", 256))
    found = written(_long_runs(far, part_chars, min_length, min_exponent), "long-runs")
    far = far.join(found, "_same").select("doc_id", "_text", "found").mapInArrow(joined, schema)
    return short.unionByName(far)


def planted(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text): docs with a repeat written into each tenth of them, as op11 asks for.

    Let h be the CRC-32 of doc_id in decimal, g = floor(h / 10) and n the number of words. If h % 10 = 0 and n > 0, each word
    i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)); words are joined by one space then. Texts of a null
    doc_id and null texts stay as they are.
    """
    let = lambda value, use: F.get(F.transform(F.array(value), use), 0)  # noqa: E731  (value is worked out once, not in each place of use)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        at = lambda s, i: F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"])
        first = g % F.size(w)
        period = 1 + F.floor((F.size(w) - first) / (3 + g % 8))
        numbers = F.struct(first.alias("a"), period.alias("p"))
        return let(numbers, lambda s: F.array_join(F.transform(w, lambda _, i: F.get(w, at(s, i).cast("int"))), " "))

    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    written_in = let(words, lambda w: F.when(F.size(w) > 0, repeated(w)))
    return docs.select("doc_id", F.coalesce(F.when(h % 10 == 0, written_in), F.col(text)).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """The columns of op11 from find_runs' rows: the number of runs, the run of the greatest exponent, and digests."""
    first = F.aggregate(
        "runs",
        F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best: Column = F.col("best")
    return found.withColumn("best", first).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def run_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """op11's rows: find_runs over the texts of docs after `planted`. Nulls, repeats and empty tables are as in find_runs."""
    return run_digest(find_runs(planted(docs, text)))
