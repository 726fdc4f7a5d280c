"""The stall guard as a stream: for each key, cycles whose outcome repeats, with timers for keys that fall silent.

A cycle leaves a signature (what is still to do, what failed). A key that shows the same signature again has made no
progress; after some such cycles running it should stop. The state of a key is one small row, so it doesn't grow with the cycles, and
Spark keeps it in its checkpoint: after a restart the count goes on where it was. `operators.state.stalls` is the same over a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType, TimestampType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAST = "signature string, at bigint, tie bigint, stalled int, cycles bigint"


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Streams with arbitrary state need this store; what the session had set comes back after a stream's start."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


class _Guard(StatefulProcessor):
    def __init__(self, columns: list[str], order: str, tie: str | None, repeats: int, exempt: str | None, quiet_ms: int | None) -> None:
        self.columns, self.order, self.tie = columns, order, tie
        self.repeats, self.exempt, self.quiet_ms = repeats, exempt, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST)

    def _whole(self, v: pd.Series) -> np.ndarray:
        return v.to_numpy().astype("datetime64[us]").astype(np.int64) if v.dtype.kind == "M" else v.to_numpy().astype(np.int64)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        got = pd.concat(found, ignore_index=True) if len(found := list(rows)) > 1 else found[0]
        got.columns = [*self.columns, *([self.exempt] if self.exempt else [])]  # computed columns come without their names
        known = self.last.get()  # none for a new key
        signature, at, tie, stalled, cycles = known or (None, None, None, 0, 0)
        ats, ties = self._whole(got[self.order]), self._whole(got[self.tie]) if self.tie else np.zeros(len(got), np.int64)
        order = np.lexsort((ties, ats))
        ats, ties = ats[order], ties[order]
        # A cycle that comes after a later one can't be judged any more, nor can one at the place of another.
        kept = np.ones(len(order), bool)
        kept[1:] = (ats[1:] != ats[:-1]) | (ties[1:] != ties[:-1])
        if at is not None:
            kept &= (ats > at) | ((ats == at) & (ties > tie))
        order = order[kept]
        if not len(order):
            return
        ats, ties, now = ats[kept], ties[kept], got["_signature"].to_numpy(object)[order]
        same = np.empty(len(now), bool)
        same[0] = cycles > 0 and now[0] == signature
        same[1:] = now[1:] == now[:-1]
        counts = same & ~np.fromiter(map(bool, got[self.exempt]), bool, len(got))[order] if self.exempt else same
        running = np.cumsum(counts)
        reset = np.maximum.accumulate(np.where(same, -1, np.arange(len(same))))  # the last cycle that made progress, -1 if none of these did
        running = (running - np.where(reset < 0, -stalled, running[reset])).astype(np.int32)
        last = int(ats[-1])
        self.last.update((now[-1], last, int(ties[-1]), int(running[-1]), cycles + len(now)))
        if self.quiet_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last // 1000 + self.quiet_ms)
        out = {c: got[c].to_numpy()[order] for c in self.columns}
        yield pd.DataFrame(out | {"same": same, "stalled": running, "stop": running >= self.repeats, "quiet": False})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            _, at, _, stalled, _ = self.last.get()
            row = dict.fromkeys(self.columns) | {self.columns[0]: key[0], self.order: pd.Timestamp(at, unit="us")}
            yield pd.DataFrame([{**row, "same": False, "stalled": stalled, "stop": stalled >= self.repeats, "quiet": True}])

    def close(self) -> None:
        pass


def stall_stream(
    cycles: DataFrame, key: str, order: str, signature: list[str], tie: str | None = None, repeats: int = 2, exempt: str | None = None, quiet_seconds: int | None = None
) -> DataFrame:
    """A stream of cycles with `same` (equal to the key's cycle before), `stalled` (such cycles running) and `stop` (stalled >= repeats).

    A key's cycles are ordered by order (a timestamp or whole number), then tie (a whole number), across batches; one that comes after a
    later one was judged is left out, and so are rows without key or order. A cycle for which exempt is true repeats without counting.
    The rows that one batch brings for a key are held at once in a task, so the source's own limits (maxFilesPerTrigger) bound the memory.
    With quiet_seconds (order is then a timestamp with a watermark), a key without a cycle for so long gives one row with `quiet` and nulls as its
    signature, once the watermark passes; its count stays.
    """
    places = list(dict.fromkeys([key, order, *([tie] if tie else [])]))
    timed = isinstance(cycles.schema[order].dataType, TimestampType)
    if quiet_seconds is not None and not timed:
        raise ValueError("quiet_seconds needs a timestamp to order by")
    # The signature is one JSON value from here on, so that no value changes on its way through pandas.
    kinds = StructType([cycles.schema[c] for c in signature])
    packed = F.to_json(F.struct(*signature), {"ignoreNullFields": "false"}).alias("_signature")
    rows = cycles.filter(F.col(key).isNotNull() & F.col(order).isNotNull())
    rows = rows.select(*places, packed, *([F.col(exempt).alias("_exempt")] if exempt else []))
    made = [StructField("_signature", StringType()), StructField("same", BooleanType()), StructField("stalled", IntegerType()), StructField("stop", BooleanType()), StructField("quiet", BooleanType())]
    schema = StructType([StructField(c, cycles.schema[c].dataType) for c in places] + made)
    guard = _Guard([*places, "_signature"], order, tie, repeats, "_exempt" if exempt else None, None if quiet_seconds is None else quiet_seconds * 1000)
    judged = rows.groupBy(key).transformWithStateInPandas(guard, outputStructType=schema, outputMode="Append", timeMode="None" if quiet_seconds is None else "EventTime")
    back = F.from_json("_signature", kinds)
    return judged.select(*places, *[back[c].alias(c) for c in signature if c not in places], "same", "stalled", "stop", "quiet")
