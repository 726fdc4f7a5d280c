"""The stall guard as a stream equals the same over a table, after a restart and with timers."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillage.operators import state
from tillage.streaming import stalls


class Feed:
    """Cycles as files of one stream, which is stopped and started again between them."""

    def __init__(self, spark, tmp_path, schema, **more):
        self.spark, self.root, self.schema, self.more, self.n = spark, tmp_path, schema, more, 0
        (tmp_path / "in").mkdir()

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.root / "in"))

    def go(self, watermark=None):
        cycles = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.root / "in"))
        if watermark:
            cycles = cycles.withWatermark("at", watermark)
        found = stalls.stall_stream(cycles, "k", "at", ["a", "b"], **self.more)
        with stalls.state_in_rocksdb(self.spark):
            sink = found.writeStream.format("parquet").option("path", str(self.root / "out")).option("checkpointLocation", str(self.root / "c"))
            sink.trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.schema(found.schema).parquet(str(self.root / "out"))


def test_stream_equals_table_after_restarts(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", "z", ""]), i, rng.choice([1, 1, 1, 2, None]), rng.choice(["p", None])) for i in range(150)]
    feed = Feed(spark, tmp_path, "k string, at long, a int, b string")
    for at in range(0, 150, 50):
        feed.put(rows[at : at + 20])
        feed.put(rows[at + 20 : at + 50])
        got = feed.go()
    feed.put([(None, 200, 1, "p"), ("x", None, 1, "p"), ("x", 3, 1, "p")])  # no key, no order, too late
    got = feed.go()
    table = spark.createDataFrame(rows, feed.schema).withColumns({"a": F.coalesce("a", F.lit(-1)), "b": F.coalesce("b", F.lit("-"))})
    want = {(r.k, r.at): (r.same, r.stop) for r in state.stalls(table, "a", "b", order="at", group="k").collect()}
    assert {(r.k, r.at): (r.same, r.stop) for r in got.collect()} == want and got.count() == 150 and any(s for _, s in want.values())
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0


def test_exempt_cycles_do_not_count(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k string, at long, a int, b string, sticky boolean", exempt="sticky", repeats=2)
    feed.put([("x", i, 1, "p", i in (2, 3)) for i in range(6)])
    assert [(r.stalled, r.stop) for r in feed.go().orderBy("at").collect()] == [(0, False), (1, False), (1, False), (1, False), (2, True), (3, True)]


def test_a_silent_key_gives_a_row_once(spark, tmp_path):
    at = lambda m: pd.Timestamp(f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00").to_pydatetime()
    feed = Feed(spark, tmp_path, "k string, at timestamp, a int, b string", quiet_seconds=1800)
    for rows in ([("x", 0), ("y", 5)], [("y", 20), ("x", 10)], [("y", 50)], [("y", 75)], [("x", 80), ("y", 100)], [("y", 125)]):
        feed.put([(k, at(m), 1, "p") for k, m in rows])
        got = feed.go("1 minute").collect()
    quiet = [(r.k, r.at, r.a, r.stalled) for r in got if r.quiet]
    assert quiet == [("x", at(10), None, 1)] or sorted(quiet) == [("x", at(10), None, 1), ("x", at(80), None, 2)]
    assert sorted((r.k, r.at, r.stalled) for r in got if not r.quiet)[:3] == [("x", at(0), 0), ("x", at(10), 1), ("x", at(80), 2)]
    with pytest.raises(ValueError):
        stalls.stall_stream(spark.readStream.schema("k string, at long, a int, b string").parquet(str(tmp_path / "in")), "k", "at", ["a"], quiet_seconds=1)


class OneState:
    """A key's state without Spark; a question whether it exists would be one more way to the JVM and back."""

    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_batch_is_judged_as_one_by_one():
    """Repeats, late cycles, ties and exempt ones, in batches of any size, against a loop over single cycles; the state is read once."""
    rng = random.Random(4)
    rows = [(1, i // 2 + rng.randrange(4), rng.randrange(3), rng.choice("aab"), rng.choice([True, False, False, None])) for i in range(150)]
    guard = stalls._Guard(["k", "at", "n", "_signature"], "at", "n", 2, "_exempt", None)
    guard.last, known, got, want, at = OneState(), (None, -1, -1, 0), [], [], 0
    while at < len(rows):
        part = rows[at : at + rng.randrange(1, 12)]
        at += len(part)
        for frame in guard.handleInputRows((1,), iter([pd.DataFrame(part[:3]), pd.DataFrame(part[3:])] if len(part) > 3 else [pd.DataFrame(part)]), None):
            got += frame[["at", "n", "_signature", "same", "stalled", "stop"]].values.tolist()
        for _, t, n, s, exempt in sorted(part, key=lambda r: r[1:3]):
            if (t, n) > known[1:3]:
                same = s == known[0]
                known = (s, t, n, known[3] + (not exempt) if same else 0)
                want.append([t, n, s, same, known[3], known[3] >= 2])
    assert got == want and len(want) > 15
    assert guard.last.value[:4] == (known[0], *known[1:])
