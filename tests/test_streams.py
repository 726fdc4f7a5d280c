"""Streams: logs that are appended to, versions and their runs."""

import json
import random

import pytest

from tillage.sources import appended
from tillage.sources.logs import read_log
from tillage.streaming import logs

SCHEMA = "id string, step string, n int"


def table(spark, target, **more):
    rows = logs.latest_table(spark, target, logs.log_schema(SCHEMA), "id", "seq", **more).collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: (r.step, r.n) for r in rows}


def replay(spark, path):
    from tillage.operators.state import latest_per_key

    return {r.id: (r.step, r.n) for r in latest_per_key(read_log(spark, path, SCHEMA, "id"), "id", "seq").collect()}


def test_half_a_line_waits_for_its_rest(spark, tmp_path):
    log, target, checkpoint = tmp_path / "jobs.jsonl", str(tmp_path / "t"), str(tmp_path / "c")

    def go(text):
        with open(log, "ab") as f:
            f.write(text.encode())
        logs.follow_appended(spark, str(log), SCHEMA, "id", target, checkpoint).awaitTermination()
        return table(spark, target)

    assert go('{"id":"a","step":"x","n":1}\r\n{"id":"b","step":"é') == {"a": ("x", 1)}
    assert go('","n":2}') == {"a": ("x", 1)}
    assert go('\n\nnot json\n{"step":"keyless"}\n{"id":"a","st') == {"a": ("x", 1), "b": ("é", 2)}
    assert go('ep":"y","n":3,"other":1}\n') == {"a": ("y", 3), "b": ("é", 2)} == replay(spark, str(log))
    before = logs.versions(spark, target)
    assert go("") == {"a": ("y", 3), "b": ("é", 2)} and logs.versions(spark, target) == before
    log.write_text("")
    with pytest.raises(Exception, match="shrunk|shorter"):
        go("")


def test_appends_at_random_places_equal_a_replay(spark, tmp_path):
    """A folder of two logs, cut anywhere, read in blocks of a few bytes; each line once, and after each step the table of a replay."""
    rng = random.Random(6)
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / ".hidden").write_text('{"id":"h","step":"no","n":0}\n')
    data = {name: "".join(json.dumps({"id": f"k{rng.randrange(9)}", "step": "s" * rng.randrange(30), "n": i}) + "\n" for i in range(80)).encode() for name in ("a", "b")}
    at = dict.fromkeys(data, 0)
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    while any(at[n] < len(d) for n, d in data.items()):
        for name, d in data.items():
            to = min(len(d), at[name] + rng.randrange(1, 1500))
            with open(folder / name, "ab") as f:
                f.write(d[at[name] : to])
            at[name] = to
        logs.follow_appended(spark, str(folder), SCHEMA, "id", target, checkpoint, block_bytes=97, fan=2, keep=2).awaitTermination()
        whole = {n: d[: d[: at[n]].rfind(b"\n") + 1].decode() for n, d in data.items()}
        want = {r["id"]: (r["step"], r["n"]) for n in sorted(whole) for r in map(json.loads, whole[n].splitlines())}
        assert table(spark, target, fan=2) == want
    appended.register(spark)
    lines = spark.read.format("appended_log").option("blockBytes", 61).load(str(folder)).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.value) for r in lines) == sorted((n, x) for n, d in data.items() for x in d.decode().splitlines())
    assert all(data[r.file.rsplit("/", 1)[1]][r.start :].decode().startswith(r.value + "\n") for r in lines)
    assert table(spark, target, fan=2) == replay(spark, str(folder))


def test_lines_longer_than_a_chunk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(appended, "CHUNK", 7)
    log = tmp_path / "l"
    log.write_bytes(b"x" * 40 + b"\n\n" + b"y" * 9 + b"\nlast")
    read = appended._Batch({"path": f"file:{log}", "blockbytes": "5"})
    got = [tuple(r) for p in read.partitions() for b in read.read(p) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert [(v, s) for v, _, s in got] == [("x" * 40, 0), ("", 41), ("y" * 9, 42)]
    appended.register(spark)
    assert spark.read.format("appended_log").load(str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_versions_have_few_runs(fan):
    for n in range(1, 1001):
        runs = logs.runs_of(n, fan)
        assert [a for a, _ in runs] == [1, *(b + 1 for _, b in runs[:-1])] and runs[-1][1] == n
        assert len(runs) <= (fan - 1) * 10
        first = runs[-1][0]
        assert runs[:-1] == [r for r in logs.runs_of(n - 1, fan) if r[0] < first]  # one run is new, others are those before


def test_old_runs_go_and_a_pinned_version_stays(spark, tmp_path):
    target, schema = str(tmp_path / "t"), logs.log_schema(SCHEMA)
    fold, held = logs._fold(spark, target, schema, "id", "seq", 3, 4), None
    for batch in range(31):
        rows = spark.createDataFrame([(f"k{batch % 7}", "x", batch, ("f", batch)), (f"own{batch}", "x", batch, ("f", batch))], schema).coalesce(1)
        fold(rows, batch)
        if batch in (10, 30):
            fold(rows, batch)  # a batch that runs again
        want = {f"k{i % 7}": ("x", i) for i in range(batch + 1)} | {f"own{i}": ("x", i) for i in range(batch + 1)}
        if batch % 10 == 9 or batch > 28:
            assert table(spark, target, fan=3) == want
            assert table(spark, target, fan=3, version=batch) == {k: v for k, v in want.items() if v[1] < batch} | {k: ("x", i) for k, i in ((f"k{j % 7}", j) for j in range(max(0, batch - 7), batch))}
        if batch == 26:
            held = logs.latest_table(spark, target, schema, "id", "seq", fan=3)
    assert {r.n for r in held.collect()} == set(range(27)) and len(logs._folders(spark, target)[1]) <= 2 * 4 + 4 + 1
    unfinished = tmp_path / "t" / "run=32-32"
    unfinished.mkdir()
    assert max(logs.versions(spark, target, 3)) == 31
