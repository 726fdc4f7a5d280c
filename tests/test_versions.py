"""Versions of the passage store: writers that meet, readers in between, and what vacuum removes."""

import threading

import pytest

from tillage.sources.store import PassageStore

CHUNK = "id string, text string, source_id string, collection string"


def chunks(spark, *rows):
    return spark.createDataFrame(list(rows), CHUNK)


def vectors(spark, *ids):
    return spark.createDataFrame([(i, [1.0]) for i in ids], "id string, vector array<float>")


def put(spark, store, *rows, add=False):
    return (store.add if add else store.put)(chunks(spark, *rows), vectors(spark, *[r[0] for r in rows]))


def ids(store, version=None):
    return sorted(r.id for r in store.table(version).select("id").collect())


def test_the_writer_that_loses_starts_again(spark, tmp_path, monkeypatch):
    mine, other = PassageStore(spark, str(tmp_path / "t")), PassageStore(spark, str(tmp_path / "t"))
    put(spark, mine, ("1", "x", "a", "talks"), ("2", "x", "b", "talks"), ("3", "x", "a", "odd name/=%"), ("0", "x", "a", None))
    real, seen = mine.versions.commit, []

    def late(base, folders):
        if not seen:
            put(spark, other, ("4", "x", "c", "talks"), ("5", "x", "a", "talks"), add=True)
        seen.append((base, ids(mine)))
        return real(base, folders)

    monkeypatch.setattr(mine.versions, "commit", late)
    assert put(spark, mine, ("6", "new", "a", "beliefs")) == 3
    assert [b for b, _ in seen] == [1, 2] and ids(mine) == ["2", "4", "6"]
    # In between, all of the other's change was there and nothing of mine.
    assert seen[0][1] == seen[1][1] == ["0", "1", "2", "3", "4", "5"]
    assert ids(mine, 1) == ["0", "1", "2", "3"] and ids(mine, 2) == ["0", "1", "2", "3", "4", "5"]


def test_many_writers_at_once(spark, tmp_path):
    store, errors = PassageStore(spark, str(tmp_path / "t")), []

    def write(k):
        try:
            for i in range(2):
                put(spark, PassageStore(spark, str(tmp_path / "t")), (f"{k}-{i}", "x", f"s{k}", "talks"), add=True)
        except Exception as e:  # pragma: no cover
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and store.versions.newest() == 8
    assert ids(store) == sorted(f"{k}-{i}" for k in range(4) for i in range(2))
    assert [len(ids(store, v)) for v in store.versions.numbers()] == list(range(1, 9))


def test_pinned_reader_and_vacuum(spark, tmp_path):
    store = PassageStore(spark, str(tmp_path / "t"))
    assert store.table().count() == 0 and store.versions.newest() == 0
    for n in range(6):
        put(spark, store, ("1", f"text {n}", "a", "talks"), (f"k{n}", "x", f"s{n}", "beliefs"))
    held = store.table(5)
    store.versions.vacuum(keep=3, older_seconds=0)
    assert store.versions.numbers() == [4, 5, 6] and [r.text for r in held.filter("id = '1'").collect()] == ["text 4"] and len(ids(store)) == 7
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        store.table(1)
    store.versions.vacuum(keep=1, older_seconds=3600)  # folders that may be some writer's stay
    assert ids(store) == sorted(["1", *(f"k{n}" for n in range(6))])
    store.versions.vacuum(keep=1, older_seconds=0)
    assert ids(store) == sorted(["1", *(f"k{n}" for n in range(6))]) and len(list((tmp_path / "t" / "data").glob("run=*/collection=talks"))) == 1
    assert not [f for f in (tmp_path / "t" / "versions").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]


def test_replacing_what_is_not_there_and_null_sources(spark, tmp_path):
    store = PassageStore(spark, str(tmp_path / "t"))
    gone = spark.createDataFrame([("z",), (None,)], "source_id string")
    store.replace_sources(gone)
    put(spark, store, ("1", "x", None, "talks"), ("2", "x", "z", "talks"), add=True)
    store.replace_sources(gone)
    assert ids(store) == ["1"]
    store.replace_sources(spark.createDataFrame([("z",)], "source_id string"))
    assert ids(store) == ["1"] and store.scan("talks").count() == 1 and store.scan("none").count() == 0
