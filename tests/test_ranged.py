"""Ranges of files: digests, heads, trees, and a damaged byte of a file of 3 GB."""

import hashlib
import resource

import pytest
from pyspark.sql import functions as F

from tillage.sources import ranged


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "files"
    (root / "sub").mkdir(parents=True)
    data = {"a.bin": bytes(range(256)) * 10, "empty": b"", "sub/model.gguf": b"GGUF" + b"\0" * 28, "short": b"GG", "b": b"xyz" * 33}
    for name, b in data.items():
        (root / name).write_bytes(b)
    (root / ".hidden").write_bytes(b"no")
    return root, data


def test_ranges_and_whole_files(spark, folder):
    root, data = folder
    name = lambda p: p[len(str(root)) + 1 :]
    got = {(name(r.path), r.start): (r.size, r.length, r.sha256) for r in ranged.chunk_digests(spark, str(root), 100).collect()}
    want = {(n, s): (len(b), len(b[s : s + 100]), sha(b[s : s + 100])) for n, b in data.items() for s in range(0, max(1, len(b)), 100)}
    assert got == want
    assert {name(r.path): (r.bytes, r.sha256) for r in ranged.whole_digests(spark, f"file:{root}").collect()} == {n: (len(b), sha(b)) for n, b in data.items()}
    bytes_back = ranged._load(spark, str(root / "a.bin"), rangeBytes=1000, content="true").orderBy("start").collect()
    assert b"".join(bytes(r.content) for r in bytes_back) == data["a.bin"]
    parts = ranged._Reader({"path": str(root), "rangebytes": "100"}).partitions()
    assert max(sum(x[3] for x in p.items) for p in parts) <= 100 and len(parts) < len(want)
    assert ranged.chunk_digests(spark, str(root / "none")).count() == 0


def test_heads_read_no_further(spark, folder, monkeypatch):
    root, data = folder
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.status) for r in ranged.checked_heads(ranged.heads(spark, str(root)), b"GGUF", 30).collect()}
    assert got == {"a.bin": (2560, "kind"), "empty": (0, "small"), "model.gguf": (32, "ok"), "short": (2, "small"), "b": (99, "kind")}
    reader = ranged._Reader({"path": str(root), "firstbytes": "4", "content": "true", "whole": "true"})
    assert {i[0].rsplit("/", 1)[1]: i[3] for p in reader.partitions() for i in p.items} == {n.rsplit("/", 1)[-1]: min(4, len(b)) for n, b in data.items()}


@pytest.mark.parametrize("fan", [2, 3, 1024])
def test_roots(spark, folder, fan):
    root, data = folder

    def plain(b):
        level = [sha(b[s : s + 100]) for s in range(0, max(1, len(b)), 100)]
        while len(level) > 1:
            level = [sha("".join(level[i : i + fan]).encode()) for i in range(0, len(level), fan)]
        return level[0]

    got = {r.path[len(str(root)) + 1 :]: (r.bytes, r.root) for r in ranged.roots(ranged.chunk_digests(spark, str(root), 100), fan).collect()}
    assert got == {n: (len(b), plain(b)) for n, b in data.items()}


def test_a_damaged_byte_of_a_large_file_is_found(spark, tmp_path):
    """A sparse file of 3 GB: more than a row of Spark's binary source can hold."""
    folder = tmp_path / "big"
    folder.mkdir()
    big, size = folder / "big.bin", 3 << 30
    with open(big, "wb") as f:
        f.truncate(size)
    (folder / "small").write_bytes(b"s")
    manifest = ranged.chunk_digests(spark, str(folder)).toPandas()
    assert len(manifest) == 49
    before = spark.createDataFrame(manifest)
    with open(big, "r+b") as f:
        f.seek(size - (64 << 20) - 1)
        f.write(b"\1")
    now = ranged.chunk_digests(spark, str(folder))
    wrong = ranged.verify_chunks(before, now).filter("status <> 'ok'").collect()
    assert [(r.start, r.length, r.status) for r in wrong] == [(size - (128 << 20), 64 << 20, "corrupt")]
    (folder / "small").unlink()
    (folder / "new").write_bytes(b"n")
    with open(big, "ab") as f:
        f.write(b"tail")
    status = {(r.path.rsplit("/", 1)[1], r.status): r["count"] for r in ranged.verify_chunks(before, ranged.chunk_digests(spark, str(folder))).groupBy("path", "status").count().collect()}
    assert status == {("big.bin", "size"): 49, ("small", "missing"): 1, ("new", "extra"): 1}
    # The reader itself holds a piece at a time.
    reader = ranged._Reader({"path": str(big)})
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert sum(r[3] for p in reader.partitions()[:8] for r in reader.read(p)) == 8 * (64 << 20)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - peak < 32 * 1024
    assert ranged.heads(spark, str(big)).select(F.length("head")).first()[0] == 16
