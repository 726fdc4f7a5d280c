"""Source mixing and licence scans against plain restatements."""

import re

import pytest
from pyspark.sql import functions as F

from tillage.llm import licenses, mixing

TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if rest * w[s] / total >= most * sizes[s]]
        if not over:
            out |= {s: rest * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(most * sizes[s])
        rest -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def mixed(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("target", F.lit("clash")).repartition(3)
    return mixing.mix(df, **options).collect()


def test_mix(spark):
    rows = [(i, ("a", "b", "É", None, "tiny", "Z")[min(i % 9, 5)], "w " * (i * 37 % 90 + 1)) for i in range(900)]
    rows += [(9000, "a", None), (9001, "a", " \n"), (None, "b", "x y"), (None, "b", "x y"), (5, "b", "again b"), (9002, "b", "long " * 20000), (9003, "empty", "")]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    src = {}
    for d, s, t in rows:
        src.setdefault(s, 0)
        src[s] += len((t or "").split())
    want = targets(src)
    by_target = {}
    for r in got:
        assert r["size"] * len(r.shards) == r.taken and r.taken <= 3 * r["size"]
        by_target.setdefault((r.source_size, round(r.target, 6)), []).append(r)
    for s, t in want.items():
        rs = by_target[src[s], round(t, 6)]
        assert sum(r["size"] for r in rs) == src[s]
        assert abs(sum(r.taken for r in rs) - t) <= max(60, 0.02 * t), (s, t)
    shards = [0] * mixing.SHARDS
    for r in got:
        for x in r.shards:
            shards[x] += 1
    assert max(shards) < 2.5 * (sum(shards) / len(shards))
    key = lambda rs: sorted((r.doc_id or -1, r["size"], tuple(r.shards)) for r in rs)
    assert key(mixed(spark, rows[::-1])) == key(got)


def test_mix_documents(spark):
    rows = [(i, "ab"[i % 2], "w " * (i % 20 + 1), i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, shards long")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    want = {r.doc_id: len(r.shards) for r in mixing.mix(df).collect()}
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in want.items() if n}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_layout():
    assert [mixing.shards_for(n) for n in (0, 1, 16 << 23, (16 << 23) + 1, 1 << 60)] == [16, 16, 16, 32, 1 << 37]


@pytest.mark.parametrize("children", [2, 16])
def test_splitting_tree(spark, monkeypatch, children):
    monkeypatch.setattr(mixing, "CHILDREN", children)
    monkeypatch.setattr(mixing, "BIN_ROWS", 7)
    drawn = spark.createDataFrame([(p, i) for p, n in ((0, 40), (1, 3), (2, 17)) for i in range(n)], "place int, seq int")
    got = mixing.shard_quotas(drawn, 8).collect()
    for p, n in ((0, 40), (1, 3), (2, 17)):
        mine = sorted((r.shard, r.first, r.quota) for r in got if r.place == p)
        assert sum(q for _, _, q in mine) == n and [f for _, f, _ in mine] == [sum(q for _, _, q in mine[:i]) for i in range(len(mine))]
    total = [sum(r.quota for r in got if r.shard == s) for s in range(8)]
    assert sum(total) == 60 and max(total) - min(total) <= 3
    with pytest.raises(ValueError):
        mixing.shard_quotas(drawn, 6)


def test_splits_are_hypergeometric(spark):
    """Over many nodes with the same quotas, a child's share of a source has the mean and variance of the distribution."""
    tree = spark.createDataFrame([(node, p, n) for node in range(4000) for p, n in ((0, 12), (1, 8))], "node long, place int, n long")
    got = mixing.split_quotas(tree, 2, 0, 1, 3).filter("place = 0 and node % 2 = 0").collect()
    x = [r.n for r in got] + [0] * (4000 - len(got))
    mean, var = sum(x) / 4000, sum(v * v for v in x) / 4000 - (sum(x) / 4000) ** 2
    assert abs(mean - 6) < 0.08 and abs(var - 10 * 0.6 * 0.4 * 10 / 19) < 0.12


def test_running_sums(spark):
    rows = [(i % 3, (i * 7919) % 97 * (1 << 57) - (1 << 63), i, i % 5) for i in range(300)]
    got = mixing.running(spark.createDataFrame(rows, "g int, h long, id int, v long"), ["g"], "h", ["id"], F.col("v"), 11).collect()
    for r in got:
        assert r._before == sum(v for g, h, i, v in rows if g == r.g and (h, i) < (r.h, r.id))


def test_many_blocks_and_sources(spark):
    """A million drawn blocks of 10,000 sources are planned in well under a minute each."""
    import time

    n = 1 << 20
    blocks = spark.range(n).select((F.col("id") % 10_000).cast("int").alias("place"), F.floor(F.col("id") / 10_000).cast("int").alias("block"), (F.col("id") % 7 + 1).alias("words"))
    sizes = blocks.groupBy("place").agg(F.sum("words").alias("source_size"))
    began = time.time()
    drawn = mixing.written(mixing.drawn_blocks(blocks.join(sizes, "place").withColumn("target", F.col("source_size") * 0.75), bins=n // mixing.BIN_ROWS), "drawn-test")
    wanted = drawn.join(blocks, ["place", "block"]).agg(F.sum(F.coalesce("takes", "words"))).first()[0]
    assert abs(wanted - 0.75 * sizes.agg(F.sum("source_size")).first()[0]) < 1
    quotas = mixing.shard_quotas(drawn, 1 << 10)
    assert quotas.agg(F.sum("quota")).first()[0] == drawn.count() and time.time() - began < 100


def base_of(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TO_LOWER))
    at = []
    for p, label in licenses.PHRASES.items():
        p = p.split()
        at += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at.sort()
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


NOTICES = [
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"), ("This work is licensed under the GNU\nGeneral-Public License; version 3!", "gpl,gpl-3.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"), ("Released under the MIT License.", "mit,mit-release"), ("CC BY 3", "cc-by"), ("the apache licenses, mit licence", ""),
    ("MIT License mit license. Apache License", "apache,mit"), ("Permission is hereby granted, free of charge, to you", "mit-notice"), ("permission granted, hereby is free charge of", ""),
    (None, ""), ("", ""), ("plain é words", ""), ("the of and " * 4000 + "under the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("ſee the gnu general public license version 3", "gpl,gpl-3.0"), ("Redistribution and use in source and binary forms are fine. Licensed under CC BY-NC 4.0", "bsd,cc-by,cc-by-nc-4.0"),
]


def test_licences(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(NOTICES)] + [(3, NOTICES[3][0], "x"), (None, "CC BY 3", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string").repartition(3)
    got = licenses.scan_licences(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.base_labels == "cc-by"
            continue
        text, labels = NOTICES[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(text)
        assert r.labels == labels, text
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert licenses.scan_licences(df.limit(0)).count() == 0


def test_licence_plan_is_native(spark):
    df = spark.createDataFrame([(1, "CC BY 3")], "doc_id long, text string")
    for frame in (licenses.scan_words(df), licenses.scan_licences(df), mixing.mix(df.withColumn("source", F.lit("a")))):
        assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().executedPlan().toString())
