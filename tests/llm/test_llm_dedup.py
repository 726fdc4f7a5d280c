"""Near-duplicates, range joins and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from compare import rows, tables
from pyspark.sql import functions as F

from tillage.llm import queries, rangejoin, simhash
from tillage.llm.components import connected_components


def plain_components(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs + [(5, 5)], "a long, b long")).collect()}
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == plain_components(linked, pairs)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", " \t\n", "One", "one TWO", "a b c", "a b c d", "É é a b c\x1cd", "x y z " * 700):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_near_links_brute(spark):
    """Chains and dense clusters of patterns, below and above the size that is compared pair by pair."""
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    for f in fps[:15]:
        for _ in range(4):
            f ^= 1 << rnd.randrange(64) | 1 << rnd.randrange(64)
            fps.append(f)
    hot = rnd.getrandbits(64)
    fps += [hot ^ (v * 3) for v in range(0, 2000, 5)]  # over 256 in the two low bytes
    fps = sorted(set(fps))
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long, id long"))
    got = {r.node: r.component for r in connected_components(links).collect()}
    x = np.array(fps, np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2, 1))
    want = plain_components(range(len(fps)), near.tolist())
    assert {i: got.get(i, i) for i in range(len(fps))} == want
    for a, b in [(r.a, r.b) for r in links.collect()]:
        assert bin(fps[a] ^ fps[b]).count("1") <= 2


def test_simhash_groups(spark):
    base = " ".join(f"w{i}" for i in range(400))
    docs = [(7, base, "x"), (3, base, "y"), (9, base + " end", "z"), (4, "something else entirely here now", None), (12, "", "s"), (11, None, "s"), (4, "something else entirely here now", None), (None, base, "n"), (None, "alone", "n")]
    df = spark.createDataFrame(docs, "doc_id long, text string, fp string").withColumn("component_id", F.lit("mine"))
    got = simhash.simhash_groups(df).collect()
    named = sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None)
    assert named == [(3, 3), (4, 4), (4, 4), (7, 3), (9, 3), (11, 11), (12, 11)]
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["3", "None"]
    assert {r.fingerprint for r in got if r.doc_id in (11, 12)} == {"0" * 16}
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def brute_vectors(data, cosine=0.93):
    ok = [v is not None and l is not None and i is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, l, v in data]
    pairs, n = [], [0] * len(data)
    for a in range(len(data)):
        for b in range(len(data)):
            if a != b and ok[a] and ok[b] and data[a][1] == data[b][1] and len(data[a][2]) == len(data[b][2]):
                x, y = np.array(data[a][2], float), np.array(data[b][2], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    n[a] += 1
                    pairs.append((data[a][0], data[b][0]))
    c = plain_components([d[0] for d in data if d[0] is not None], pairs)
    return sorted((d[0], n[i], c[d[0]], c[d[0]] == d[0]) for i, d in enumerate(data) if d[0] is not None)


@pytest.mark.parametrize("share,least,block", [(rangejoin.PIVOT_SHARE, rangejoin.LEAST_PIVOTS, rangejoin.BLOCK_ROWS), (1.5, 4, 8), (0.0, 1, 64)])
def test_near_vectors_brute(spark, monkeypatch, share, least, block):
    monkeypatch.setattr(rangejoin, "TASK_ROWS", 20 if share else 20_000)
    monkeypatch.setattr(rangejoin, "TASK_PIVOTS", 1)
    rng = np.random.default_rng(8)
    data = []
    for label in (0, 1):
        for _ in range(8):
            c = rng.normal(0, 1, 6)
            data += [(len(data) + k, label, (c + rng.normal(0, 0.25, 6)).tolist()) for k in range(12)]
    n = len(data)
    data += [(n, 0, data[0][2]), (n + 1, 0, [0.0] * 6), (n + 2, 0, None), (n + 3, None, data[0][2]), (n + 4, 0, [float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0]), (n + 5, 0, [None, 1.0]), (n + 6, 0, []), (n + 7, 0, [float("inf")] * 6), (n + 8, 1, data[0][2]), (n + 9, 0, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").withColumn("kept", F.lit("x"))
    got = sorted(tuple(r) for r in rangejoin.near_vectors(df, share=share, least=least, block_rows=block).collect())
    assert got == brute_vectors(data)
    assert rangejoin.near_vectors(df.limit(0)).count() == 0


def test_every_label_has_pivots(spark, sf_dir):
    """Also small labels are cut into cells, homes are whole, and clustered vectors are replicated to few of the cells."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("class_id"), "label", F.lit(64).alias("dim"), F.lit(1).cast("bigint").alias("copies"), "embedding")
    members = rangejoin.cell_members(e)
    assert members.filter("is_home").count() == e.count()
    cells = {r.label: r.n for r in members.groupBy("label").agg(F.count_distinct("cell").alias("n")).collect()}
    sizes = {r.label: r["count"] for r in e.groupBy("label").count().collect()}
    assert all(cells[label] >= min(3, n) for label, n in sizes.items()) and len(cells) == len(sizes)
    rng = np.random.default_rng(2)
    centres = np.eye(16)[:8]
    rows_in = [(i, 1, 16, 1, (centres[i % 8] + rng.normal(0, 0.02, 16)).tolist()) for i in range(400)]
    made = spark.createDataFrame(rows_in, "class_id long, label int, dim int, copies long, embedding array<double>")
    members = rangejoin.cell_members(made, least=12)
    assert members.filter("is_home").count() == 400 and members.count() < 5 * 400


def test_range_join_sql(spark, sf_dir):
    got = queries.op6_embedding_range_join(spark, sf_dir).toPandas()
    assert rows(got) == rows(tables(sf_dir).sql(queries.OP6_SQL).df())


def jaccard_pairs(texts):
    """All pairs of texts whose five-word shingles are similar by 4/5, from every pair that shares one."""
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := (t or "").encode().lower().split())}
    have = {}
    for i, g in grams.items():
        for x in g:
            have.setdefault(x, []).append(i)
    met = {(a, b) for ids in have.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    return [(a, b) for a, b in met if 5 * (both := len(grams[a] & grams[b])) >= 4 * (len(grams[a]) + len(grams[b]) - both)], grams


def test_near_copies_brute(spark):
    """The pipeline's near-duplicates against all pairs: real documents, chains, a hot cluster, a common line."""
    import corpus_pipeline

    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(10**6)}"
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    base, line = [word() for _ in range(120)], [word() for _ in range(30)]
    more = []
    for i in range(60):  # copies of one text, one or two words changed
        copy = list(base)
        for at in rnd.sample(range(120), rnd.randrange(1, 3)):
            copy[at] = word()
        more.append(" ".join(copy))
    for i in range(20):  # a chain: each moves on by five words
        more.append(" ".join(f"c{k}" for k in range(5 * i, 5 * i + 120)))
    more += [" ".join(line + [word() for _ in range(rnd.randrange(4, 40))]) for _ in range(40)]
    more += ["", "  ", "A b", "a B", "a b c d e", "a b c d e f", None]
    order = rnd.sample(range(len(more)), len(more))
    texts |= {50_000 + k: t for k, t in zip(order, more)}
    pairs, grams = jaccard_pairs(texts)
    blank = sorted(i for i in texts if i not in grams)
    want = plain_components(texts, pairs + [(blank[0], i) for i in blank[1:]])
    table = spark.createDataFrame([*texts.items(), (None, more[0]), (None, None)], "doc_id long, text string").withColumn("kept_id", F.lit("x")).withColumn("node", F.lit(1))
    got = {r.node: r.component for r in simhash.near_components(table).collect()}
    assert set(got) == set(texts)
    # nothing is joined that brute force leaves apart, and next to nothing is missed
    assert all(want[i] == want[c] for i, c in got.items())
    gone, found = ({i for i, c in x.items() if c != i} for x in (want, got))
    assert len(gone) > 150 and found <= gone and len(gone - found) <= 0.01 * len(gone)
    kept = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, table, "")
    assert kept.columns == table.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and sorted(i for i in ids if i is not None) == sorted(set(texts) - found)


def test_apart_pairs_brute(spark):
    """Texts that share most of their words and aren't similar leave few pairs; of those that are similar none that meets is lost."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(90):
        copy = list(base)
        for at in rnd.sample(range(150), 3):
            copy[at] = f"x{i}_{at}"
        texts.append(" ".join(copy))
        if i % 6 == 0:
            copy[rnd.randrange(150)] = f"y{i}"
            texts.append(" ".join(copy))
    texts += [" ".join(f"s{k}" for k in range(i, i + 9)) for i in range(3)] + ["same"] * 2
    rows_in = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = simhash.wide_fingerprints(rows_in)
    met = simhash.meetings(simhash.postings(found)).cache()
    labels = spark.createDataFrame([(len(texts) - 1, len(texts) - 2)], "node long, component long")
    opened = simhash.open_entries(found, labels).cache()
    got = {(r.a, r.b) for r in simhash.apart_pairs(opened, simhash.fine_fingerprints(rows_in)).collect()}
    entries = {}
    for r in met.collect():
        entries.setdefault(r.entry, set()).add(r.id)
    meeting = {(a, b) for ids in entries.values() for a in ids for b in ids if a < b}
    sets = [simhash.shingles(t) for t in texts]
    want = {(a, b) for a, b in meeting if b < len(texts) - 2 and simhash.similar(sets[a], sets[b])}
    assert len(want) >= 12 and want <= got <= meeting and len(meeting) > 1000 and len(got) < 0.2 * len(meeting)
    assert all(simhash.similar(sets[a], sets[b], (13, 20)) for a, b in got)  # no pair far below 4/5 leaves a task
    assert not any(len(texts) - 1 in p and len(texts) - 2 in p for p in got)
    assert simhash.apart_pairs(opened.limit(0), simhash.fine_fingerprints(rows_in)).count() == 0


def rows_of_joins(df):
    """The rows that each join of a plan makes, as Spark counts them."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df._jdf.queryExecution().executedPlan().executeCollect()
        found, left = [], [df._jdf.queryExecution().executedPlan()]
        while left:
            node = left.pop()
            if "Join" in node.nodeName():
                found.append(node.metrics().apply("numOutputRows").value())
            left += [node.children().apply(i) for i in range(node.children().size())]
        return found
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")


def test_meetings_are_not_joined_by_document(spark):
    """A class's weight stands beside its meetings, and a fingerprint meets its document once, in however many buckets that is."""
    met = [(e, i, 10, 1 + (i + e) % 4) for e in range(40) for i in range(30) if (i * 7 + e) % 3]
    df = spark.createDataFrame(met, "entry long, id long, n int, size long")
    w = {i: sum(m[3] for m in met if m[1] == i) for i in range(30)}
    hub = {e: max((m[1] for m in met if m[0] == e), key=lambda i: (w[i], -i)) for e in range(40)}
    pairs = simhash.hub_pairs(df)
    assert sorted(tuple(r) for r in pairs.collect()) == sorted({(i, hub[e], w[hub[e]]) for e, i, *_ in met if i != hub[e]})
    assert len(rows_of_joins(pairs)) == 1
    dealt = spark.createDataFrame([(i, b) for i in range(20) for b in range(i % 5 + 1) for _ in range(2)], "id long, bucket long")
    fine = spark.createDataFrame([(i, bytes([i])) for i in range(25)], "id long, fine binary")
    prints = simhash._prints_of_buckets(dealt, fine)
    assert sorted((r.id, r.bucket, r.fine[0]) for r in prints.collect()) == [(i, b, i) for i in range(20) for b in range(i % 5 + 1)]
    assert rows_of_joins(prints) == [20]


def test_repeated_ids(spark):
    """A doc_id with several texts is one document in both senses of a copy, and the row that stays is always the same."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows_in = [(4, a, "r"), (4, b, "s"), (2, b, "t"), (9, a, "u"), (7, c, "v"), (7, c, "w"), (7, c, "w")]
    for order in (rows_in, rows_in[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)
        assert {(r.doc_id, r.component_id) for r in simhash.simhash_groups(df).collect()} == {(4, 2), (2, 2), (9, 2), (7, 7)}
        kept = sorted(tuple(r) for r in simhash.near_keep(df).collect())
        first = kept if order is rows_in else first
        assert kept == first and [k[0] for k in kept] == [2, 7]
    assert simhash.near_keep(df.limit(0)).count() == 0


def test_wide_fingerprint_is_a_majority():
    h = simhash.shingle_hashes("one two three four five six seven eight one two three four five")
    assert len(h) == len(simhash.shingles("one two three four five six seven eight one two three four five")) == 8
    each = np.stack([np.unpackbits(simhash.wide_fingerprint(h[i : i + 1]), bitorder="little") for i in range(len(h))])
    assert (np.unpackbits(simhash.wide_fingerprint(h), bitorder="little") == (2 * each.sum(0) > len(h))).all()
    assert len(simhash.shingle_hashes(None)) == 0 and not simhash.wide_fingerprint(simhash.shingle_hashes("")).any()
