"""Language ID, quality and toxicity: held-out accuracy, odd rows, and what may not be looked at."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillage.llm import langid, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "no id here", "en", "s", 1), (9001, None, "en", "s", 0), (9002, "", None, None, 0), (9003, "12 ... !!", "en", "s", 9), (9004, "the of and " * 30000, "en", "s", 9)]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet").cache()


def test_language_accuracy_and_odd_rows(spark, docs):
    extra = spark.createDataFrame(ODD + ODD[:1], DOCS)
    got = langid.identify(docs.unionByName(extra)).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    assert len(got) == docs.count() + 6
    real = [r for r in got if r.lang and r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in real]) > 0.97
    assert all(r.held_out == held(r.doc_id) for r in got if r.doc_id is not None)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and by[9004].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)


def test_language_ignores_labels_and_nothing_to_learn(spark, docs):
    swapped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit("xx")).otherwise(F.col("lang")))
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(swapped.withColumn("score", F.lit(1)).withColumn("Extra", F.lit("x"))).collect()}
    assert a == b
    none = langid.identify(docs.limit(5).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.identify(docs.limit(0)).count() == 0


def test_language_sample_keeps_rare_languages(spark):
    """Five large languages and a rare one: each has its share of the total, and what few leave goes to the rest."""
    sizes = {"a": 9000, "b": 8000, "c": 7000, "d": 6000, "e": 5000, "rare": 1000, "tiny": 30}
    rows, at = [], 0
    for name, n in sizes.items():
        rows += [(at + i, f"{name} {name}", name) for i in range(n)]
        at += n
    sample = langid._sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id", 800, 4000, 1 << 10)
    got = {name: sum(r[1] == name for r in sample) for name in sizes}
    assert len(sample) == 4000 and got.pop("tiny") >= 28
    assert min(got.values()) >= 660 and max(got.values()) - min(got.values()) <= 1


def test_ngrams_in_pieces(monkeypatch):
    text = "Straße à la carte, naïve façade. " * 50
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "PIECE", 97)
    assert (langid.ngram_counts(text) == whole).all() and whole.sum() == 3 * len(text.lower()) - 3


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    ex = []
    for i in range(300):
        y = i % 2
        ex.append((np.array([y, 2 + rng.integers(0, 40)]), np.array([1.0, 0.3]), y))
    w, b = langid.fit_ftrl(ex, 2, 50, l1=1.0)
    assert (np.abs(w[2:]).sum(1) == 0).mean() > 0.5 and w[0, 0] > 0 > w[0, 1]
    assert langid.fit_temperature(np.array([[5.0, 0], [5, 0], [0, 5], [5, 0]]), np.array([0, 0, 1, 1])) > 1


def test_quality_keeps_clean_and_finds_junk(spark, docs, labels):
    extra = spark.createDataFrame(ODD + ODD[:1], DOCS)
    got = quality.classify(docs.unionByName(extra), labels).join(labels, "doc_id", "left").collect()
    assert len(got) == docs.count() + 6
    kept = [r.predicted for r in got if r.held_out and r.quality == 1]
    junk = [1 - r.predicted for r in got if r.held_out and r.quality == 0]
    assert np.mean(kept) > 0.97 and np.mean(junk) > 0.6
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_without_two_classes(spark, docs, labels):
    none = quality.classify(docs.limit(3), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    ones = quality.classify(docs.limit(3), labels.filter("quality = 1")).collect()
    assert len({r.score for r in ones}) == 1 and ones[0].score > 0.9
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_chunks_cover_every_byte(monkeypatch):
    for n in (0, 1, 7, 8, 128, 135, 136, 137, 264, 265, 1000):
        data = bytes(range(1, 251)) * 5
        rows = quality.chunks(data[:n])
        seen = b"".join(r[: quality.STRIDE].tobytes() for r in rows[:-1]) + rows[-1].tobytes()
        assert seen.rstrip(b"\0") == data[:n]
    rng = np.random.default_rng(1)
    model = quality.QualityModel(rng.normal(0, 1, (quality.WIDTH * quality.KINDS.shape[1], 5)), np.zeros(5), rng.normal(0, 1, 5), rng.normal(0, 1, 5), 0.1)
    text = "Some text, somewhat long. " * 400
    whole = model.scorer()(text)
    monkeypatch.setattr(quality, "PIECE", quality.STRIDE * 3)
    assert abs(model.scorer()(text) - whole) < 1e-9


def plain_forward(model, data):
    """The network restated: each chunk's windows one after another, a dot product for each filter."""
    rows = quality.chunks(data)
    weights = model.filters.reshape(quality.WIDTH, quality.KINDS.shape[1], -1)
    pooled = []
    for row in rows:
        answers = [sum(quality.KINDS[row[at + k]] @ weights[k] for k in range(quality.WIDTH)) for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STEP)]
        pooled.append(np.maximum(np.max(answers, axis=0) + model.offset, 0))
    z = model.mean_w @ np.mean(pooled, axis=0) + model.max_w @ np.max(pooled, axis=0) + model.bias
    return 1 / (1 + np.exp(-z))


def test_quality_forward_restated():
    rng, kinds = np.random.default_rng(6), quality.KINDS.shape[1]
    model = quality.QualityModel(rng.normal(0, 0.5, (quality.WIDTH * kinds, 4)), rng.normal(0, 0.5, 4), rng.normal(0, 1, 4), rng.normal(0, 1, 4), 0.2)
    score = model.scorer()
    for text in ("", "a", "Some words, 12 numbers & marks! " * 20, "é" * 200, "x" * 137):
        assert abs(score(text) - plain_forward(model, text.encode())) < 1e-9


def test_quality_gradient_by_differences(monkeypatch):
    monkeypatch.setattr(quality, "CHUNKS_AT_ONCE", 3)
    rng, kinds = np.random.default_rng(7), quality.KINDS.shape[1]
    p = {"w": rng.normal(0, 0.5, (quality.WIDTH * kinds, 5)), "o": rng.normal(0, 0.1, 5), "m": rng.normal(0, 1, 5), "x": rng.normal(0, 1, 5), "b": np.zeros(1)}
    docs = [quality.chunks(bytes(rng.integers(32, 123, n).astype(np.uint8))) for n in (50, 900, 300)]
    y = np.array([1.0, 0.0, 1.0])
    _, g = quality.gradient(p, docs, y)
    for name in p:
        flat = p[name].reshape(-1)
        for i in rng.choice(len(flat), min(12, len(flat)), replace=False):
            was = flat[i]
            flat[i] = was + 1e-6
            up = quality.gradient(p, docs, y)[0]
            flat[i] = was - 1e-6
            down = quality.gradient(p, docs, y)[0]
            flat[i] = was
            assert abs((up - down) / 2e-6 - g[name].reshape(-1)[i]) < 1e-6, (name, i)


def test_quality_sample_in_bytes():
    rows = [(1, 0, 5, 10), (2, 1, 9, 10), (3, 0, 1, 10), (4, 0, 2, 100), (5, 1, 3, 10)]
    assert quality.within_bytes(rows, 35) == [3, 5, 2]
    assert quality.within_bytes(rows, 1000) == [3, 5, 4, 2, 1]


def test_quality_learns():
    rng = np.random.default_rng(2)
    docs = [quality.chunks(bytes(rng.integers(97, 110 if i % 2 else 123, 600).astype(np.uint8))) for i in range(80)]
    y = np.array([i % 2 for i in range(80)], np.float32)
    model = quality.fit(docs, y, epochs=12, batch=16)
    tables = model.tables()
    p = []
    for d in docs:
        h = model.pooled(d, tables)
        p.append(model.mean_w @ h.mean(0) + model.max_w @ h.max(0) + model.bias > 0)
    assert np.mean(np.array(p) == (y > 0)) > 0.95


def test_clashing_columns(spark, docs, labels):
    """Columns that are called like those used inside change nothing."""
    names = ["_key", "_id", "_y", "_mark", "_text", "_hash", "_group", "_size", "_rank", "score", "predicted"]
    some = docs.limit(40)
    clash = some.withColumns({n: F.lit("x") for n in names})
    marks = labels.withColumns({n: F.lit("y") for n in names})
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(quality.classify(some, labels)) == key(quality.classify(clash, marks))
    assert key(toxicity.classify(some, labels)) == key(toxicity.classify(clash, marks))
    assert key(langid.identify(some)) == key(langid.identify(clash))
    for kept in (langid.keep_identified(clash), quality.keep_good(clash, marks)):
        assert kept.columns == clash.columns and 0 < kept.count() <= 40


def test_tfidf_and_ftrl_restated():
    """Values and weights against a plain restatement: dictionaries and one weight at a time."""
    texts = ["aab", "abba", "cab", "bb", "acca", "cc"] * 3
    langs = [0, 0, 1, 0, 1, 1] * 3
    counts = [langid.ngram_counts(t, 1 << 16) for t in texts]
    df = sum((c > 0).astype(int) for c in counts)
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    grams = [{g for n in langid.ORDERS for g in (t[i : i + n] for i in range(len(t) - n + 1))} for t in texts]
    assert [int((c > 0).sum()) for c in counts] == [len(g) for g in grams]
    examples = []
    for c, y in zip(counts, langs):
        which = np.flatnonzero(c)
        v = (1 + np.log(c[which])) * idf[which]
        examples.append((which, v / np.sqrt((v * v).sum()), y))
    w, b = langid.fit_ftrl(examples, 2, 1 << 16, epochs=2)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.001
    z, n = {}, {}

    def weight(k, penalty):
        zi = z.get(k, 0.0)
        return 0.0 if abs(zi) <= penalty else -(zi - np.sign(zi) * penalty) / ((beta + n.get(k, 0.0) ** 0.5) / alpha + l2)

    rng = np.random.default_rng(7)
    for _ in range(2):
        for i in rng.permutation(len(examples)):
            which, v, y = examples[i]
            inputs = [*zip(which.tolist(), v.tolist()), (-1, 1.0)]
            now = {(k, c): weight((k, c), l1 if k >= 0 else 0.0) for k, _ in inputs for c in (0, 1)}
            s = [sum(x * now[k, c] for k, x in inputs) for c in (0, 1)]
            p = np.exp(s) / np.exp(s).sum()
            for k, x in inputs:
                for c in (0, 1):
                    g = x * (p[c] - (c == y))
                    old = n.get((k, c), 0.0)
                    z[k, c] = z.get((k, c), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * now[k, c]
                    n[k, c] = old + g * g
    for k in {k for k, _ in z if k >= 0}:
        assert np.allclose(w[k], [weight((k, c), l1) for c in (0, 1)], atol=1e-5)
    assert np.allclose(b, [weight((-1, c), 0.0) for c in (0, 1)])


def test_toxicity(spark, docs, labels):
    extra = spark.createDataFrame(ODD + ODD[:1], DOCS)
    got = toxicity.classify(docs.unionByName(extra), labels).join(labels, "doc_id", "left").collect()
    assert len(got) == docs.count() + 6
    assert np.mean([r.toxic_pred for r in got if r.toxic == 0]) < 0.01
    assert np.mean([r.toxic_pred for r in got if r.toxic == 1]) > 0.6  # some marks are of texts without any abuse
    assert [c for c in got[0].asDict() if c.startswith("p_")] == ["p_kind_1", "p_kind_2", "p_kind_3", "p_toxic"]
    telling = sum(r.p_toxic > 0.9 and max(r.p_kind_1, r.p_kind_2, r.p_kind_3) > 0.5 for r in got if r.toxic == 1)
    assert telling > 0.5 * sum(r.toxic == 1 for r in got)
    assert toxicity.classify(docs.limit(2), labels.limit(0)).first().p_toxic == 0.0
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_chain_feeds_earlier_answers():
    rng = np.random.default_rng(3)
    x = (rng.random((400, 6)) < 0.3).astype(np.float32)
    first = x[:, 1]
    last = ((x[:, 1] + x[:, 2]) > 0).astype(float)
    every = [np.arange(6)] * 5
    chain = toxicity.fit_chain([toxicity.LENGTH, *"abcde"], x, {"one": first, "toxic": last}, {"one": 0.3, "toxic": 0.5}, np.arange(400) % 4, every)
    p = chain.probabilities(x)
    assert ((p[:, 0] > 0.5) == (first > 0)).mean() > 0.98 and ((p[:, 1] > 0.5) == (last > 0)).mean() > 0.98
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1


def test_chain_restated():
    """Out-of-fold answers and the chain against a plain restatement, each fold with columns of its own."""
    rng = np.random.default_rng(5)
    x = (rng.random((120, 5)) < 0.4).astype(np.float64)
    targets = {"a": (x[:, 1] + rng.normal(0, 0.4, 120) > 0.5).astype(float), "b": (x[:, 2] + rng.normal(0, 0.4, 120) > 0.5).astype(float)}
    shares, fold = {"a": 0.2, "b": 0.4}, rng.integers(0, 3, 120)
    chosen = [np.array([0, 1, 2]), np.array([0, 1]), np.array([0, 2, 4]), np.array([0, 1, 2, 3])]
    chain = toxicity.fit_chain(list("vwxyz"), x, targets, shares, fold, chosen)
    earlier, logit = [], lambda p: np.log(p / (1 - p))
    for name, w in zip(targets, chain.weights):
        full = np.column_stack([x[:, chosen[-1]], *earlier])
        want = toxicity.fit_logistic(full, targets[name])
        want[-1] += logit(shares[name])
        assert np.allclose(w, want)
        answer = np.zeros(120)
        for k in range(3):
            seen = np.flatnonzero(fold != k)
            inputs = np.column_stack([x[:, chosen[k]], *earlier])
            v = toxicity.fit_logistic(inputs[seen], targets[name][seen])
            for i in np.flatnonzero(fold == k):
                answer[i] = 1 / (1 + np.exp(-(inputs[i] @ v[:-1] + v[-1] + logit(shares[name]))))
        earlier.append(answer)
    assert chain.words == ["v", "w", "x", "y"]


def test_folds_choose_their_own_words(spark):
    """A word that only a fold's own documents hold isn't among those that the other folds choose for it."""
    rows = [(i, int(i % 3 == 0), i % 5, ("slur " if i % 3 == 0 else "kind ") + ("onlytwo " if i % 5 == 2 and i % 3 == 0 else "") + "and so on") for i in range(300)]
    lists = toxicity.telling_words(spark.createDataFrame(rows, "k long, y int, fold int, t string"), 50, 5)
    assert len(lists) == 6 and all("slur" in x for x in lists)
    assert "onlytwo" not in lists[2] and all("onlytwo" in lists[k] for k in (0, 1, 3, 4, 5))


def test_kinds_follow_words():
    x = np.zeros((30, 6))
    x[:15, :2], x[15:25, 2:4], x[25:29, 5] = 1, 1, 2
    kind = toxicity.kinds_of(x, 3)
    assert kind.tolist() == [0] * 15 + [1] * 10 + [2] * 5


def test_bounded_sample(spark):
    from tillage.llm.common import bounded_sample

    rows = spark.createDataFrame([("big", i) for i in range(20_000)] + [("big", 7)] * 500 + [("small", i) for i in range(30)] + [(None, 1)], "g string, k long")
    got = bounded_sample(rows, "g", "k", 100, seed=1).groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("k").alias("d")).collect()
    assert {r.g: (r.n, r.d) for r in got} == {"big": (100, 100), "small": (30, 30), None: (1, 1)}
    first = {r.k for r in bounded_sample(rows, "g", "k", 100, seed=1).filter("g = 'big'").collect()}
    want = rows.filter("g = 'big'").distinct().orderBy(F.xxhash64("k", F.lit(1))).limit(100).collect()
    assert first == {r.k for r in want}


@pytest.mark.parametrize("times", [1, 40, 2000])
def test_bounded_sample_whatever_the_repeats(spark, times):
    """A group that is nothing but repeats keeps as many keys as without them, as a full sort says."""
    from tillage.llm.common import bounded_sample

    again = spark.range(50 * times).select(F.lit("again").alias("g"), (F.col("id") % 50).alias("k"))
    large = spark.range(900).crossJoin(spark.range(min(times, 20)).select()).select(F.lit("large").alias("g"), (F.col("id") + 50).alias("k"))
    plain = spark.range(300).select(F.lit("plain").alias("g"), (F.col("id") + 5000).alias("k"))
    rows = again.unionByName(large).unionByName(plain)
    got = {(r.g, r.k) for r in bounded_sample(rows, "g", "k", 60, seed=4).select("g", "k").collect()}
    want = set()
    for g in ("again", "large", "plain"):
        want |= {(r.g, r.k) for r in rows.filter(F.col("g") == g).distinct().orderBy(F.xxhash64("k", F.lit(4)), "k").limit(60).collect()}
    assert got == want and sum(g == "again" for g, _ in got) == 50


def test_language_of_a_few_documents_repeated_is_learned(spark, docs):
    """40 documents of one language, each 500 times, beside 400 of others."""
    few = docs.filter("lang = 'de' and n_chars > 200").orderBy("doc_id").limit(40)
    others = docs.filter("lang <> 'de' and n_chars > 200").orderBy("doc_id").limit(400)
    got = langid.identify(few.crossJoin(spark.range(500).select()).unionByName(others)).join(docs.select("doc_id", "lang"), "doc_id")
    share = {r.lang: r.right for r in got.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right")).collect()}
    assert len(share) > 2 and share["de"] > 0.95 and min(share.values()) > 0.9
