"""The encoder against numpy's SVD of the same matrix, and what it puts into the store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillage.operators import encode
from tillage.operators.bundle import with_checked_dimension
from tillage.sources.store import PassageStore, read_manifest


def matrix(spark, texts, terms):
    """TF-IDF rows in numpy, from the words' numbers."""
    numbers = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(encode.term_numbers(F.col("t"), terms)).collect()]
    counts = np.stack([np.bincount(x, minlength=terms) if x else np.zeros(terms) for x in numbers]).astype(float)
    df = (counts > 0).sum(0)
    idf = np.where(df > 0, 1 + np.log((1 + len(texts)) / (1 + df)), 0)
    a = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return a / np.maximum(np.sqrt((a * a).sum(1, keepdims=True)), 1e-300)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_equals_numpy(spark, docs):
    rows = docs.orderBy("doc_id").select("doc_id", "text").collect()
    a = matrix(spark, [r.text for r in rows], 2048)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    got = encode.fit_encoder(docs.repartition(5), dimension=24, terms=2048, oversample=40, power=5)
    assert np.allclose(got.singular, s[:24], rtol=1e-5)
    quick = encode.fit_encoder(docs, dimension=24, terms=2048)
    assert np.allclose(quick.singular, s[:24], rtol=0.05) and (quick.singular <= s[:24] + 1e-9).all()
    assert np.allclose(got.basis.T @ got.basis, np.eye(24), atol=1e-6)
    vectors = {r.doc_id: np.array(r.vector) for r in got.encode(docs, "doc_id").collect()}
    mine = np.stack([vectors[r.doc_id] for r in rows])
    assert np.allclose(np.linalg.norm(mine, axis=1), 1, atol=1e-5)
    want = a @ vt[:24].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.quantile(np.abs(mine @ mine.T - want @ want.T), 0.99) < 0.02
    exact = a @ got.basis
    assert np.allclose(mine, exact / np.linalg.norm(exact, axis=1, keepdims=True), atol=1e-5)


def test_low_rank_is_exact_and_odd_rows(spark):
    topics = ["red green blue", "one two three four", "sun moon"]
    texts = [f"{topics[i % 3]} " * (1 + i % 2) for i in range(30)] + [None, "", " .,! ", "red " * 40_000]
    table = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, text string, key string")
    got = encode.fit_encoder(table, dimension=6, terms=4096)
    assert np.allclose(got.singular, np.linalg.svd(matrix(spark, texts, 4096), compute_uv=False)[:6], atol=1e-3)
    v = {r.id: np.array(r.vector) for r in got.encode(table).collect()}
    assert all(not v[i].any() for i in (30, 31, 32)) and all(abs(v[i] @ v[i % 3] - 1) < 1e-5 for i in range(30))
    assert max(abs(v[i] @ v[j]) for i, j in ((0, 1), (0, 2), (1, 2))) < 1e-5 and 0.4 < v[33] @ v[0] < 0.7
    none = encode.fit_encoder(table.limit(0), dimension=4, terms=64)
    assert not none.singular.any() and not any(r.vector[0] for r in none.encode(table).collect()) and none.encode(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        encode.fit_encoder(table, dimension=10, terms=8)


def test_index_passages(spark, docs, tmp_path):
    model = encode.fit_encoder(docs, dimension=8, terms=512)
    model.save(spark, str(tmp_path / "m"))
    again = encode.Encoder.load(spark, str(tmp_path / "m"))
    assert again.revision == model.revision and np.array_equal(again.basis, model.basis) and np.array_equal(again.singular, model.singular)
    store, manifest = PassageStore(spark, str(tmp_path / "s")), str(tmp_path / "manifest")
    chunk = lambda i, source, text, kind="talks": (i, text, source, kind)
    put = lambda *rows, m=model: encode.index_passages(store, spark.createDataFrame(list(rows), "id string, text string, source_id string, collection string"), m, manifest)
    put(chunk("a1", "a", "the of and"), chunk("a2", "a", "in on"), chunk("b1", "b", "with from", "beliefs"))
    put(chunk("a3", "a", "the of and"), chunk("c1", "c", ""))
    rows = {r.id: r for r in store.table().collect()}
    assert set(rows) == {"a3", "b1", "c1"} and all(len(r.vector) == 8 for r in rows.values())
    assert read_manifest(spark, manifest)["counts"] == {"talks": 2, "beliefs": 1} and read_manifest(spark, manifest)["revision"] == model.revision
    with pytest.raises(ValueError, match="rebuild"):
        put(chunk("d1", "d", "x"), m=encode.fit_encoder(docs, dimension=9, terms=512))
    with pytest.raises(Exception, match="components"):
        with_checked_dimension(model.encode(store.table()), "vector", 9).collect()
    (tmp_path / "bad").mkdir()
    with pytest.raises(ValueError, match="no model"):
        encode.Encoder.load(spark, str(tmp_path / "bad"))


def test_one_python_worker_for_each_core(spark):
    """Counting and weighing are one function in a task, and what a pass sums up is dealt to a stated number of tasks."""
    docs = spark.createDataFrame([(i, f"one two w{i % 7} w{i % 3}") for i in range(40)], "id long, text string")
    encoder = encode.fit_encoder(docs, dimension=4, terms=512)
    made = encoder.encode(docs)
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    chained = encode.term_counts(docs, "id", "text", 512)
    assert made.count() == chained.count() == 40
