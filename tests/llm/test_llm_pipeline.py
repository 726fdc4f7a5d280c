"""The pipeline's stages: columns, decisions and whole results on the small tables."""

import corpus_pipeline
from pyspark.sql import functions as F

from tillage.llm import langid, queries, simhash
from tillage.llm.common import written


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(90001, "123 !!", "en", "s", 6), (90002, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, sf), name)
        kept[name] = docs.count()
        if name != "sentencepiece_encode":
            assert docs.columns == columns and docs.schema["doc_id"].dataType == before.schema["doc_id"].dataType
        if name == "language_id":
            assert docs.filter("doc_id > 90000").count() == 0 and before.count() - docs.count() < 10
        if name == "quality_classifier":
            gone = before.join(docs, "doc_id", "left_anti").join(labels, "doc_id")
            assert gone.filter("quality = 1").count() <= 0.02 * labels.count() < gone.filter("quality = 0").count() + 10
        if name == "simhash_dedup":
            assert docs.count() == simhash.near_components(before).select("component").distinct().count()
            assert docs.groupBy("doc_id").count().filter("count > 1").count() == 0
        if name == "mix_sources":
            assert docs.join(before, "doc_id", "left_anti").count() == 0
            assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert kept["sentencepiece_encode"] == kept["mix_sources"] and docs.filter("not round_trip").count() == 0


def test_registry():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(names)
    assert langid.UNKNOWN == "und"


def test_stages_on_empty_tables(spark, tmp_path):
    """Every stage takes an empty table, and empty labels, and keeps the columns."""
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, shard int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.count() == 0
        assert name == "sentencepiece_encode" or got.columns == docs.columns
