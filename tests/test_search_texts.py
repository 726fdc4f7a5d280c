"""The read path carries no whole texts before it has chosen."""

import os

from pyspark.sql import functions as F

from tillage.functions.text import HEAD
from tillage.operators import retrieval
from tillage.plans import search


def test_ranking_carries_the_heads_of_texts(spark, monkeypatch):
    longest, kept_table = {}, retrieval.kept_table

    def kept(df, name):
        found = kept_table(df, name)
        if "text" in found.columns:
            longest[name] = found.agg(F.max(F.length("text"))).first()[0] or 0
        return found

    monkeypatch.setattr(retrieval, "kept_table", kept)
    d = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    questions, phrases, table, passages, chunks, windows = search._read_path(spark, d)
    got = retrieval.search(questions, phrases, table, passages, chunks, windows)
    whole = {r.id: r.text for r in passages.select("id", "text").collect()}
    rows = got.collect()
    assert all(longest[name] <= HEAD for name in ("expansions", "found", "passages")) and longest["found"] > 0
    assert all(r.text == whole[r.id] for r in rows) and max(len(r.text) for r in rows) > HEAD
