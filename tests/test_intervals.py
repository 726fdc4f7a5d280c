"""Overlaps in bins and by sums equal those of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tillage.operators import intervals, links

REF = "book string, chapter int, vs int, ve int"


def random_ref(rnd):
    a = rnd.randrange(0, 40)
    return (rnd.choice("AB"), rnd.randrange(1, 3), None, None) if rnd.random() < 0.1 else (rnd.choice("AB"), rnd.randrange(1, 3), a, a + rnd.choice([0, 0, 1, 3, 30]))


@pytest.mark.parametrize("width", [1, 4, 100])
def test_binned_join(spark, width):
    rnd = random.Random(1)
    a = spark.createDataFrame([(i, *random_ref(rnd)) for i in range(120)] + [(900, None, 1, 1, 1), (901, "A", None, 1, 1)], f"i int, {REF}")
    b = spark.createDataFrame([(i, *random_ref(rnd)) for i in range(90)] * 2, f"j int, {REF}")
    got = sorted(map(tuple, intervals.overlapping(a, b, width).select("i", "j", "book", "chapter").collect()))
    assert got == sorted(map(tuple, links.overlapping(a, b).select("i", "j", "book", "chapter").collect())) and len(got) > 500


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_later_overlaps_equal_all_pairs(spark, block):
    rnd = random.Random(block)
    rows = [(s, i, *random_ref(rnd)) for s in (1, 2) for i in range(70)] + [(1, 30, "A", 1, 3, 5), (1, 30, "A", 1, 4, 4), (None, 5, "A", 1, 1, 1), (1, None, "A", 1, 1, 1)]
    got = intervals.later_overlaps(spark.createDataFrame(rows, f"s int, line long, {REF}"), "s", "line", block).collect()
    want = []
    for s, i, book, chapter, vs, ve in rows:
        if s is None or i is None:
            continue
        hit = [j for t, j, b, c, x, y in rows if t == s and j is not None and j > i and (b, c) == (book, chapter) and (vs is None or x is None or (vs <= y and x <= ve))]
        want.append((s, book, chapter, i, len(hit), min(hit, default=None)))
    key = lambda r: (r[0], r[1], r[2], r[3], r[4])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_a_hot_chapter_is_many_blocks(spark):
    """200,000 references of one chapter: no task holds them all, and counts are those of a formula."""
    n = 200_000
    refs = spark.range(n).select(F.lit("s").alias("s"), F.col("id").alias("line"), F.lit("A").alias("book"), F.lit(1).alias("chapter"), (F.col("id") % 20).cast("int").alias("vs"), (F.col("id") % 20).cast("int").alias("ve"))
    wrong = intervals.later_overlaps(refs, "s", "line").filter(~(F.col("later") == F.floor((n - 1 - F.col("line")) / 20)) | ((F.col("line") < n - 20) & (F.col("next") != F.col("line") + 20)))
    assert wrong.count() == 0 and intervals.later_overlaps(refs.limit(0), "s", "line").count() == 0


def test_many_small_chapters_share_a_call(spark):
    """20,000 chapters of three lines each: no Python call for each chapter, and the counts are right."""
    rows = spark.range(60_000).select(F.floor(F.col("id") / 3).alias("s"), (F.col("id") % 3).alias("line"), F.lit("A").alias("book"), F.lit(1).alias("chapter"), (F.col("id") % 3).cast("int").alias("vs"), F.lit(1).alias("ve"))
    found = intervals.later_overlaps(rows, "s", "line")
    assert "Groups" not in found._jdf.queryExecution().executedPlan().toString()
    want = {0: (1, 1), 1: (0, None), 2: (0, None)}
    assert {(r.line, r.later, r.next): r.n for r in found.groupBy("line", "later", "next").agg(F.count("*").alias("n")).collect()} == {(k, *v): 20_000 for k, v in want.items()}
