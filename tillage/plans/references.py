"""Queries over passage references, made from lineitem: a supplier is a source, a part's last digit a book, the line number
a chapter, the quantity a verse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillage.functions import refs as R
from tillage.operators import chunking, intervals, links


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_TEN = R.CANON[:9] + [("1JN", "1 John")]
CODES = [c for c, _ in _TEN]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """source_id, line (a total order within the source), book, chapter, vs, ve."""
    l = _t(spark, d, "lineitem")
    book = F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.col("l_partkey") % 10 + 1).cast("int"))
    vs = F.col("l_quantity").cast("int")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    return l.select(
        F.col("l_suppkey").alias("source_id"), (F.row_number().over(order) - 1).alias("line"), book.alias("book"), F.col("l_linenumber").alias("chapter"),
        vs.alias("vs"), (vs + (F.col("l_suppkey") % 4).cast("int")).alias("ve"),
    )


_NAMES = ", ".join(f"({i}, '{c}', '{n}')" for i, (c, n) in enumerate(_TEN))
LINES = f"""canon(i, book, name) AS (VALUES {_NAMES}),
lines AS (SELECT l_suppkey AS source_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax,
    l_shipdate, l_returnflag, l_linestatus) - 1 AS INTEGER) AS line, book, name, l_linenumber AS chapter, CAST(trunc(l_quantity) AS INTEGER) AS vs,
    CAST(trunc(l_quantity) + l_suppkey % 4 AS INTEGER) AS ve FROM lineitem JOIN canon ON l_partkey % 10 = i)"""
REF_SQL = "name || ' ' || chapter || ':' || vs || CASE WHEN ve <> vs THEN '-' || ve ELSE '' END"


def _formatted(lines: DataFrame) -> DataFrame:
    return lines.withColumn("ref", R.format_ref(F.col("book"), F.col("chapter"), F.col("vs"), F.col("ve")))


def with_refs(spark: SparkSession, d: str) -> DataFrame:
    return _formatted(_lines(spark, d))


def ref_format(spark: SparkSession, d: str) -> DataFrame:
    return _formatted(_lines(spark, d)).select("source_id", "line", "ref")


REF_FORMAT = f"WITH {LINES} SELECT source_id, line, {REF_SQL} AS ref FROM lines"


def ref_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("line") % 5 == 0, F.concat(R.display_name(F.col("book")), F.lit(" "), F.col("chapter").cast("string"))).when(F.col("line") % 7 == 0, "Nowhere 3:4").otherwise(F.col("ref"))
    p = _formatted(_lines(spark, d)).select("source_id", "line", R.parse_ref(text).alias("p"))
    return p.select("source_id", "line", "p.book", "p.chapter", "p.vs", "p.ve")


REF_PARSE = f"""WITH {LINES} SELECT source_id, line, CASE WHEN line % 5 <> 0 AND line % 7 = 0 THEN NULL ELSE book END AS book, CASE WHEN line % 5 <> 0 AND line % 7 = 0 THEN NULL ELSE chapter END AS chapter,
  CASE WHEN line % 5 = 0 OR line % 7 = 0 THEN NULL ELSE vs END AS vs, CASE WHEN line % 5 = 0 OR line % 7 = 0 THEN NULL ELSE ve END AS ve FROM lines"""


def _prose(lines: DataFrame) -> DataFrame:
    """A sentence with the reference, a numbered book, an unknown book and a repeat."""
    body = F.concat(F.lit("In "), F.col("ref"), F.lit(" and First John "), F.col("chapter").cast("string"), F.lit(":2, not Hezekiah 3; also Psalm "), F.col("vs").cast("string"), F.lit(", again "), F.col("ref"), F.lit(". Song of Songs 2:1"), F.lit("–4."))
    return _formatted(lines).withColumn("body", body)


def ref_extract(spark: SparkSession, d: str) -> DataFrame:
    return _prose(_lines(spark, d)).select("source_id", "line", F.array_join(R.extract_refs(F.col("body")), "|").alias("refs"))


REF_EXTRACT = f"""
WITH {LINES}, w AS (SELECT *, {REF_SQL} AS ref FROM lines),
l AS (SELECT source_id, line, [ref, '1 John ' || chapter || ':2', 'Psalms ' || vs, 'Song of Solomon 2:1-4'] AS a FROM w)
SELECT source_id, line, array_to_string(list_filter(a, lambda x, i: i = list_position(a, x)), '|') AS refs FROM l"""


def ref_pack(spark: SparkSession, d: str) -> DataFrame:
    got = _prose(_lines(spark, d)).groupBy("source_id", "chapter").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    packed = got.withColumn("packed", R.pack_refs(F.col("refs")))
    return packed.select("source_id", "chapter", F.md5("packed").alias("packed_md5"), F.size(R.unpack_refs(F.col("packed"))).alias("n"))


REF_PACK = f"""
WITH {LINES}, w AS (SELECT DISTINCT source_id, chapter, {REF_SQL} AS ref FROM lines)
SELECT source_id, chapter, md5(string_agg(ref, chr(10) ORDER BY ref)) AS packed_md5, CAST(count(*) AS INTEGER) AS n FROM w GROUP BY ALL"""


def ref_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Within each source, how many later lines overlap each line."""
    found = intervals.later_overlaps(_lines(spark, d), "source_id", "line").filter("later > 0")
    return found.select("source_id", F.col("line").cast("int").alias("line"), "later", F.col("next").cast("int").alias("next"))


REF_OVERLAP = f"""WITH {LINES} SELECT a.source_id, a.line, count(*) AS later, min(b.line) AS next FROM lines a JOIN lines b ON a.source_id = b.source_id AND a.book = b.book AND a.chapter = b.chapter
  AND a.line < b.line AND a.vs <= b.ve AND b.vs <= a.ve GROUP BY ALL"""

SIZE = 40


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    """source_id, chunk, refs (formatted and parsed) of SIZE lines each, and the source's primary references."""
    lines = _lines(spark, d)
    ref = F.struct("line", F.struct("book", "chapter", "vs", "ve").alias("r"))
    chunks = lines.groupBy("source_id", (F.floor(F.col("line") / SIZE)).cast("int").alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(ref)), lambda x: x["r"]).alias("refs"))
    opening = lines.filter(F.col("line") == 0).select("source_id", F.array(F.struct("book", "chapter", "vs", "ve")).alias("primary"))
    return chunks.join(opening, "source_id")


def sustained_mentions(spark: SparkSession, d: str) -> DataFrame:
    return links.sustained_mentions(chunks_of(spark, d), LEAST)


def bridge_refs(spark: SparkSession, d: str) -> DataFrame:
    """A question is asked of ten sources each; the sources' sustained asides, greedily without overlaps."""
    s = links.sustained_mentions(chunks_of(spark, d), LEAST)
    asides = s.select((F.col("source_id") / 10).cast("bigint").alias("question"), (F.col("source_id") % 10).cast("int").alias("source_rank"), "place", "book", "chapter", "vs", "ve")
    return links.bridges(asides)


_FOLDED = f"""{LINES}, cl AS (SELECT l.source_id, CAST(l.line // {SIZE} AS INTEGER) AS chunk, l.line, l.book, l.chapter, l.vs, l.ve FROM lines l JOIN lines p ON p.source_id = l.source_id AND p.line = 0
  WHERE NOT (l.book = p.book AND l.chapter = p.chapter AND l.vs <= p.ve AND p.vs <= l.ve)),
mk AS (SELECT *, row_number() OVER (PARTITION BY source_id, book, chapter ORDER BY line) AS i FROM cl),
fold(source_id, book, chapter, i, heads) AS (
  SELECT source_id, book, chapter, i, [{{'vs': vs, 've': ve, 'chunk': chunk, 'n': 1, 'first': line}}] FROM mk WHERE i = 1
  UNION ALL
  SELECT f.source_id, f.book, f.chapter, m.i,
    CASE WHEN len(list_filter(f.heads, lambda h: h.vs <= m.ve AND m.vs <= h.ve)) = 0 THEN list_append(f.heads, {{'vs': m.vs, 've': m.ve, 'chunk': m.chunk, 'n': 1, 'first': m.line}})
    ELSE list_transform(f.heads, lambda h, j: CASE WHEN j = list_position(list_transform(f.heads, lambda g: g.vs <= m.ve AND m.vs <= g.ve), true) AND h.chunk <> m.chunk
      THEN {{'vs': CASE WHEN m.ve - m.vs < h.ve - h.vs THEN m.vs ELSE h.vs END, 've': CASE WHEN m.ve - m.vs < h.ve - h.vs THEN m.ve ELSE h.ve END, 'chunk': m.chunk, 'n': h.n + 1, 'first': h.first}}
      ELSE h END) END
  FROM fold f JOIN mk m ON m.source_id = f.source_id AND m.book = f.book AND m.chapter = f.chapter AND m.i = f.i + 1),
whole AS (SELECT source_id, book, chapter, unnest(heads) AS h FROM (SELECT *, row_number() OVER (PARTITION BY source_id, book, chapter ORDER BY i DESC) AS rn FROM fold) WHERE rn = 1),
sus AS (SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY h.first) - 1 AS INTEGER) AS place, book, chapter, h.vs AS vs, h.ve AS ve FROM whole WHERE h.n >= LEAST_CHUNKS)"""
LEAST = 4
SUSTAINED = f"WITH RECURSIVE {_FOLDED} SELECT * FROM sus".replace("LEAST_CHUNKS", str(LEAST))

_BRIDGED = """a AS (SELECT source_id // 10 AS question, source_id % 10 AS sr, place, book, chapter, vs, ve FROM sus),
ak AS (SELECT *, row_number() OVER (PARTITION BY question, book, chapter ORDER BY sr, place) AS i FROM a),
bf(question, book, chapter, i, taken) AS (
  SELECT question, book, chapter, i, [{'sr': sr, 'place': place, 'vs': vs, 've': ve}] FROM ak WHERE i = 1
  UNION ALL
  SELECT b.question, b.book, b.chapter, k.i, CASE WHEN len(list_filter(b.taken, lambda t: t.vs <= k.ve AND k.vs <= t.ve)) > 0 THEN b.taken ELSE list_append(b.taken, {'sr': k.sr, 'place': k.place, 'vs': k.vs, 've': k.ve}) END
  FROM bf b JOIN ak k ON k.question = b.question AND k.book = b.book AND k.chapter = b.chapter AND k.i = b.i + 1),
bt AS (SELECT question, book, chapter, unnest(taken) AS t FROM (SELECT *, row_number() OVER (PARTITION BY question, book, chapter ORDER BY i DESC) AS rn FROM bf) WHERE rn = 1)"""
BRIDGES = f"WITH RECURSIVE {_FOLDED}, {_BRIDGED} SELECT question, CAST(row_number() OVER (PARTITION BY question ORDER BY t.sr, t.place) - 1 AS INTEGER) AS rank, book, chapter, t.vs AS vs, t.ve AS ve FROM bt".replace("LEAST_CHUNKS", str(LEAST))


def aside_refs(spark: SparkSession, d: str) -> DataFrame:
    """Each question has hits in ten sources, two chunks each; even ones ask for a chapter, odd ones for nothing."""
    chunks = chunks_of(spark, d)
    hits = chunks.filter("chunk < 2").select((F.col("source_id") / 10).cast("bigint").alias("question"), (F.col("source_id") % 10 + 10 * F.col("chunk")).alias("place"), "source_id", (1.0 / (F.col("source_id") % 7 + F.col("chunk") + 1)).alias("score"), F.lit("talk").alias("citation"), "primary", "refs")
    groups = links.grouped_hits(hits)
    chapter = F.struct(F.lit("EXO").alias("book"), F.lit(2).alias("chapter"), F.lit(None).cast("int").alias("vs"), F.lit(None).cast("int").alias("ve"))
    asked = groups.select("question").distinct().withColumn("asked", F.when(F.col("question") % 2 == 0, F.array(chapter)).otherwise(F.filter(F.array(chapter), lambda x: F.lit(False))))
    return links.aside_refs(groups, links.sustained_mentions(chunks, LEAST), asked)


ASIDES = f"""WITH RECURSIVE {_FOLDED},
g AS (SELECT source_id // 10 AS question, source_id, CAST(row_number() OVER (PARTITION BY source_id // 10 ORDER BY 1.0 / (source_id % 7 + 1) DESC, source_id % 10) - 1 AS INTEGER) AS source_rank FROM (SELECT DISTINCT source_id FROM lines))
SELECT g.question, g.source_id, g.source_rank, s.place, s.book, s.chapter, s.vs, s.ve FROM g JOIN sus s USING (source_id)
WHERE CASE WHEN g.question % 2 = 0 THEN s.book = 'EXO' AND s.chapter = 2
  ELSE EXISTS (SELECT 1 FROM lines l WHERE l.source_id = s.source_id AND l.line < {2 * SIZE} AND l.book = s.book AND l.chapter = s.chapter AND l.vs <= s.ve AND s.vs <= l.ve) END""".replace("LEAST_CHUNKS", str(LEAST))


def related_sources(spark: SparkSession, d: str) -> DataFrame:
    """A question's bridges lead to sources whose openings are about them; its own ten sources it knows."""
    lines = _lines(spark, d).select("source_id").distinct()
    opening = opening_primary(spark, d).select("source_id", F.explode(F.split("primary_refs", r"\|")).alias("t")).select("source_id", R.parse_ref(F.col("t")).alias("r"))
    primaries = opening.select("source_id", F.concat(F.lit("talk "), (F.col("source_id") % 17).cast("string")).alias("title"), "r.*")
    known = lines.select((F.col("source_id") / 10).cast("bigint").alias("question"), "source_id")
    return links.related_sources(bridge_refs(spark, d), primaries, known, most=3)


RELATED = f"""WITH RECURSIVE {_FOLDED}, {_BRIDGED},
br AS (SELECT question, CAST(row_number() OVER (PARTITION BY question ORDER BY t.sr, t.place) - 1 AS INTEGER) AS bridge, book, chapter FROM bt),
op AS (SELECT source_id, line // 30 AS half, book, chapter, min(line) AS line FROM lines WHERE line < 60 GROUP BY ALL),
two AS (SELECT x.source_id, x.book, x.chapter FROM op x JOIN op y ON x.source_id = y.source_id AND x.half = 0 AND y.half = 1 AND x.book = y.book AND x.chapter = y.chapter),
prim AS (SELECT * FROM two UNION ALL SELECT source_id, arg_min(book, line), arg_min(chapter, line) FROM op WHERE source_id NOT IN (SELECT source_id FROM two) GROUP BY source_id),
h AS (SELECT question, p.source_id, min(bridge) AS bridge FROM br JOIN prim p USING (book, chapter) WHERE p.source_id // 10 <> question GROUP BY ALL),
r AS (SELECT question, source_id, bridge, CAST(row_number() OVER (PARTITION BY question ORDER BY bridge, 'talk ' || source_id % 17, source_id) AS INTEGER) AS rank FROM h)
SELECT * FROM r WHERE rank <= 3""".replace("LEAST_CHUNKS", str(LEAST))


def windows_of(spark: SparkSession) -> DataFrame:
    """Windows of every chapter: 1-54 whole and 6 verses at every third."""
    one = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in CODES])).alias("book")).select("book", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("chapter"))
    starts = F.explode(F.concat(F.array(F.struct(F.lit(1).alias("a"), F.lit(54).alias("z"))), F.transform(F.sequence(F.lit(1), F.lit(49), F.lit(3)), lambda s: F.struct(s.alias("a"), (s + 5).alias("z")))))
    return one.select("book", "chapter", starts.alias("w")).select("book", "chapter", F.col("w.a").alias("verse_start"), F.col("w.z").alias("verse_end"), F.concat_ws(".", "book", F.col("chapter").cast("string"), F.concat(F.col("w.a").cast("string"), F.lit("-"), F.col("w.z").cast("string"))).alias("window_id"))


WINDOWS = """ws AS (SELECT book, c.c AS chapter, s.a, s.z, book || '.' || c.c || '.' || s.a || '-' || s.z AS window_id FROM canon, (SELECT unnest(range(1, 8)) AS c) c,
  (SELECT 1 AS a, 54 AS z UNION ALL SELECT x, x + 5 FROM (SELECT unnest(range(1, 50, 3)) AS x)) s)"""


def _targets(spark: SparkSession, d: str) -> DataFrame:
    l = _lines(spark, d)
    none = F.col("line") % 9 == 0
    return l.select(F.concat_ws(":", F.col("source_id").cast("string"), F.col("line").cast("string")).alias("ref_id"), "source_id", "line", "book", "chapter", F.when(~none, F.col("vs")).alias("vs"), F.when(~none, F.col("ve")).alias("ve"))


def best_window(spark: SparkSession, d: str) -> DataFrame:
    return links.best_window(_targets(spark, d).select("ref_id", "book", "chapter", "vs", "ve"), windows_of(spark))


_BEST = f"""{LINES}, {WINDOWS}, t AS (SELECT source_id || ':' || line AS ref_id, source_id, line, book, chapter, CASE WHEN line % 9 <> 0 THEN vs END AS vs, CASE WHEN line % 9 <> 0 THEN ve END AS ve FROM lines),
j AS (SELECT ref_id, source_id, line, window_id, z - a AS width, a, t.vs IS NULL AS whole, CASE WHEN t.vs IS NULL OR (a <= t.vs AND t.ve <= z) THEN 0 WHEN a <= t.ve AND t.vs <= z THEN 1 END AS tier
  FROM t JOIN ws USING (book, chapter)),
best AS (SELECT ref_id, source_id, line, window_id FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY tier, CASE WHEN whole THEN -width ELSE width END, CASE WHEN whole THEN -a ELSE a END, window_id) AS rn
  FROM j WHERE tier IS NOT NULL) WHERE rn = 1)"""
BEST_WINDOW = f"WITH {_BEST} SELECT ref_id, window_id FROM best"


def cross_links(spark: SparkSession, d: str) -> DataFrame:
    t = _targets(spark, d).select("ref_id", F.floor(F.col("source_id") / 4).alias("question"), (F.col("source_id") % 4).alias("source_rank"), F.col("line").alias("place"), F.concat(F.lit("talk "), F.col("source_id").cast("string")).alias("citation"), F.lit(0.5).alias("score"), "book", "chapter", "vs", "ve")
    return links.cross_links(t, windows_of(spark), 2).drop("score")


CROSS_LINKS = f"""WITH {_BEST}, f AS (SELECT source_id // 4 AS question, source_id % 4 AS sr, line, ref_id, source_id, window_id, row_number() OVER (PARTITION BY source_id // 4, window_id ORDER BY source_id % 4, line, ref_id) AS n FROM best),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY sr, line, ref_id) AS INTEGER) AS rank FROM f WHERE n = 1)
SELECT question, 'talk ' || source_id AS citation, window_id, 'Connected in talk ' || source_id AS connection, rank FROM r WHERE rank <= 2"""


def ref_boost(spark: SparkSession, d: str) -> DataFrame:
    from tillage.operators.retrieval import ref_boost as boost

    l = _lines(spark, d)
    ref = F.array(F.struct("book", "chapter", "vs", "ve"))
    asked = F.array(F.struct(F.lit("EXO").alias("book"), F.lit(3).alias("chapter"), F.lit(10).alias("vs"), F.lit(20).alias("ve")), F.struct(F.lit("1JN").alias("book"), F.lit(2).alias("chapter"), F.lit(None).cast("int").alias("vs"), F.lit(None).cast("int").alias("ve")))
    none = F.array().cast("array<struct<book:string,chapter:int,vs:int,ve:int>>")
    kind = F.when(F.col("line") % 3 == 0, "scripture").otherwise("talks")
    primary = F.when(F.col("line") % 3 == 1, ref).otherwise(none)
    mentioned = F.when(F.col("line") % 3 == 2, ref).otherwise(none)
    cited = F.when(F.col("line") % 3 == 0, ref).otherwise(none)
    return l.select("source_id", "line", boost(kind, asked, cited, primary, mentioned).alias("boost"))


REF_BOOST = f"""WITH {LINES} SELECT source_id, line, CASE WHEN NOT ((book = 'EXO' AND chapter = 3 AND vs <= 20 AND 10 <= ve) OR (book = '1JN' AND chapter = 2)) THEN 0.0
  WHEN line % 3 = 2 THEN 0.1 ELSE 0.25 END::DOUBLE AS boost FROM lines"""


def opening_primary(spark: SparkSession, d: str) -> DataFrame:
    lines = _formatted(_lines(spark, d)).filter("line < 60")
    whole = F.concat(R.display_name(F.col("book")), F.lit(" "), F.col("chapter").cast("string"))
    part = lines.withColumn("half", F.floor(F.col("line") / 30)).groupBy("source_id", "half").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("line", whole.alias("r")))), lambda x: x["r"])).alias("refs"))
    two = part.groupBy("source_id").agg(F.max(F.when(F.col("half") == 0, F.col("refs"))).alias("a"), F.max(F.when(F.col("half") == 1, F.col("refs"))).alias("b"))
    return two.select("source_id", F.array_join(chunking.primary_from_opening(F.col("a"), F.col("b")), "|").alias("primary_refs"))


OPENING = f"""WITH {LINES}, f AS (SELECT source_id, line // 30 AS half, name || ' ' || chapter AS r, min(line) AS line FROM lines WHERE line < 60 GROUP BY ALL),
b AS (SELECT a.source_id, a.r, a.line FROM f a JOIN f b ON a.source_id = b.source_id AND a.half = 0 AND b.half = 1 AND a.r = b.r),
s AS (SELECT source_id, string_agg(r, '|' ORDER BY line) AS p FROM b GROUP BY source_id), o AS (SELECT source_id, arg_min(r, line) AS r FROM f GROUP BY source_id)
SELECT o.source_id, coalesce(s.p, o.r) AS primary_refs FROM o LEFT JOIN s USING (source_id)"""

QUERIES = [
    (ref_format, REF_FORMAT), (ref_parse, REF_PARSE), (ref_extract, REF_EXTRACT), (ref_pack, REF_PACK), (ref_overlap_join, REF_OVERLAP), (sustained_mentions, SUSTAINED), (bridge_refs, BRIDGES), (aside_refs, ASIDES),
    (related_sources, RELATED), (best_window, BEST_WINDOW), (cross_links, CROSS_LINKS), (ref_boost, REF_BOOST), (opening_primary, OPENING),
]
