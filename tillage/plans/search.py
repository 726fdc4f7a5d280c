"""Queries over embeddings: retrieval for every hundredth vector as a question against all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.operators import bundle, encode, retrieval
from tillage.plans import references
from tillage.tables import kept_table


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _table(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("label") % 3 == 0, "scripture").when(F.col("label") % 3 == 1, "beliefs").otherwise("talks")
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), kind.alias("collection"), F.col("embedding").alias("vector"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))


HITS = """v AS (SELECT vec_id AS id, CASE label % 3 WHEN 0 THEN 'scripture' WHEN 1 THEN 'beliefs' ELSE 'talks' END AS collection, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
dd AS (SELECT q.id AS question, v.collection, v.id, greatest(list_inner_product(q.e, q.e) + list_inner_product(v.e, v.e) - 2 * list_inner_product(q.e, v.e), 0) AS distance
  FROM v q, v WHERE q.id % 100 = 0),
hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question, collection ORDER BY round(distance, 9), id) AS INTEGER) AS rank FROM dd)
  WHERE rank <= CASE collection WHEN 'scripture' THEN 24 WHEN 'beliefs' THEN 16 ELSE 32 END)"""


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    h = retrieval.vector_topk(_questions(spark, d), _table(spark, d))
    return h.select("question", "collection", "id", "rank", F.round(retrieval.similarity(F.col("distance")), 6).alias("score"))


VECTOR_TOPK = f"WITH {HITS} SELECT question, collection, id, rank, round(greatest(0, 1 - distance / 2), 6) AS score FROM hits"


def _with_text(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    return hits.join(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("title")), "id", "left")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.ranked(_with_text(spark, d, retrieval.vector_topk(_questions(spark, d), _table(spark, d))))


def weighted_topk_by_collection(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("question", "place", "collection", "id", F.round("score", 6).alias("score"))


RANKED = HITS + r""",
sc AS (SELECT h.*, coalesce(text, '') AS text, source AS title, greatest(0, 1 - distance / 2) AS raw_score, round(greatest(0, 1 - distance / 2) * CASE collection WHEN 'scripture' THEN 1.25 WHEN 'beliefs' THEN 1.1 ELSE 1.0 END::DOUBLE, 9) AS score,
  lower(regexp_replace(substr(coalesce(text, ''), 1, 160), '^\s+|\s+$', '', 'g')) AS fp FROM hits h LEFT JOIN documents ON doc_id = id),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question, collection, fp ORDER BY score DESC, rank) AS n FROM sc) WHERE n = 1),
lim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question, collection ORDER BY score DESC, rank) AS k FROM one) WHERE k <= CASE collection WHEN 'scripture' THEN 6 WHEN 'beliefs' THEN 4 ELSE 8 END),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, CASE collection WHEN 'scripture' THEN 0 WHEN 'beliefs' THEN 1 ELSE 2 END, rank) AS INTEGER) AS place FROM lim)"""
WEIGHTED = f"WITH {RANKED} SELECT question, place, collection, id, round(score, 6) AS score FROM ranked"


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("question", "place", "collection", "id", "raw_score", F.coalesce("text", F.lit("")).alias("text"), F.concat_ws(" ", "title", F.col("id").cast("string")).alias("label"), (F.col("id") % 5 == 0).alias("from_expansion"), F.lit("").alias("connection"), F.concat(F.lit("http://x/"), F.col("id").cast("string")).alias("url"))


def fit_context(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fit_context(_passages(spark, d), 14_000).select("question", "place", "id", "collection")


FIT_CONTEXT = f"""
WITH RECURSIVE {RANKED},
p AS (SELECT question, id, collection, length(text) + length(concat_ws(' ', title, id)) + 32 AS cost,
  CAST(row_number() OVER (PARTITION BY question ORDER BY CASE WHEN id % 5 = 0 AND collection = 'scripture' THEN 0 ELSE 1 END, place) AS BIGINT) AS i FROM ranked),
f AS (SELECT DISTINCT question, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS seen, CAST([] AS BIGINT[]) AS kept FROM p
  UNION ALL
  SELECT f.question, p.i, CASE WHEN no THEN used ELSE used + cost END, CASE WHEN no THEN seen ELSE list_append(seen, p.collection) END, CASE WHEN no THEN kept ELSE list_append(kept, p.id) END
  FROM (SELECT f.*, p.collection AS pc, p.cost AS pcost, used + p.cost > 14000 AND (list_contains(seen, p.collection) OR used > 14000) AS no FROM f JOIN p ON p.question = f.question AND p.i = f.i + 1) f
  JOIN p ON p.question = f.question AND p.i = f.i + 1),
last AS (SELECT question, kept FROM f QUALIFY row_number() OVER (PARTITION BY question ORDER BY i DESC) = 1),
u AS (SELECT question, unnest(range(1, len(kept) + 1)) AS place, unnest(kept) AS id FROM last)
SELECT u.question, CAST(u.place AS INTEGER) AS place, u.id, p.collection FROM u JOIN p ON p.question = u.question AND p.id = u.id"""


def silence(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.silence(_passages(spark, d), 0.999)


SILENCE = f"WITH {RANKED} SELECT question, NOT bool_or(collection IN ('talks', 'beliefs') AND raw_score > 0.999) AS silent FROM ranked GROUP BY question"


def citations_distinct(spark: SparkSession, d: str) -> DataFrame:
    p = _passages(spark, d).withColumn("label", F.substring_index("label", " ", 1)).withColumn("url", F.concat(F.lit("http://x/"), (F.col("id") % 3).cast("string"))).withColumn("connection", F.when(F.col("id") % 4 == 0, "Connected in A").otherwise(""))
    return retrieval.distinct_citations(p)


CITATIONS = f"""WITH {RANKED}, c AS (SELECT question, place, coalesce(title, CAST(id AS VARCHAR)) || CASE WHEN id % 4 = 0 THEN ' (Connected in A)' ELSE '' END ||
  CASE WHEN collection <> 'scripture' THEN ' — http://x/' || id % 3 ELSE '' END AS citation FROM ranked),
f AS (SELECT question, citation, min(place) AS p FROM c GROUP BY ALL)
SELECT question, CAST(row_number() OVER (PARTITION BY question ORDER BY p) AS INTEGER) AS n, citation FROM f"""


def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    led = F.when(F.col("id") % 7 == 0, F.concat(F.lit("Connected in talk "), F.col("id").cast("string"))).otherwise("")
    c = retrieval.render_context(_passages(spark, d).withColumn("connection", led))
    return c.select("question", F.length("context").alias("chars"), F.md5("context").alias("context_md5"))


PROMPT = f"""WITH {RANKED}, i AS (SELECT question, place, CASE WHEN id % 7 = 0 THEN 'talks' ELSE collection END AS collection,
  '[' || concat_ws(' ', title, id) || ']' || chr(10) || CASE WHEN id % 7 = 0 THEN 'Connected in talk ' || id || chr(10) ELSE '' END || text AS item FROM ranked),
b AS (SELECT question, collection, string_agg(item, chr(10) || chr(10) ORDER BY place) AS body FROM i GROUP BY ALL),
c AS (SELECT question, string_agg(CASE collection WHEN 'scripture' THEN 'SCRIPTURE' WHEN 'beliefs' THEN 'BELIEFS' ELSE 'TEACHING' END || chr(10) || body, chr(10) || chr(10)
  ORDER BY CASE collection WHEN 'scripture' THEN 0 WHEN 'beliefs' THEN 1 ELSE 2 END) AS context FROM b GROUP BY question)
SELECT question, CAST(length(context) AS INTEGER) AS chars, md5(context) AS context_md5 FROM c"""


def multi_query_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Each question with the three vectors after it as its expansions, merged behind its own passages."""
    from pyspark.sql import Window

    e = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    phrases = e.filter("vec_id % 100 between 1 and 3").select(F.col("vec_id").alias("question"), "vector")
    hits = _with_text(spark, d, retrieval.vector_topk(phrases, _table(spark, d), {"scripture": 3, "beliefs": 4, "talks": 4}))
    extra = retrieval.ranked(hits, {"scripture": 3, "beliefs": 4, "talks": 4})
    at = Window.partitionBy("_q").orderBy(F.desc("score"), retrieval.collection_order(F.col("collection")), "rank", "question")
    extra = extra.withColumn("_q", F.col("question") - F.col("question") % 100).withColumn("place", F.row_number().over(at)).drop("question").withColumnRenamed("_q", "question")
    pick = lambda df, flag: df.select("question", "place", "collection", "id", F.coalesce("text", F.lit("")).alias("text"), F.lit(flag).alias("from_expansion"))
    return retrieval.merge_expansion(pick(_ranked(spark, d), False), pick(extra, True), 4).select("question", "place", "collection", "id", "from_expansion")


EXPANSION = f"""WITH {RANKED},
xd AS (SELECT q.id AS phrase, v.collection, v.id, greatest(list_inner_product(q.e, q.e) + list_inner_product(v.e, v.e) - 2 * list_inner_product(q.e, v.e), 0) AS distance FROM v q, v WHERE q.id % 100 BETWEEN 1 AND 3),
xh AS (SELECT *, CAST(row_number() OVER (PARTITION BY phrase, collection ORDER BY round(distance, 9), id) AS INTEGER) AS rank FROM xd),
xs AS (SELECT xh.*, coalesce(text, '') AS text, round(greatest(0, 1 - distance / 2) * CASE collection WHEN 'scripture' THEN 1.25 WHEN 'beliefs' THEN 1.1 ELSE 1.0 END::DOUBLE, 9) AS score,
  lower(regexp_replace(substr(coalesce(text, ''), 1, 160), '^\\s+|\\s+$', '', 'g')) AS fp FROM xh LEFT JOIN documents ON doc_id = id WHERE rank <= CASE collection WHEN 'scripture' THEN 12 ELSE 16 END),
xo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phrase, collection, fp ORDER BY score DESC, rank) AS n FROM xs) WHERE n = 1),
xl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phrase, collection ORDER BY score DESC, rank) AS k FROM xo) WHERE k <= CASE collection WHEN 'scripture' THEN 3 ELSE 4 END),
xp AS (SELECT phrase - phrase % 100 AS question, collection, id, fp, row_number() OVER (PARTITION BY phrase - phrase % 100 ORDER BY score DESC, CASE collection WHEN 'scripture' THEN 0 WHEN 'beliefs' THEN 1 ELSE 2 END, rank, phrase) AS place FROM xl),
bo AS (SELECT question, 0 AS part, place, collection, id, fp FROM ranked UNION ALL SELECT question, 1, place, collection, id, fp FROM xp),
bn AS (SELECT *, row_number() OVER (PARTITION BY question, fp ORDER BY part, place) = 1 AND fp <> '' AS new FROM bo),
bb AS (SELECT *, coalesce(sum(CASE WHEN part = 1 AND new THEN 1 ELSE 0 END) OVER (PARTITION BY question ORDER BY part, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bn),
bl AS (SELECT *, bool_or(part = 1 AND collection = 'scripture') OVER (PARTITION BY question, fp) AS raised FROM bb WHERE part = 0 OR before < 4)
SELECT question, CAST(row_number() OVER (PARTITION BY question ORDER BY part, place) AS INTEGER) AS place, collection, id, part = 1 OR (fp <> '' AND raised) AS from_expansion FROM bl WHERE part = 0 OR new"""


def index_counts(spark: SparkSession, d: str) -> DataFrame:
    return bundle.collection_counts(_table(spark, d), [*retrieval.COLLECTIONS, "spare"])


INDEX_COUNTS = """SELECT c AS collection, count(e.vec_id) AS n FROM (VALUES ('scripture', 0), ('beliefs', 1), ('talks', 2), ('spare', 9)) AS t(c, k)
LEFT JOIN embeddings e ON e.label % 3 = k GROUP BY c"""

def _read_path(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """What `retrieval.search` takes: talks are the chunks of sources made from lineitem, scripture cites a reference made from its id."""
    chunks = references.chunks_of(spark, d).withColumn("source_id", F.concat(F.lit("s"), F.col("source_id").cast("string")))
    name = F.concat("source_id", F.lit("#"), F.col("chunk").cast("string"))
    chunks = kept_table(chunks.select("source_id", "chunk", name.alias("id"), "refs", "primary", F.concat(F.lit("talk "), "source_id").alias("title")), "search-chunks")
    v = F.col("vec_id")
    code = F.element_at(F.array(*[F.lit(c) for c in references.CODES]), (v % 10 + 1).cast("int"))
    ref = F.array(F.struct(code.alias("book"), (v % 7 + 1).cast("int").alias("chapter"), (v % 50).cast("int").alias("vs"), (v % 50 + 3).cast("int").alias("ve")))
    none = F.array().cast(ref_kind := "array<struct<book:string,chapter:int,vs:int,ve:int>>")
    table = _table(spark, d)
    rows = _t(spark, d, "embeddings").select("vec_id").join(table.select(F.col("id").alias("vec_id"), "collection"), "vec_id")
    rows = rows.withColumns({"source_id": F.when(F.col("collection") == "talks", F.concat(F.lit("s"), (v % 100 + 1).cast("string"))).otherwise(""), "chunk": F.floor(v / 100).cast("int")})
    rows = rows.join(chunks.select("source_id", "chunk", "refs", "primary", "title"), ["source_id", "chunk"], "left")
    texts = _t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    rows = rows.join(texts.join(table.select(F.col("id").alias("vec_id")), "vec_id", "left_semi"), "vec_id", "left")
    label = F.coalesce("title", F.concat("collection", F.lit(" "), v.cast("string")))
    columns = ["id", "text", "label", "citation", "title", "source_id", "cited", "primary", "refs"]
    found = rows.select(
        v.cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), label.alias("label"), label.alias("citation"), label.alias("title"), "source_id",
        F.when(F.col("collection") == "scripture", ref).otherwise(none).alias("cited"), F.coalesce("primary", none).alias("primary"), F.coalesce("refs", none).alias("refs"),
    )
    said = chunks.select("id", F.concat(F.lit("said in "), "id").alias("text"), F.col("title").alias("label"), F.col("title").alias("citation"), "title", "source_id", none.alias("cited"), "primary", "refs")
    windows = references.windows_of(spark)
    read = windows.select(F.col("window_id").alias("id"), F.col("window_id").alias("text"), F.col("window_id").alias("label"), F.col("window_id").alias("citation"), F.col("window_id").alias("title"), F.lit("").alias("source_id"), none.alias("cited"), none.alias("primary"), none.alias("refs"))
    e = _t(spark, d, "embeddings")
    asked = F.when(F.floor(v / 100) % 2 == 1, ref).otherwise(none.cast(ref_kind))
    questions = e.filter("vec_id % 100 = 0").select(v.alias("question"), F.col("embedding").alias("vector"), asked.alias("asked"), F.concat(F.lit("What of "), v.cast("string"), F.lit("?")).alias("text"))
    phrases = e.filter("vec_id % 100 between 1 and 3").select((v - v % 100).alias("question"), (v % 100).alias("phrase"), F.concat(F.lit("phrase "), v.cast("string")).alias("text"), F.col("embedding").alias("vector"))
    passages = found.select(*columns).unionByName(said.select(*columns)).unionByName(read.select(*columns))
    return questions, phrases, table.withColumn("id", F.col("id").cast("string")), kept_table(passages, "search-passages"), chunks, windows


def search_context(spark: SparkSession, d: str) -> DataFrame:
    """The whole read path: each question's passages in order, and the digest of the prompt made of them."""
    questions, *rest = _read_path(spark, d)
    found = kept_table(retrieval.search(questions, *rest), "search")
    asked = retrieval.prompts(questions.select("question", "text"), found).select("question", F.md5(F.element_at("messages", -1)["content"]).alias("prompt_md5"))
    return found.select("question", "place", "collection", "id", F.round("score", 6).alias("score"), "connection").join(asked, "question")


def text_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A vector of each document, by an encoder learned from all of them."""
    docs = _t(spark, d, "documents")
    return encode.fit_encoder(docs).encode(docs, "doc_id")


QUERIES = [
    (text_vectors, None), (search_context, None),
    (vector_topk, VECTOR_TOPK), (weighted_topk_by_collection, WEIGHTED), (fit_context, FIT_CONTEXT), (silence, SILENCE), (citations_distinct, CITATIONS), (prompt_render, PROMPT),
    (multi_query_expansion, EXPANSION), (index_counts, INDEX_COUNTS),
]
