"""Queries over texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions import text as T
from tillage.functions import urls as U
from tillage.operators import bundle, chunking, html, robots
from tillage.sources import verses


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), T.token_count(F.col("text")).alias("tokens"))


TOKEN_COUNTS = r"""
SELECT doc_id, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS INTEGER) AS words,
       CAST(len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) * 133 // 100 AS INTEGER) AS tokens
FROM documents"""


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("place", "sentence"))
    return s


SENTENCE_SPLIT = r"""
WITH s AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'),
         '([.!?])\s+([A-Z"''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l
  FROM documents)
SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS place, unnest(l) AS sentence FROM s"""


def fingerprint_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").withColumn("fp", T.fingerprint(F.coalesce("text", F.lit(""))))
    return docs.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies", F.md5("fp").alias("fp_md5"))


FINGERPRINT_DEDUPE = r"""
SELECT min(doc_id) AS doc_id, count(*) AS copies, md5(fp) AS fp_md5
FROM (SELECT doc_id, lower(regexp_replace(substr(coalesce(text, ''), 1, 160), '^\s+|\s+$', '', 'g')) AS fp FROM documents) GROUP BY fp"""


def talk_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "text")
    return chunking.talk_windows(docs).select("source_id", "id", "chunk", "tokens", F.md5("text").alias("text_md5"))


def windows_sql(texts: str, target: int, overlap: int) -> str:
    """CTEs w (key, chunk, a, z: sentences a to z - 1) and c (key, l the sentences, n their tokens) of texts (key, text)."""
    return rf"""
s AS (SELECT key, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '([.!?])\s+([A-Z"''])', '\1' || chr(1) || '\2', 'g'), chr(1)),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM ({texts})),
t AS (SELECT key, l, list_transform(l, lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> '')) * 133 // 100) AS n FROM s),
c AS MATERIALIZED (SELECT key, l, n, len(l) AS k, list_transform(range(0, len(l) + 1), lambda i: coalesce(list_sum(list_slice(n, 1, i)), 0)) AS cum FROM t WHERE len(l) > 0),
w(key, chunk, a, z) AS (
  SELECT key, 0, CAST(0 AS BIGINT), coalesce(list_filter(range(1, k), lambda i: cum[i + 2] - cum[1] > {target})[1], k) FROM c
  UNION ALL
  SELECT x.key, x.chunk + 1, st, coalesce(list_filter(range(x.z + 1, k), lambda i: cum[i + 2] - cum[st + 1] > {target})[1], k)
  FROM (SELECT w.key, w.chunk, w.z, c.k, c.cum, list_filter(range(w.a, w.z + 1), lambda q: c.cum[w.z + 1] - c.cum[q + 1] <= {overlap})[1] AS st FROM w JOIN c ON c.key = w.key WHERE w.z < c.k) x)"""


TALK_WINDOWS = f"""WITH RECURSIVE {windows_sql('SELECT doc_id AS key, text FROM documents', 1000, 150)}
SELECT w.key AS source_id, w.key || '#c' || lpad(CAST(chunk AS VARCHAR), 4, '0') AS id, CAST(chunk AS INTEGER) AS chunk, CAST(list_sum(n[a + 1:z]) AS INTEGER) AS tokens, md5(array_to_string(l[a + 1:z], ' ')) AS text_md5
FROM w JOIN c ON c.key = w.key"""


def page_pack(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.array(F.struct(F.lit("").alias("heading"), F.col("text").alias("body")), F.struct(F.col("lang").alias("heading"), F.lit("Read on. And so forth.").alias("body"))).alias("sections"))
    return chunking.page_sections(docs, "doc_id", 900).select("doc_id", "id", "label", "tokens", F.md5("text").alias("text_md5"))


PAGE_PACK = rf"""WITH RECURSIVE x AS (SELECT doc_id, 0 AS place, source AS label, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents
  UNION ALL SELECT doc_id, 1, CASE WHEN lang <> '' THEN concat_ws(' — ', source, lang) ELSE source END, 'Read on. And so forth.' FROM documents),
e AS (SELECT *, len(list_filter(string_split_regex(body, '\s+'), lambda y: y <> '')) * 133 // 100 AS tokens FROM x WHERE body <> ''),
{windows_sql("SELECT doc_id AS key, body AS text FROM e WHERE tokens > 900", 900, 0)},
u AS (SELECT doc_id, place, 0 AS chunk, label, tokens, body AS text FROM e WHERE tokens <= 900
  UNION ALL SELECT e.doc_id, place, chunk, label, list_sum(n[a + 1:z]), array_to_string(l[a + 1:z], ' ') FROM w JOIN c ON c.key = w.key JOIN e ON e.doc_id = w.key AND e.tokens > 900)
SELECT doc_id, doc_id || '#s' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place, chunk) - 1 AS VARCHAR), 4, '0') AS id, label, CAST(tokens AS INTEGER) AS tokens, md5(text) AS text_md5 FROM u"""


def belief_sections(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit("").alias("heading"), x.alias("body"))).alias("sections"))
    return chunking.belief_sections(pages, "doc_id").select("doc_id", "id", F.md5("text").alias("text_md5"))


BELIEF_SECTIONS = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
     e AS (SELECT doc_id, unnest(range(len(l))) AS place, regexp_replace(unnest(l), '^\s+|\s+$', '', 'g') AS body FROM s)
SELECT doc_id, CAST(doc_id AS VARCHAR) || '#b' || lpad(CAST(place AS VARCHAR), 4, '0') AS id, md5(body) AS text_md5 FROM e WHERE body <> ''"""


def verse_windows(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem")
    of = F.row_number().over(_by_order())
    v = lines.select("l_orderkey", of.alias("verse"), F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("text"))
    v = v.select(F.lit("ORD").alias("book"), F.col("l_orderkey").alias("chapter"), "verse", "text")
    return chunking.verse_chunks(v).drop("book")


def _by_order():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")


VERSE_WINDOWS = """
WITH v AS (
  SELECT l_orderkey AS chapter, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS INTEGER) AS verse, l_partkey || '/' || l_suppkey AS text FROM lineitem),
n AS (SELECT chapter, max(verse) AS n FROM v GROUP BY chapter),
r AS (SELECT chapter, 'chapter' AS kind, 1 AS a, n AS b FROM n
      UNION ALL
      SELECT chapter, 'window', s + 1, least(s + 6, n) FROM n, (SELECT unnest(range(0, 3000, 3)) AS s)
      WHERE n > 6 AND n - s >= 2 AND (s = 0 OR s - 3 + 6 < n))
SELECT 'verses:ORD.' || r.chapter || CASE kind WHEN 'window' THEN '.' || min(verse) || '-' || max(verse) ELSE '' END AS id, r.chapter AS chapter,
       min(verse) AS verse_start, max(verse) AS verse_end, kind, string_agg(verse || ' ' || text, ' ' ORDER BY verse) AS text
FROM r JOIN v ON v.chapter = r.chapter AND verse BETWEEN a AND b GROUP BY r.chapter, kind, a, b"""


def _dated(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    day = F.col("o_orderdate")
    long = F.concat(F.lit("Given on "), F.date_format(day, "MMMM"), F.lit(" "), F.dayofmonth(day).cast("string"), F.lit(", "), F.year(day).cast("string"), F.lit("."))
    iso = F.concat(F.lit("Posted "), F.date_format(day, "yyyy-MM-dd"), F.lit(" by us"))
    bad = F.concat(F.lit("On February 31, 2020 and 2021-02-0"), (F.col("o_orderkey") % 9 + 1).cast("string"))
    k = F.col("o_orderkey") % 4
    return o.select("o_orderkey", F.when(k == 0, long).when(k == 1, iso).when(k == 2, bad).otherwise("no date at all").alias("body"))


def first_dates(spark: SparkSession, d: str) -> DataFrame:
    return _dated(spark, d).select("o_orderkey", T.first_date(F.col("body")).alias("found"))


FIRST_DATES = """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
       WHEN 2 THEN '2021-02-0' || CAST(o_orderkey % 9 + 1 AS VARCHAR) ELSE '' END AS found FROM orders"""


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


CANONICAL = r"""
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) ||
  CASE WHEN p = '' THEN '/' WHEN starts_with(p, '/about/') THEN substr(p, 7) ELSE p END ||
  CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(list_transform(list_sort(q), lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&') END AS canonical
FROM (SELECT page_id, url, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS p,
  list_filter(list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: contains(x, '=')),
      lambda x: {'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': url_decode(replace(substr(x, strpos(x, '=') + 1), '+', ' '))}),
    lambda x: x.v <> '' AND lower(x.k) NOT IN ('location', '_', 'share', 'replytocom', 'fbclid', 'utm_source', 'utm_medium', 'utm_campaign')) AS q FROM pages)"""


#: Queries with escapes, keys that sort apart from their pairs, blanks and repeats.
HARD = ["a=1&a-b=2", "q=a%20b", "q=a+b&Q=%C3%A9", "b=&c", "x=1&x=0&utm_source=z", "t=~a*b", "k=a%3Db&LOCATION=wg", "z=%26&a=%2F"]


def canonical_queries(spark: SparkSession, d: str) -> DataFrame:
    """Each page's URL with one of some queries that are hard to bring into one form."""
    p = _t(spark, d, "pages").withColumn("url", _with_query())
    return p.select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


def _with_query():
    hard = F.array(*[F.lit(h) for h in HARD])
    return F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("?"), F.element_at(hard, (F.col("page_id") % len(HARD) + 1).cast("int")), F.lit("#part"))


_HARD = "[" + ", ".join(f"'{h}'" for h in HARD) + "]"
CANONICAL_QUERIES = CANONICAL.replace("FROM pages)", f"FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') || '?' || {_HARD}[page_id % {len(HARD)} + 1] || '#part' AS url FROM pages))")


def url_classes(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _t(spark, d, "pages").select(
        "page_id", F.size(U.path_parts(u)).alias("parts"), U.is_listing(u, "en").alias("listing"), U.is_message(u, "en").alias("message"),
        U.series_of(u, "en").alias("series"), U.slug(u).alias("slug"), U.in_scope(u, section="en").alias("in_scope"), U.allowed(u, ("blog.", "/de/")).alias("allowed"),
    )


URL_CLASSES = r"""
WITH p AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS l FROM pages),
     c AS (SELECT *, coalesce(len(l) >= 3 AND l[1] = 'en' AND l[2] NOT IN ('archive', 'series'), false) AS message FROM p)
SELECT page_id, CAST(len(l) AS INTEGER) AS parts, len(l) = 0 OR (coalesce(l[1] = 'en', false) AND NOT message) AS listing, message,
  CASE WHEN len(l) >= 2 AND l[1] = 'en' THEN upper(substr(replace(l[2], '-', ' '), 1, 1)) || substr(replace(l[2], '-', ' '), 2) ELSE '' END AS series,
  CASE WHEN len(l) = 0 THEN 'index' ELSE substr(array_to_string(l, '-'), 1, 120) END AS slug,
  starts_with('/' || array_to_string(l, '/'), '/en') AS in_scope, NOT (contains(lower(url), 'blog.') OR contains(lower(url), '/de/')) AS allowed FROM c"""


def frontier(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").select(U.canonical_url(F.col("url")).alias("url")).distinct()
    return p.select("url", U.priority(F.col("url"), "en", content=("/fr/163",)).alias("priority"))


FRONTIER = f"""
WITH c AS ({CANONICAL}), u AS (SELECT DISTINCT canonical AS url, list_filter(string_split(regexp_extract(canonical, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS l FROM c)
SELECT url, CASE WHEN len(l) = 0 OR (l[1] = 'en' AND NOT (len(l) >= 3 AND l[2] NOT IN ('archive', 'series'))) THEN 0
  WHEN array_to_string(l, '/') = 'fr/163' THEN 2 WHEN l[1] = 'en' AND len(l) >= 3 AND l[2] NOT IN ('archive', 'series') THEN 3 ELSE 4 END AS priority FROM u"""


def dedup_keys(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages")
    k = F.col("page_id") % 3
    audio = F.when(k == 0, F.concat(F.lit("HTTPS://Cdn.Example.org/A/"), F.col("page_id").cast("string"), F.lit("wg.MP3?_=1"))).otherwise("")
    date = F.when(k == 1, F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))).otherwise("")
    return p.select("page_id", U.dedup_key(date, F.lit("WG"), audio, F.col("url")).alias("key"))


DEDUP_KEYS = f"""
SELECT p.page_id, CASE p.page_id % 3 WHEN 0 THEN 'audio:https://cdn.example.org/a/' || p.page_id || 'wg.mp3'
  WHEN 1 THEN 'msg:2024-01-' || lpad(CAST(p.page_id % 28 + 1 AS VARCHAR), 2, '0') || '|wg' ELSE 'url:' || c.canonical END AS key
FROM pages p JOIN ({CANONICAL}) c USING (page_id)"""


def html_title(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", html.title_of(F.col("html")).alias("title"))


HTML_TITLE = r"""
WITH r AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS h,
  trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS t FROM pages)
SELECT page_id, CASE WHEN h <> '' THEN h ELSE t END AS title FROM r"""


#: Links of a page's navigation count here.
NOT_LINKED = ("script", "style", "noscript", "footer", "form", "svg")


def html_links(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", F.posexplode(html.hrefs_of(F.col("html"), NOT_LINKED)).alias("place", "href"))


def _dropped_sql() -> str:
    out = "html"
    for tag in NOT_LINKED:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b.*?</{tag}>', '', 'g')"
    return out


HTML_LINKS = f"""
WITH l AS (SELECT page_id, regexp_extract_all({_dropped_sql()}, '(?is)<a\\b[^>]*?href="([^"]*)"', 1) AS h FROM pages)
SELECT page_id, CAST(unnest(range(len(h))) AS INTEGER) AS place, unnest(h) AS href FROM l"""


def html_sections(spark: SparkSession, d: str) -> DataFrame:
    p = html.extract_pages(_t(spark, d, "pages"))
    return p.select("url", "title", F.size("sections").alias("sections"), F.size("links").alias("links"), F.md5("body").alias("body_md5"), "audio_url")


def _decoded(t: str) -> str:
    """SQL of a text without the references that the pages hold and without white space around it."""
    plain = f"""regexp_replace(replace(replace(replace({t}, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')"""
    return rf"regexp_replace({plain}, '^\s+|\s+$', '', 'g')"


_DROPPED = "(script|style|nav|footer|form|header)"
_TITLE = _decoded("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")
#: The pages hold h1, p and li only, never nested, so patterns read them as the parser must.
HTML_SECTIONS = rf"""
WITH k AS (SELECT url, html, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<{_DROPPED}[^>]*>.*?</{_DROPPED}>', '', 'g') AS kept FROM pages),
c AS (SELECT url, {_TITLE} AS title,
  regexp_extract_all(regexp_replace(kept, '(?i)(<(p|li)[^>]*>|</article>|</body>|</ul>)', chr(1) || '\1', 'g'), '(?is)<(?:p|li)[^>]*>([^' || chr(1) || ']*)', 1) AS parts FROM k),
b AS (SELECT url, title, array_to_string(list_filter(list_transform(parts, lambda x: array_to_string(list_filter(list_transform(string_split_regex(x, '<[^>]*>'), lambda t: {_decoded('t')}), lambda t: t <> ''), ' ')), lambda x: x <> ''), chr(10)) AS body FROM c)
SELECT url, title, CAST(CASE WHEN body <> '' THEN 1 ELSE 0 END AS INTEGER) AS sections, CAST(0 AS INTEGER) AS links, md5(body) AS body_md5, '' AS audio_url FROM b"""


def manifest_verify(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    content = F.coalesce("text", F.lit("")).cast("binary")
    found = docs.filter("doc_id % 11 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.sha2(content, 256).alias("sha256"), F.length(content).cast("bigint").alias("bytes"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), F.substr(F.coalesce("text", F.lit("")), F.lit(2)))).when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.coalesce("text", F.lit(""))).cast("binary")
    manifest = docs.select(F.col("doc_id").cast("string").alias("path"), F.sha2(changed, 256).alias("sha256"), F.length(changed).cast("bigint").alias("bytes"))
    return bundle.verify(manifest, found)


MANIFEST_VERIFY = """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, doc_id, coalesce(text, '') AS t,
  CASE WHEN doc_id % 7 = 0 THEN 'x' || substr(coalesce(text, ''), 2) WHEN doc_id % 5 = 0 THEN text || '!' ELSE coalesce(text, '') END AS m FROM documents)
SELECT path, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN strlen(m) <> strlen(t) THEN 'corrupt (size)' WHEN sha256(m) <> sha256(t) THEN 'corrupt (hash)' ELSE 'ok' END AS status FROM d"""


def verse_map(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a map of books, by customer, read back."""
    o = _t(spark, d, "orders").withColumn("book", F.element_at(F.array(F.lit("Genesis"), F.lit("1 john"), F.lit("II Kings"), F.lit("Psalm"), F.lit("nowhere")), (F.col("o_custkey") % 5 + 1).cast("int")))
    inner = o.groupBy("o_custkey", "book").agg(F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), "o_orderpriority"))).alias("v"))
    doc = inner.select(F.to_json(F.create_map("book", F.create_map(F.col("o_custkey").cast("string"), "v"))).alias("value"))
    return verses.from_map(doc)


VERSE_MAP = """
WITH o AS (SELECT CASE o_custkey % 5 WHEN 0 THEN 'GEN' WHEN 1 THEN '1JN' WHEN 2 THEN '2KI' WHEN 3 THEN 'PSA' END AS book, CAST(o_custkey AS INTEGER) AS chapter,
  CAST(o_orderkey AS INTEGER) AS verse, o_orderpriority AS text FROM orders)
SELECT * FROM o WHERE book IS NOT NULL"""


def verse_array(spark: SparkSession, d: str) -> DataFrame:
    """Nations by region as an array of books, read back."""
    n = _t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("v"))
    book = F.element_at(F.array(*[F.lit(b) for b in ("Ruth", "Job", "Joel", "Mark", "Jude")]), F.col("n_regionkey") + 1)
    return verses.from_array(n.select(F.to_json(F.array(F.struct(book.alias("name"), F.array("v").alias("chapters")))).alias("value")))


VERSE_ARRAY = """
SELECT CASE n_regionkey WHEN 0 THEN 'RUT' WHEN 1 THEN 'JOB' WHEN 2 THEN 'JOL' WHEN 3 THEN 'MRK' ELSE 'JUD' END AS book, 1 AS chapter,
  CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS INTEGER) AS verse, n_name AS text FROM nation"""


def book_gate(spark: SparkSession, d: str) -> DataFrame:
    from tillage.functions.refs import canon

    books = canon(spark).select(F.col("ordinal").alias("_o"), "book")
    v = _t(spark, d, "lineitem").select((F.col("l_partkey") % 60).cast("int").alias("_o")).distinct().join(F.broadcast(books), "_o").select("book")
    return bundle.guard_books(v, 66).select("books", F.array_join("missing", ",").alias("missing"), "ok")


BOOK_GATE = """
WITH b AS (SELECT DISTINCT CAST(l_partkey % 60 AS INTEGER) AS o FROM lineitem)
SELECT count(*) AS books, (SELECT string_agg(n, ',' ORDER BY o) FROM (VALUES (60, '2 Peter'), (61, '1 John'), (62, '2 John'), (63, '3 John'), (64, 'Jude'), (65, 'Revelation')) AS m(o, n)
  WHERE m.o NOT IN (SELECT o FROM b)) AS missing, count(*) >= 66 AS ok FROM b"""


def human_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_totalprice").cast("bigint") * F.pow(F.lit(10), F.col("o_orderkey") % 8).cast("bigint")
    return _t(spark, d, "orders").select("o_orderkey", T.human_size(n).alias("size"))


HUMAN_SIZES = """
WITH n AS (SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) * CAST(power(10, o_orderkey % 8) AS BIGINT) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 1024 THEN printf('%.1f B', n / 1.0::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE)
  WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) ELSE printf('%.1f TB', n / 1099511627776.0::DOUBLE) END AS size FROM n"""

def _robots(spark: SparkSession, d: str) -> DataFrame:
    """A robots file for each host of pages, with rules made from its own paths."""
    u = F.col("url")
    ends = _t(spark, d, "pages").groupBy(robots.host_of(u).alias("host")).agg(F.min(U.path(u)).alias("a"), F.max(U.path(u)).alias("z"))
    general = F.concat(F.lit("# rules\nUser-agent: other\nDisallow: /\n\nUser-Agent: *\nUser-agent: third\nAllow: /en/7 # seven\nDisallow: /*.html$\nDisallow:\nCrawl-delay: 3\nDisallow: /fr\nDisallow: /*?*utm_source\nAllow: "), "a", F.lit("\nDisallow: "), "z", F.lit("$\nSitemap: /x\n"))
    own = F.concat(general, F.lit("User-agent: Tillage\nDisallow: /de\nDisallow: /*/3\nAllow: /*?page=\nDisallow: "), F.col("a"), F.lit("\n"))
    return ends.select("host", F.when(F.col("host").startswith("blog."), own).otherwise(general).alias("body"))


def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    return robots.with_verdicts(_t(spark, d, "pages").select("page_id", "url"), _robots(spark, d), "tillage")


ROBOTS_RULES = r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query FROM pages),
h AS (SELECT host, min(path) AS a, max(path) AS z, starts_with(host, 'blog.') AS own FROM p GROUP BY host),
r AS (SELECT host, unnest(CASE WHEN own THEN [{'allow': false, 'pattern': '/de'}, {'allow': false, 'pattern': '/*/3'}, {'allow': true, 'pattern': '/*?page='}, {'allow': false, 'pattern': a}]
  ELSE [{'allow': true, 'pattern': '/en/7'}, {'allow': false, 'pattern': '/*.html$'}, {'allow': false, 'pattern': '/fr'}, {'allow': false, 'pattern': '/*?*utm_source'}, {'allow': true, 'pattern': a}, {'allow': false, 'pattern': z || '$'}] END) AS r FROM h),
m AS (SELECT page_id, r.pattern, r.allow, row_number() OVER (PARTITION BY page_id ORDER BY length(r.pattern) DESC, r.allow DESC) AS k FROM p JOIN r USING (host)
  WHERE regexp_matches(path || query, '^' || replace(regexp_escape(regexp_replace(r.pattern, '\$$', '')), '\*', '.*') || CASE WHEN r.pattern LIKE '%$' THEN '$' ELSE '' END))
SELECT p.page_id, p.url, coalesce(m.allow, true) AS allowed, m.pattern AS rule FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1"""


QUERIES = [
    (token_counts, TOKEN_COUNTS), (sentence_split, SENTENCE_SPLIT), (fingerprint_dedupe, FINGERPRINT_DEDUPE), (talk_windows, TALK_WINDOWS), (page_pack, PAGE_PACK),
    (belief_sections, BELIEF_SECTIONS), (verse_windows, VERSE_WINDOWS), (first_dates, FIRST_DATES), (canonical_urls, CANONICAL), (canonical_queries, CANONICAL_QUERIES), (url_classes, URL_CLASSES),
    (frontier, FRONTIER), (robots_rules, ROBOTS_RULES), (dedup_keys, DEDUP_KEYS), (html_title, HTML_TITLE), (html_links, HTML_LINKS), (html_sections, HTML_SECTIONS), (manifest_verify, MANIFEST_VERIFY),
    (verse_map, VERSE_MAP), (verse_array, VERSE_ARRAY), (book_gate, BOOK_GATE), (human_sizes, HUMAN_SIZES),
]
