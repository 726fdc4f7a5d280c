"""Queries over the frontier of a crawl, catalogs, transcripts and chunks on their way into the index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions import urls as U
from tillage.operators import bundle, chunking, crawl, retrieval, state
from tillage.plans import references
from tillage.plans.corpus import CANONICAL, windows_sql
from tillage.plans.worklog import LOG, jobs_of
from tillage.sources.logs import read_catalog
from tillage.tables import scratch_dir


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """page_id and url, of which half are made detail pages."""
    url = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", "")
    return _t(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(url, F.lit("/part"))).otherwise(F.col("url")).alias("url"))


#: page_id and url as _pages gives them, and the parts of its path.
_SQL = r"""p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') || '/part' ELSE url END AS url FROM pages),
k AS (SELECT *, list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS l FROM p),
m AS (SELECT *, coalesce(len(l) >= 3 AND l[1] = 'en' AND l[2] NOT IN ('archive', 'series'), false) AS message FROM k),
g AS (SELECT *, len(l) = 0 OR (coalesce(l[1] = 'en', false) AND NOT message) AS listing FROM m)"""


def catalog_new(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages that a catalog of a third of them lacks."""
    pages = _t(spark, d, "pages")
    catalog = pages.filter("page_id % 3 = 0").select(U.canonical_url(F.col("url")).alias("url"))
    return crawl.catalog_add(catalog, pages.select("url", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("source")))


CATALOG_NEW = f"""WITH c AS ({CANONICAL})
SELECT canonical AS url, 'queued' AS state, min('p' || page_id) AS source FROM c WHERE canonical NOT IN (SELECT canonical FROM c WHERE page_id % 3 = 0) GROUP BY canonical"""


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.min("page_id") % 4 == 0, "queued").when(F.min("page_id") % 4 == 1, "error").otherwise("fetched")
    return _pages(spark, d).groupBy("url").agg(kind.alias("state"))


_CATALOG = f"""{_SQL}, cat AS (SELECT url, any_value(message) AS message, any_value(listing) AS listing, CASE min(page_id) % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'error' ELSE 'fetched' END AS state FROM g GROUP BY url)"""


def catalog_revisits(spark: SparkSession, d: str) -> DataFrame:
    return crawl.revisits(_catalog(spark, d), section="en")


REVISITS = f"WITH {_CATALOG} SELECT url, 'queued' AS state, 'revisit' AS note FROM cat WHERE state <> 'queued' AND listing"


def catalog_tallies(spark: SparkSession, d: str) -> DataFrame:
    return crawl.catalog_tallies(_catalog(spark, d), section="en")


TALLIES = f"""WITH {_CATALOG} SELECT count(*) FILTER (message) AS messages, count(*) FILTER (message AND state <> 'queued') AS fetched_messages,
  count(*) FILTER (message AND state = 'queued') AS queued_messages, count(*) FILTER (NOT message AND listing AND state = 'queued') AS queued_listings FROM cat"""


def crawl_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each page, some without a body, some with audio, some of a campus that is left out."""
    k = F.col("page_id")
    pages = _pages(spark, d).withColumns({
        "body": F.when(k % 3 != 0, "text").otherwise(""), "audio_url": F.when(k % 5 == 0, "a.mp3").otherwise(""), "campus": F.when(k % 14 == 0, "es").otherwise("wg"),
    })
    return crawl.page_outcomes(pages, ("/fr/163", "/en/7"), ("es",), "en").select("page_id", "is_message", "is_belief", "state", "note")


OUTCOMES = f"""WITH {_SQL}, o AS (SELECT page_id, listing, message AND page_id % 14 = 0 AS skip, message OR page_id % 5 = 0 AS is_message, page_id % 5 <> 0 AND array_to_string(l, '/') IN ('fr/163', 'en/7') AS is_belief FROM g)
SELECT page_id, is_message, is_belief, CASE WHEN skip THEN 'skipped' ELSE 'fetched' END AS state,
  CASE WHEN skip THEN 'campus es excluded' WHEN listing THEN 'listing' WHEN NOT is_message AND NOT is_belief AND page_id % 3 = 0 THEN 'no usable body' ELSE '' END AS note FROM o"""


def catalog_scan(spark: SparkSession, d: str) -> DataFrame:
    """A catalog written as JSON lines, with blank and torn ones between, and read back: the last line of each URL."""
    c = F.to_json(F.struct("url", F.concat(F.lit("s"), (F.col("page_id") % 5).cast("string")).alias("state"), F.lit("n").alias("note"), F.lit(1).alias("unknown")))
    pages = _t(spark, d, "pages")
    lines = pages.select(F.explode(F.array(F.concat(F.substring(c, 1, 20)), F.lit("  "), F.lit('{"state":"keyless"}'), c)).alias("value"))
    first = pages.select(F.to_json(F.struct("url", F.lit("old").alias("state"))).alias("value"))
    path = f"{scratch_dir(spark).rstrip('/')}/catalog-{uuid.uuid4().hex}"
    first.write.text(f"{path}/part=0")
    lines.write.text(f"{path}/part=1")
    # Pages that share a URL have lines of their own in files whose order is not given, so only the newer half is asked about.
    return read_catalog(spark, path).select("url", (F.col("state") == "old").alias("old"), "note", "source")


CATALOG_SCAN = "SELECT DISTINCT url, false AS old, 'n' AS note, CAST(NULL AS VARCHAR) AS source FROM pages"


def attached_files(spark: SparkSession, d: str) -> DataFrame:
    """Files by the stem of their names to items of the log."""
    files = _t(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("in/x.y/"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 4 == 0, ".mp3").otherwise("")).alias("path"))
    hit, left = state.attach_files(jobs_of(spark, d).withColumn("audio_path", F.lit("")), files)
    return hit.select(F.col("id").cast("string").alias("id"), "step", "audio_path").unionByName(left.select(F.lit("").alias("id"), F.lit("").alias("step"), F.col("path").alias("audio_path")))


ATTACHED = f"""WITH {LOG}, f AS (SELECT c_custkey AS id, 'in/x.y/' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN '.mp3' ELSE '' END AS path FROM customer WHERE c_custkey % 2 = 0)
SELECT CAST(o.id AS VARCHAR) AS id, CASE WHEN k < 2 THEN 'audio_downloaded' ELSE step END AS step, path AS audio_path FROM o JOIN f ON o.id = f.id WHERE k < 3
UNION ALL SELECT '', '', path FROM f WHERE id NOT IN (SELECT id FROM o)"""


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as the segments of a transcript, as JSON read by the library's reader."""
    piece = F.struct("ts", "event_id", F.struct(F.col("value").alias("start"), (F.col("value") + 1).alias("end"), F.when(F.col("event_type") == "view", "  ").otherwise(F.concat(F.lit(" "), "event_type")).alias("text")).alias("s"))
    by = _t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(piece)).alias("x"))
    doc = by.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.to_json(F.struct(F.transform("x", lambda e: e["s"]).alias("segments"), F.lit(3.5).alias("duration"))).alias("value"))
    return chunking.read_transcripts(doc).select("path", F.size("segments").alias("n"), F.md5("text").alias("text_md5"), "duration")


TRANSCRIPTS = """WITH s AS (SELECT user_id, ts, event_id, event_type FROM events WHERE event_type <> 'view')
SELECT 'u' || u.user_id AS path, CAST(count(s.event_type) AS INTEGER) AS n, md5(coalesce(string_agg(s.event_type, ' ' ORDER BY ts, event_id), '')) AS text_md5, 3.5::DOUBLE AS duration
FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) u LEFT JOIN s USING (user_id) GROUP BY u.user_id"""


def stamped_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with what their source is about: its own references, or else what its first two chunks open with."""
    ref = references.with_refs(spark, d).withColumn("chunk", F.floor(F.col("line") / 20))
    chunks = ref.groupBy("source_id", "chunk").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("line", "ref"))), lambda x: x["ref"])).alias("scripture_refs"))
    given = F.when(F.col("source_id") % 3 == 0, F.array(F.lit(""), F.lit("Ruth 2"), F.lit(" "))).when(F.col("source_id") % 3 == 1, F.array(F.lit("  ")))
    sources = ref.select("source_id").distinct().withColumn("primary_refs", given)
    return chunking.stamped(chunks, sources).select("source_id", "chunk", F.array_join("primary_refs", "|").alias("primary_refs"))


STAMPED = f"""WITH {references.LINES}, w AS (SELECT source_id, line // 20 AS chunk, {references.REF_SQL} AS ref, min(line) AS line FROM lines GROUP BY ALL),
c AS (SELECT DISTINCT source_id, chunk FROM w),
b AS (SELECT x.source_id, string_agg(x.ref, '|' ORDER BY x.line) AS p FROM w x JOIN w y ON x.source_id = y.source_id AND x.chunk = 0 AND y.chunk = 1 AND x.ref = y.ref GROUP BY x.source_id),
a AS (SELECT source_id, arg_min(ref, line) AS p FROM w WHERE chunk < 2 GROUP BY source_id)
SELECT c.source_id, c.chunk, CASE WHEN c.source_id % 3 = 0 THEN 'Ruth 2' ELSE coalesce(b.p, a.p) END AS primary_refs FROM c LEFT JOIN b USING (source_id) LEFT JOIN a USING (source_id)"""


def indexed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as items of all kinds, with pages and, for most, transcripts: every chunk that goes into the index."""
    k, name = F.col("doc_id"), lambda c: F.concat(F.lit(c), F.col("doc_id").cast("string"))
    docs = _t(spark, d, "documents")
    kind = F.element_at(F.array(F.lit("message"), F.lit("page"), F.lit("belief")), (k % 3 + 1).cast("int"))
    title = F.when(k % 2 == 0, F.concat(F.lit("On Mark "), (k % 16 + 1).cast("string"))).otherwise("")
    items = docs.select(name("i").alias("id"), kind.alias("kind"), title.alias("title"), name("p").alias("page_path"), name("t").alias("transcript_path"), F.lit(None).cast("array<string>").alias("scripture_refs"))
    sections = F.array(F.struct(F.lit("").alias("heading"), F.col("text").alias("body")), F.struct(F.lit("End").alias("heading"), F.lit("Read Ruth 1:2.").alias("body")))
    pages = docs.select(name("p").alias("path"), name("Page ").alias("title"), sections.alias("sections"), F.when(k % 5 == 0, F.array(F.lit("Jude 1:2"))).alias("scripture_refs"))
    said = docs.filter(k % 4 != 0).select(name("t").alias("path"), F.lit("said").alias("title"), "text")
    found = chunking.indexed_chunks(items, pages, said)
    return found.select("collection", "source_id", "id", "title", F.md5("text").alias("text_md5"), F.array_join("scripture_refs", "|").alias("scripture_refs"), F.array_join("primary_refs", "|").alias("primary_refs"))


INDEXED = rf"""WITH RECURSIVE i AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS body, doc_id % 3 = 2 AS belief FROM documents),
j AS (SELECT *, body <> '' AND doc_id % 4 <> 0 AND NOT belief AS said, len(list_filter(string_split_regex(body, '\s+'), lambda y: y <> '')) * 133 // 100 AS tokens FROM i),
src AS (SELECT *, 'i' || doc_id || CASE WHEN said THEN '' ELSE ':page' END AS source_id, CASE WHEN doc_id % 2 = 0 THEN 'On Mark ' || (doc_id % 16 + 1) WHEN said THEN 'said' ELSE 'Page ' || doc_id END AS title,
  list_filter([CASE WHEN doc_id % 2 = 0 THEN 'Mark ' || (doc_id % 16 + 1) END, CASE WHEN doc_id % 5 = 0 THEN 'Jude 1:2' END], lambda r: r IS NOT NULL) AS given FROM j),
tw AS (WITH RECURSIVE {windows_sql('SELECT doc_id AS key, body AS text FROM src WHERE said', 1000, 150)} SELECT w.key AS doc_id, chunk, array_to_string(l[a + 1:z], ' ') AS text FROM w JOIN c ON c.key = w.key),
pw AS (WITH RECURSIVE {windows_sql('SELECT doc_id AS key, body AS text FROM src WHERE NOT said AND NOT belief AND tokens > 900', 900, 0)} SELECT w.key AS doc_id, chunk, array_to_string(l[a + 1:z], ' ') AS text FROM w JOIN c ON c.key = w.key),
pg AS (SELECT doc_id, 0 AS place, chunk, text, '' AS refs FROM pw UNION ALL SELECT doc_id, 0, 0, body, '' FROM src WHERE NOT said AND NOT belief AND tokens <= 900 AND body <> ''
  UNION ALL SELECT doc_id, 1, 0, 'Read Ruth 1:2.', 'Ruth 1:2' FROM src WHERE NOT said AND NOT belief),
pn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, chunk) - 1 AS n FROM pg),
al AS (SELECT doc_id, '#c' || lpad(CAST(chunk AS VARCHAR), 4, '0') AS tail, text, '' AS refs, '' AS opening FROM tw
  UNION ALL SELECT doc_id, '#s' || lpad(CAST(n AS VARCHAR), 4, '0'), text, refs, coalesce(max(CASE WHEN n < 2 THEN nullif(refs, '') END) OVER (PARTITION BY doc_id), '') FROM pn
  UNION ALL SELECT doc_id, '#b0000', body, '', '' FROM src WHERE belief AND body <> '' UNION ALL SELECT doc_id, '#b0001', 'Read Ruth 1:2.', 'Ruth 1:2', '' FROM src WHERE belief)
SELECT CASE WHEN belief THEN 'beliefs' ELSE 'talks' END AS collection, source_id, source_id || tail AS id, title, md5(al.text) AS text_md5, refs AS scripture_refs,
  CASE WHEN belief THEN '' WHEN len(given) > 0 THEN array_to_string(given, '|') ELSE opening END AS primary_refs FROM al JOIN src USING (doc_id)"""


def bundle_checksums(spark: SparkSession, d: str) -> DataFrame:
    """Texts as the files of a bundle: their checksums, and the totals as a row without a path."""
    sums = bundle.checksums(_t(spark, d, "documents").select(F.concat(F.lit("t/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")))
    total = bundle.totals(sums).select(F.lit("").alias("path"), F.col("file_count").cast("string").alias("sha256"), F.col("total_bytes").alias("bytes"))
    return sums.unionByName(total)


CHECKSUMS = """SELECT 't/' || doc_id AS path, sha256(coalesce(text, '')) AS sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents
UNION ALL SELECT '', CAST(count(*) AS VARCHAR), CAST(coalesce(sum(strlen(coalesce(text, ''))), 0) AS BIGINT) FROM documents"""


def citation_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    kind = F.when(k % 3 == 0, "scripture").when(k % 3 == 1, "beliefs").otherwise("talks")
    cited, date = F.when(k % 2 == 0, F.concat(F.lit("c"), k.cast("string"))).otherwise(""), F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.col("source")).otherwise("2020-01-02")
    label = retrieval.citation_label(kind, cited, F.col("source"), date)
    return _t(spark, d, "documents").select("doc_id", label.alias("label"), retrieval.talk_citation(F.col("source"), F.when(k % 4 == 0, "A. B."), date).alias("talk"))


LABELS = """WITH x AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 'c' || doc_id ELSE '' END AS c, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN source ELSE '2020-01-02' END AS date FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN c ELSE array_to_string(list_filter([CASE WHEN c <> '' THEN c ELSE coalesce(source, '') END,
    CASE WHEN coalesce(date, '') <> CASE WHEN c <> '' THEN c ELSE coalesce(source, '') END THEN coalesce(date, '') ELSE '' END], lambda s: s <> ''), ' | ') END AS label,
  array_to_string(list_filter([source, CASE WHEN doc_id % 4 = 0 THEN 'A. B.' END, date], lambda s: s <> ''), ' | ') AS talk FROM x"""

QUERIES = [
    (catalog_new, CATALOG_NEW), (catalog_revisits, REVISITS), (catalog_tallies, TALLIES), (crawl_outcomes, OUTCOMES), (catalog_scan, CATALOG_SCAN), (attached_files, ATTACHED), (transcripts, TRANSCRIPTS),
    (stamped_chunks, STAMPED), (indexed_chunks, INDEXED), (bundle_checksums, CHECKSUMS), (citation_labels, LABELS),
]
