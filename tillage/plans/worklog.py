"""Queries over the event log as a work log, and over conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.operators import retrieval, state
from tillage.streaming import stalls
from tillage.tables import scratch_dir


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _log(spark: SparkSession, d: str) -> DataFrame:
    step = F.create_map(*[F.lit(x) for kv in (("signup", "discovered"), ("view", "page_saved"), ("click", "audio_downloaded"), ("purchase", "indexed")) for x in kv])
    return _t(spark, d, "events").select(
        F.col("user_id").alias("id"), "event_id", "ts", F.coalesce(F.try_element_at(step, F.col("event_type")), F.lit("transcribed")).alias("step"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 15, "done").otherwise("pending").alias("status"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
    )


LOG = """log AS (SELECT user_id AS id, event_id, ts, CASE event_type WHEN 'signup' THEN 'discovered' WHEN 'view' THEN 'page_saved' WHEN 'click' THEN 'audio_downloaded'
    WHEN 'purchase' THEN 'indexed' ELSE 'transcribed' END AS step, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 15 THEN 'done' ELSE 'pending' END AS status,
    strftime(ts, '%Y-%m-%d') AS date FROM events),
  jobs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS rn FROM log WHERE id IS NOT NULL) WHERE rn = 1),
  o AS (SELECT *, CASE step WHEN 'discovered' THEN 0 WHEN 'page_saved' THEN 1 WHEN 'audio_downloaded' THEN 2 WHEN 'transcribed' THEN 3 WHEN 'chunked' THEN 4 ELSE 5 END AS k FROM jobs)"""


def jobs_of(spark: SparkSession, d: str) -> DataFrame:
    return state.latest_per_key(_log(spark, d), "id", "ts", "event_id")


def log_latest(spark: SparkSession, d: str) -> DataFrame:
    return jobs_of(spark, d).drop("ts")


LOG_LATEST = f"WITH {LOG} SELECT id, event_id, step, status, date FROM jobs"


def log_first(spark: SparkSession, d: str) -> DataFrame:
    return state.first_per_key(_log(spark, d), "id", "ts", "event_id").drop("ts")


LOG_FIRST = f"""WITH {LOG} SELECT id, event_id, step, status, date FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS rn FROM log WHERE id IS NOT NULL) WHERE rn = 1"""


def step_tally(spark: SparkSession, d: str) -> DataFrame:
    return state.tally(jobs_of(spark, d))


STEP_TALLY = f"""WITH {LOG} SELECT step AS name, count(*) AS n FROM jobs GROUP BY step UNION ALL SELECT 'status:' || status, count(*) FROM jobs GROUP BY status
UNION ALL SELECT 'total', count(*) FROM jobs"""


def worklist(spark: SparkSession, d: str) -> DataFrame:
    return state.worklist(jobs_of(spark, d))


WORKLIST_BODY = """SELECT count(*) FILTER (k < 2) AS need_audio, count(*) FILTER (k = 2 AND status <> 'failed') AS need_transcribe,
  count(*) FILTER (k >= 3 AND k < 5 AND status <> 'failed') AS need_index, count(*) FILTER (status = 'failed') AS failed FROM o"""
WORKLIST = f"WITH {LOG} {WORKLIST_BODY}"


def next_action(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "pages").agg(F.count_if(F.col("url").contains("/en/")).alias("queued_listings"), F.count_if(~F.col("url").contains("/en/")).alias("queued_messages"))
    counts = state.worklist(jobs_of(spark, d)).crossJoin(pages).withColumn("has_verses", F.lit(True))  # one row beside one row
    return state.next_action(counts).drop("has_verses")


NEXT_ACTION = f"""WITH {LOG}, w AS ({WORKLIST_BODY}), q AS (SELECT count(*) FILTER (contains(url, '/en/')) AS queued_listings, count(*) FILTER (NOT contains(url, '/en/')) AS queued_messages FROM pages)
SELECT need_audio, need_transcribe, need_index, failed, queued_listings, queued_messages, need_transcribe + need_audio + need_index AS processable,
  need_transcribe + need_audio + need_index + queued_listings + queued_messages AS total,
  CASE WHEN need_transcribe > 0 THEN 'transcribe' WHEN need_audio > 0 THEN 'download' WHEN queued_messages > 0 THEN 'crawl_messages' WHEN queued_listings > 0 THEN 'discover'
    WHEN need_index > 0 THEN 'index' ELSE 'idle' END AS action FROM w, q"""


def pending_jobs(spark: SparkSession, d: str) -> DataFrame:
    return state.pending(jobs_of(spark, d), "transcribed").select("id", "date", "step", "status")


PENDING_JOBS = f"WITH {LOG} SELECT id, date, step, status FROM o WHERE status <> 'done' AND k < 3"


def requeue_missing(spark: SparkSession, d: str) -> DataFrame:
    jobs = jobs_of(spark, d).withColumn("audio_path", F.concat(F.lit("audio/"), F.col("id").cast("string"), F.lit(".mp3")))
    files = _t(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.concat(F.lit("audio/"), F.col("c_custkey").cast("string"), F.lit(".mp3")).alias("path"))
    return state.requeue_missing(jobs, files).select("id", "step", "status", "audio_path")


REQUEUE = f"""WITH {LOG} SELECT id, 'discovered' AS step, 'pending' AS status, '' AS audio_path FROM o
WHERE k > 0 AND id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)"""


def stall_lag(spark: SparkSession, d: str) -> DataFrame:
    daily = _t(spark, d, "events").groupBy(F.to_date("ts").alias("cycle"), "user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "view").alias("views"))
    return state.stalls(daily, "errors", "views", group="user_id").withColumn("cycle", F.col("cycle").cast("string"))


STALL_LAG = """
WITH d AS (SELECT CAST(ts AS DATE) AS cycle, user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS views FROM events GROUP BY ALL),
s AS (SELECT *, coalesce(errors = lag(errors) OVER w AND views = lag(views) OVER w, false) AS same, row_number() OVER w AS rn FROM d WINDOW w AS (PARTITION BY user_id ORDER BY cycle))
SELECT CAST(cycle AS VARCHAR) AS cycle, user_id, errors, views, same, bool_and(same) OVER (PARTITION BY user_id ORDER BY cycle ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AND rn > 2 AS stop FROM s"""


def stall_stream(spark: SparkSession, d: str) -> DataFrame:
    """The guard as a stream over events: each event is a cycle of its user."""
    out = f"{scratch_dir(spark).rstrip('/')}/stall-stream-{uuid.uuid4().hex}"
    cycles = _t(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    cycles.write.parquet(f"{out}/cycles")  # a folder, which a stream of files needs
    found = stalls.stall_stream(spark.readStream.schema(cycles.schema).parquet(f"{out}/cycles"), "user_id", "ts", ["event_type"], tie="event_id")
    with stalls.state_in_rocksdb(spark):
        stream = found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        stream.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{out}/rows").select("user_id", "event_id", "event_type", "same", "stalled", "stop")


STALL_STREAM = """
WITH s AS (SELECT *, coalesce(event_type = lag(event_type) OVER w, false) AS same FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, count(*) FILTER (NOT same) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT user_id, event_id, event_type, same, CAST(count(*) FILTER (same) OVER w AS INT) AS stalled, count(*) FILTER (same) OVER w >= 2 AS stop FROM g
WINDOW w AS (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""


def merged_urls(spark: SparkSession, d: str) -> DataFrame:
    from tillage.functions.urls import canonical_path

    p = _t(spark, d, "pages").select(canonical_path(F.col("url")).alias("key"), "page_id", "url")
    return state.merge_by_key(p, "key", "url", "page_id").select("key", "url", F.array_join("alt_urls", " ").alias("alt_urls"))


MERGED_URLS = r"""
WITH p AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS k FROM pages),
f AS (SELECT CASE WHEN k = '' THEN '/' WHEN starts_with(k, '/about/') THEN substr(k, 7) ELSE k END AS key, url, min(page_id) AS page_id FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page_id) AS rn FROM f)
SELECT key, max(url) FILTER (rn = 1) AS url, coalesce(string_agg(url, ' ' ORDER BY rn) FILTER (rn > 1), '') AS alt_urls FROM r GROUP BY key"""


def history_last6(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.last_turns(_t(spark, d, "conversations")).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


HISTORY = "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6"

QUERIES = [
    (log_latest, LOG_LATEST), (log_first, LOG_FIRST), (step_tally, STEP_TALLY), (worklist, WORKLIST), (next_action, NEXT_ACTION), (pending_jobs, PENDING_JOBS),
    (requeue_missing, REQUEUE), (stall_lag, STALL_LAG), (stall_stream, STALL_STREAM), (merged_urls, MERGED_URLS), (history_last6, HISTORY),
]
