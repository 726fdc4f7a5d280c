"""Work-log analytics: change logs, work lists and what to do next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The steps of an item in order, and the states of a step.
STEPS = ["discovered", "page_saved", "audio_downloaded", "transcribed", "chunked", "indexed"]
STATUSES = ["pending", "done", "failed", "skipped"]


def step_ordinal(step: Column) -> Column:
    """0 for the first step, -1 for one that isn't known."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in STEPS]), step), F.lit(0)) - 1, F.lit(-1)).cast("int")


def at_least(step: Column, least: str) -> Column:
    return step_ordinal(step) >= STEPS.index(least)


def advanced(step: Column, to: Column) -> Column:
    """The later of two steps: items never go back."""
    return F.when(step_ordinal(to) > step_ordinal(step), to).otherwise(step)


def latest_per_key(log: DataFrame, key: str, *seq: str) -> DataFrame:
    """Each key's last record by seq, as whole rows. max_by aggregates before it shuffles, so a hot key is cheap."""
    row = F.struct(*log.columns)
    return log.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(*seq)).alias("r")).select("r.*")


def first_per_key(log: DataFrame, key: str, *seq: str) -> DataFrame:
    row = F.struct(*log.columns)
    return log.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.struct(*seq)).alias("r")).select("r.*")


def pending(jobs: DataFrame, before: str | None = None) -> DataFrame:
    """Items whose step isn't done and, if asked, isn't yet at `before`; in order of date and id."""
    found = jobs.filter(F.col("status") != "done")
    found = found.filter(step_ordinal(F.col("step")) < STEPS.index(before)) if before else found
    return found.orderBy("date", "id")


def candidates(jobs: DataFrame, action: str, force: bool = False) -> DataFrame:
    """The items that an action (download, transcribe or index) takes: those that are at its step and not beyond. force takes
    those beyond too, but nothing is downloaded again once it is transcribed."""
    step = F.col("step")
    if action == "download":
        return jobs.filter((F.coalesce("audio_url", F.lit("")) != "") & ~at_least(step, "transcribed") & (F.lit(force) | ~at_least(step, "audio_downloaded")))
    if action == "transcribe":
        return jobs.filter(at_least(step, "audio_downloaded") & (F.lit(force) | ~at_least(step, "transcribed")))
    if action == "index":
        return jobs.filter(at_least(step, "transcribed") & (F.lit(force) | ~at_least(step, "indexed")))
    raise ValueError(f"no such action: {action}")


def tally(jobs: DataFrame) -> DataFrame:
    """(name, n): items by step, by status:<status>, and in total. One pass over the items."""
    counted = jobs.groupingSets([["step"], ["status"], []], "step", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 1, F.col("step")).when(F.col("g") == 2, F.concat(F.lit("status:"), "status")).otherwise("total")
    return counted.select(name.alias("name"), "n")


def worklist(jobs: DataFrame) -> DataFrame:
    """One row of counts: need_audio (failed ones included), need_transcribe, need_index, failed."""
    step = step_ordinal(F.col("step"))
    at = STEPS.index
    return jobs.agg(
        F.count_if(step < at("audio_downloaded")).alias("need_audio"),
        F.count_if((step == at("audio_downloaded")) & (F.col("status") != "failed")).alias("need_transcribe"),
        F.count_if((step >= at("transcribed")) & (step < at("indexed")) & (F.col("status") != "failed")).alias("need_index"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def next_action(counts: DataFrame) -> DataFrame:
    """counts (need_*, queued_listings, queued_messages, has_verses) with processable, total and action."""
    action = (
        F.when(F.col("need_transcribe") > 0, "transcribe")
        .when(F.col("need_audio") > 0, "download")
        .when(F.col("queued_messages") > 0, "crawl_messages")
        .when(F.col("queued_listings") > 0, "discover")
        .when(F.col("need_index") > 0, "index")
        .when(~F.col("has_verses"), "verses")
        .otherwise("idle")
    )
    processable = F.col("need_transcribe") + F.col("need_audio") + F.col("need_index")
    return counts.withColumns({"processable": processable, "total": processable + F.col("queued_listings") + F.col("queued_messages"), "action": action})


def requeue_missing(jobs: DataFrame, files: DataFrame, path: str = "audio_path") -> DataFrame:
    """Items past the first step whose file isn't listed start again at the first step. files: (path)."""
    lost = jobs.filter((F.col(path) != "") & (step_ordinal(F.col("step")) > 0)).join(files.select(F.col("path").alias("_path")).distinct(), F.col(path) == F.col("_path"), "left_anti")
    return lost.withColumns({"step": F.lit(STEPS[0]), "status": F.lit("pending"), path: F.lit("")})


def attach_files(jobs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with the file whose stem is their id, files of no item). Transcribed items keep theirs."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    staged = files.select("path", stem.alias("_stem"))
    hit = jobs.filter(~at_least(F.col("step"), "transcribed")).join(staged, F.col("id") == F.col("_stem"))
    hit = hit.withColumns({"audio_path": F.col("path"), "step": advanced(F.col("step"), F.lit("audio_downloaded"))}).drop("path", "_stem")
    return hit, staged.join(jobs, F.col("id") == F.col("_stem"), "left_anti").select("path")


def merge_by_key(rows: DataFrame, key: str, url: str, *seq: str) -> DataFrame:
    """One row for each key: the first url seen and the other ones, in order, each once. Repeats are dropped before a key is gathered."""
    once = rows.groupBy(key, url).agg(F.min(F.struct(*seq)).alias("_seq"))
    seen = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_seq", url))).alias("s"))
    urls = F.transform("s", lambda x: x[url])
    return seen.select(key, F.get(urls, F.lit(0)).alias(url), F.slice(urls, F.lit(2), F.size(urls)).alias("alt_urls"))


def stalls(cycles: DataFrame, *signature: str, order: str = "cycle", group: str | None = None, repeats: int = 2) -> DataFrame:
    """cycles with `same` (equal to the cycle before) and `stop` (so for `repeats` cycles running)."""
    w = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(order)
    sig = F.struct(*signature)
    out = cycles.withColumn("same", F.coalesce(sig == F.lag(sig).over(w), F.lit(False)))
    return out.withColumn("stop", F.min(F.col("same").cast("int")).over(w.rowsBetween(1 - repeats, 0)).cast("boolean") & (F.row_number().over(w) > repeats))
