"""From long texts to citable passages. Sentence packing is a fold over one text's sentences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.functions.refs import extract_refs
from tillage.functions.text import sentences, strip, token_count

#: Texts whose sentences are Python objects at a time.
BATCH_TEXTS = 64


def windows_of(counts: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) sentence ranges. A window closes before the sentence that would pass the target; the next one
    starts with the longest run of its last sentences that fits the overlap."""
    out, start, total = [], 0, 0
    for i, n in enumerate(counts):
        if i > start and total + n > target:
            out.append((start, i))
            kept, carry = i, 0
            while kept > start and carry + counts[kept - 1] <= overlap:
                kept -= 1
                carry += counts[kept]
            start, total = kept, carry
        total += n
    if start < len(counts):
        out.append((start, len(counts)))
    return out


def pack_sentences(docs: DataFrame, key: str, text: str, target: int, overlap: int) -> DataFrame:
    """(key, chunk, text, tokens): each text's sentences packed into windows. A text's sentences and token counts come
    from built-in functions; only the fold is Python."""
    cut = docs.select(F.col(key).alias("k"), sentences(F.coalesce(F.col(text), F.lit(""))).alias("s"))
    cut = cut.select("k", "s", F.transform("s", token_count).alias("n"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, BATCH_TEXTS) for whole in batches for at in range(0, whole.num_rows, BATCH_TEXTS)):
            keys, chunk, texts, tokens = [], [], [], []
            for i, (s, n) in enumerate(zip(b.column("s").to_pylist(), b.column("n").to_pylist())):
                for c, (a, z) in enumerate(windows_of(n, target, overlap)):
                    keys.append(i)
                    chunk.append(c)
                    texts.append(" ".join(s[a:z]))
                    tokens.append(sum(n[a:z]))
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(keys, pa.int64())), pa.array(chunk, pa.int32()), pa.array(texts, pa.string()), pa.array(tokens, pa.int32())], names=[key, "chunk", "text", "tokens"])

    return cut.mapInArrow(run, f"`{key}` {kind}, chunk int, text string, tokens int")


def talk_windows(docs: DataFrame, key: str = "source_id", text: str = "text", target: int = 1000, overlap: int = 150) -> DataFrame:
    """Overlapping windows of a talk, with ids `<key>#c0000` and the references of their own text."""
    named = pack_sentences(docs, key, text, target, overlap).withColumn("id", F.concat(F.col(key).cast("string"), F.lit("#c"), F.lpad(F.col("chunk").cast("string"), 4, "0")))
    return named.withColumn("scripture_refs", extract_refs(F.col("text")))


def page_sections(pages: DataFrame, key: str = "url", most: int = 900) -> DataFrame:
    """Chunks of a page's sections (title, sections array<struct<heading, body>>): one for each section with a body, cut by
    sentences without overlap where it is longer than `most`. Ids `<key>#s0000` count the chunks given."""
    each = pages.select(key, "title", F.posexplode("sections").alias("place", "x")).filter(strip(F.col("x.body")) != "")
    each = each.withColumns({"label": F.when(F.col("x.heading") != "", F.concat_ws(" — ", "title", "x.heading")).otherwise(F.col("title")), "body": strip(F.col("x.body"))})
    each = each.withColumn("unit", F.struct(F.col(key).alias("k"), "place", "label"))
    short = each.filter(token_count(F.col("body")) <= most).select("unit", F.lit(0).alias("chunk"), F.col("body").alias("text"), token_count(F.col("body")).alias("tokens"))
    packed = pack_sentences(each.filter(token_count(F.col("body")) > most), "unit", "body", most, 0)
    both = short.unionByName(packed.select("unit", "chunk", "text", "tokens"))
    number = F.row_number().over(Window.partitionBy("unit.k").orderBy("unit.place", "chunk")) - 1
    return both.select(F.col("unit.k").alias(key), F.concat(F.col("unit.k").cast("string"), F.lit("#s"), F.lpad(number.cast("string"), 4, "0")).alias("id"), F.col("unit.label").alias("label"), "text", "tokens", extract_refs(F.col("text")).alias("scripture_refs"))


def belief_sections(pages: DataFrame, key: str = "url") -> DataFrame:
    """One uncut chunk for each section with a body; ids `<key>#b0000` are the section's place, gaps included."""
    each = pages.select(key, F.posexplode("sections").alias("place", "x")).filter(strip(F.col("x.body")) != "")
    return each.select(key, F.concat(F.col(key).cast("string"), F.lit("#b"), F.lpad(F.col("place").cast("string"), 4, "0")).alias("id"), F.col("x.heading").alias("heading"), strip(F.col("x.body")).alias("text"))


def primary_from_opening(first: Column, second: Column) -> Column:
    """What a talk is about, from the references of its first two chunks: those in both, else the first one seen."""
    first, second = (F.coalesce(c, F.array().cast("array<string>")) for c in (first, second))
    both = F.array_intersect(first, second)
    return F.when(F.size(both) > 0, both).otherwise(F.slice(F.concat(first, second), 1, 1))


def primary_refs(title: Column, page_refs: Column, page_title: Column, item_refs: Column) -> Column:
    """What an item is about by its title, its page and its record, in this order, each reference once; blanks are dropped."""
    none = F.array().cast("array<string>")
    found = F.concat(extract_refs(F.coalesce(title, F.lit(""))), F.coalesce(page_refs, none), extract_refs(F.coalesce(page_title, F.lit(""))), F.coalesce(item_refs, none))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def stamped(chunks: DataFrame, sources: DataFrame, key: str = "source_id", order: str = "chunk") -> DataFrame:
    """chunks (key, order, scripture_refs) with primary_refs: their source's (sources: key, primary_refs), or if it has none
    what its first two chunks open with."""
    two = chunks.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n <= 2")
    opening = two.groupBy(key).agg(F.max(F.when(F.col("_n") == 1, F.col("scripture_refs"))).alias("_a"), F.max(F.when(F.col("_n") == 2, F.col("scripture_refs"))).alias("_b"))
    given = F.filter(F.coalesce("primary_refs", F.array().cast("array<string>")), lambda x: F.coalesce(strip(x), F.lit("")) != "")
    best = F.when(F.size(given) > 0, given).otherwise(primary_from_opening(F.col("_a"), F.col("_b")))
    return chunks.join(opening, key).join(sources.select(key, "primary_refs"), key, "left").withColumn("primary_refs", best).drop("_a", "_b")


def verse_chunks(verses: DataFrame, size: int = 6, stride: int = 3) -> DataFrame:
    """Chunks of chapters (book, chapter, verse, text): each whole chapter (kind chapter) and, of longer ones, windows of
    `size` verses at every `stride`, until one reaches the end. Of repeated verses the last by `seq`, if there is
    that column, counts, else the greatest text (rows have no order of their own)."""
    pick = F.max_by("text", F.col("seq")) if "seq" in verses.columns else F.max("text")
    one = verses.groupBy("book", "chapter", "verse").agg(pick.alias("text"))
    chapters = one.groupBy("book", "chapter").agg(F.array_sort(F.collect_list(F.struct("verse", "text"))).alias("v"))
    n = F.size("v")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)), lambda s: (n > size) & (n - s >= 2) & ((s == 0) | (s - stride + size < n)))
    ranges = F.concat(F.array(F.struct(F.lit("chapter").alias("kind"), F.lit(0).alias("at"), n.alias("n"))), F.transform(starts, lambda s: F.struct(F.lit("window").alias("kind"), s.alias("at"), F.lit(size).alias("n"))))
    each = chapters.select("book", "chapter", "v", F.explode(ranges).alias("r")).withColumn("w", F.slice("v", F.col("r.at") + 1, F.col("r.n")))
    first, last = F.get(F.col("w"), F.lit(0))["verse"], F.get(F.col("w"), F.size("w") - 1)["verse"]
    name = F.concat(F.lit("verses:"), F.col("book").cast("string"), F.lit("."), F.col("chapter").cast("string"))
    return each.select(
        F.when(F.col("r.kind") == "chapter", name).otherwise(F.concat(name, F.lit("."), first.cast("string"), F.lit("-"), last.cast("string"))).alias("id"),
        "book", "chapter", first.alias("verse_start"), last.alias("verse_end"), F.col("r.kind").alias("kind"),
        F.array_join(F.transform("w", lambda x: F.concat_ws(" ", x["verse"].cast("string"), x["text"])), " ").alias("text"),
    )


def transcript_text(transcripts: DataFrame, segments: str = "segments") -> DataFrame:
    """Segments trimmed, blank ones dropped, times rounded to hundredths, and their text joined."""
    kept = F.filter(F.transform(segments, lambda s: F.struct(F.round(s["start"], 2).alias("start"), F.round(s["end"], 2).alias("end"), strip(s["text"]).alias("text"))), lambda s: s["text"] != "")
    return transcripts.withColumn(segments, kept).withColumn("text", F.array_join(F.transform(segments, lambda s: s["text"]), " "))


TRANSCRIPT = "text string, segments array<struct<start:double,end:double,text:string>>, duration double, language string"


def read_transcripts(files: DataFrame) -> DataFrame:
    """(path, text, segments, duration, language) of files (path, value: a whole file of JSON, as spark.read.text with wholetext gives it).

    The text is that of the segments, cleaned (see transcript_text), or where there are none the file's own. A file that isn't JSON has none of these."""
    parsed = files.select("path", F.from_json("value", TRANSCRIPT, {"mode": "PERMISSIVE"}).alias("t")).select("path", "t.*")
    own = strip(F.coalesce("text", F.lit("")))
    clean = transcript_text(parsed.withColumns({"_own": own, "segments": F.coalesce("segments", F.array().cast("array<struct<start:double,end:double,text:string>>"))}))
    return clean.withColumn("text", F.when(F.size("segments") > 0, F.col("text")).otherwise(F.col("_own"))).select("path", "text", "segments", "duration", "language")


def routed_chunks(items: DataFrame) -> DataFrame:
    """Which chunks of an item are indexed, and where: items has is_belief, has_transcript. A belief page's sections
    go to beliefs; else a transcript's windows, or without one the page's sections, go to talks."""
    kind = F.when(F.col("is_belief"), "beliefs").otherwise("talks")
    use = F.when(F.col("is_belief"), "sections").when(F.col("has_transcript"), "transcript").otherwise("sections")
    return items.withColumns({"collection": kind, "use": use})


def indexed_chunks(items: DataFrame, pages: DataFrame, transcripts: DataFrame, target: int = 1000, overlap: int = 150, most: int = 900) -> DataFrame:
    """(collection, source_id, id, title, text, scripture_refs, primary_refs) of items, joined with their pages and transcripts by path.

    items: id, kind, title, page_path, transcript_path, scripture_refs. pages: path, title, sections, scripture_refs. transcripts: path, title, text.
    A belief's page is cut by its sections. Of other items the transcript is cut into windows, or, where there is none or an empty one,
    the page's sections are. What an item says for itself goes before its page, the page before the transcript.
    """
    p = pages.select(F.col("path").alias("page_path"), F.col("title").alias("page_title"), "sections", F.col("scripture_refs").alias("page_refs"))
    t = transcripts.select(F.col("path").alias("transcript_path"), F.col("title").alias("said_title"), F.col("text").alias("said"))
    blank = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    at = items.join(p, "page_path", "left").join(t, "transcript_path", "left").withColumns({
        "primary_refs": primary_refs(F.col("title"), F.col("page_refs"), F.col("page_title"), F.col("scripture_refs")),
        "is_belief": F.col("kind") == "belief", "has_transcript": F.coalesce(strip(F.col("said")) != "", F.lit(False)),
    })
    at = at.withColumn("title", F.coalesce(blank("title"), F.when(F.col("has_transcript") & ~F.col("is_belief"), blank("said_title")), blank("page_title"), F.lit("")))
    at = routed_chunks(at).withColumn("source_id", F.when(F.col("use") == "transcript", F.col("id")).otherwise(F.concat("id", F.lit(":page"))))
    sources = at.select("source_id", "collection", "title", "primary_refs")
    said = talk_windows(at.filter("use = 'transcript'").select("source_id", strip(F.col("said")).alias("text")), target=target, overlap=overlap)
    read = page_sections(at.filter("use = 'sections' and not is_belief").select("source_id", "title", "sections"), "source_id", most)
    held = belief_sections(at.filter("is_belief").select("source_id", "sections"), "source_id").withColumn("scripture_refs", extract_refs(F.col("text")))
    pick = ["source_id", "id", "text", "scripture_refs"]
    both = stamped(said.select(*pick).unionByName(read.select(*pick)), sources, order="id")
    none = F.array().cast("array<string>")
    every = both.unionByName(held.select(*pick).withColumn("primary_refs", none))
    return every.join(sources.select("source_id", "collection", "title"), "source_id").select("collection", "source_id", "id", "title", "text", "scripture_refs", "primary_refs")
