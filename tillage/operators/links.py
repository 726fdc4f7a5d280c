"""Links between passages through overlapping references. Tables of references have columns book, chapter, vs, ve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillage.functions.refs import WHOLE_CHAPTER, any_overlap, overlap
from tillage.tables import kept_table


def overlapping(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """a joined to b where references overlap: an equi join on the chapter, the verses as its condition. The
    reference kept is a's."""
    other = b.withColumnsRenamed({c: f"_{c}" for c in ("book", "chapter", "vs", "ve")})
    meet = F.col("vs").isNull() | F.col("_vs").isNull() | ((F.col("vs") <= F.col("_ve")) & (F.col("_vs") <= F.col("ve")))
    return a.join(other, (F.col("book") == F.col("_book")) & (F.col("chapter") == F.col("_chapter")) & meet, how).drop("_book", "_chapter", "_vs", "_ve")


#: SQL of whether references h and x of one chapter share a verse, and of how many verses one spans.
_MEET = "(h.vs IS NULL OR x.vs IS NULL OR (h.vs <= x.ve AND x.vs <= h.ve))"
_WIDTH = f"coalesce({{0}}.ve - {{0}}.vs, {WHOLE_CHAPTER})"

REFS = "array<struct<book:string,chapter:int,vs:int,ve:int>>"


def mentions(chunks: DataFrame, refs: str = "refs") -> DataFrame:
    """(source_id, chunk, pos, book, chapter, vs, ve): the references of chunks, one a row."""
    return chunks.select("source_id", "chunk", F.posexplode(refs).alias("pos", "r")).select("source_id", "chunk", "pos", "r.*")


def sustained_mentions(chunks: DataFrame, least: int = 2) -> DataFrame:
    """(source_id, place, book, chapter, vs, ve): what a source keeps coming back to beside its primary references, in order of sight.

    chunks: source_id, chunk, refs, primary, the last two as REFS. References gather around the first one
    seen of several that meet; such a cluster counts each chunk once, and a narrower reference that counts stands for
    it from then on. References can only meet within a chapter, so each (source, chapter) is a fold of its own, in SQL, and
    clusters of at least `least` chunks are put in order of sight afterwards. A reference that meets a primary one doesn't count.
    """
    beside = chunks.select("source_id", "chunk", F.filter("refs", lambda x: ~F.coalesce(F.exists("primary", lambda p: overlap(x, p)), F.lit(False))).alias("refs"))
    each = mentions(beside).groupBy("source_id", "book", "chapter").agg(F.array_sort(F.collect_list(F.struct("chunk", "pos", "vs", "ve"))).alias("seen"))
    counts = f"""CASE WHEN h.chunk = x.chunk THEN h ELSE named_struct('vs', IF({_WIDTH.format('x')} < {_WIDTH.format('h')}, x.vs, h.vs),
        've', IF({_WIDTH.format('x')} < {_WIDTH.format('h')}, x.ve, h.ve), 'chunk', x.chunk, 'n', h.n + 1, 'first', h.first, 'pos', h.pos) END"""
    fold = f"""aggregate(seen, cast(array() AS array<struct<vs:int,ve:int,chunk:int,n:int,first:int,pos:int>>), (heads, x) ->
        IF(exists(heads, h -> {_MEET}),
           transform(heads, (h, i) -> IF(i + 1 = array_position(transform(heads, h -> {_MEET}), true), {counts}, h)),
           concat(heads, array(named_struct('vs', x.vs, 've', x.ve, 'chunk', x.chunk, 'n', 1, 'first', x.chunk, 'pos', x.pos)))))"""
    heads = each.select("source_id", "book", "chapter", F.explode(F.expr(fold)).alias("h")).filter(F.col("h.n") >= least)
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("h.first", "h.pos")) - 1
    return heads.select("source_id", place.alias("place"), "book", "chapter", "h.vs", "h.ve")


def bridges(asides: DataFrame) -> DataFrame:
    """(question, rank, book, chapter, vs, ve): asides (question, source_rank, place and a reference) in order, without
    those that overlap one already taken, which again is a fold for each chapter."""
    each = asides.groupBy("question", "book", "chapter").agg(F.array_sort(F.collect_list(F.struct("source_rank", "place", "vs", "ve"))).alias("a"))
    kept = F.expr(f"aggregate(a, filter(a, x -> false), (t, x) -> IF(exists(t, h -> {_MEET}), t, concat(t, array(x))))")
    taken = each.select("question", "book", "chapter", F.explode(kept).alias("x"))
    rank = F.row_number().over(Window.partitionBy("question").orderBy("x.source_rank", "x.place")) - 1
    return taken.select("question", rank.alias("rank"), "book", "chapter", "x.vs", "x.ve")


def related_sources(bridge_refs: DataFrame, primaries: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """(question, source_id, bridge, rank): sources whose primary references overlap a bridge and that the question doesn't
    know yet, each once; the first bridge that reaches a source counts, then the source's least title and its id decide.

    bridge_refs: question, rank and a reference; primaries: source_id, title and a reference; known: question, source_id.
    Bridges and sources are not paired. Each different reference of a bridge is led to its first sources, which are those of the different
    references that overlap it; how many of either there are the books bound. A question looks up to `most` more of them than the sources it knows,
    which is enough whichever it knows.
    """
    ref = ["book", "chapter", "vs", "ve"]
    b = kept_table(bridge_refs.withColumnRenamed("rank", "bridge"), "bridges")
    primaries, known = kept_table(primaries, "primaries"), kept_table(known.select("question", "source_id"), "known")
    knows = known.groupBy("question").agg(F.count_distinct("source_id").alias("_knows"))
    reach = most + (knows.agg(F.max("_knows")).first()[0] or 0)

    def first_ones(rows: DataFrame, by: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("title", "source_id"))
        return rows.withColumn("_place", place).filter(F.col("_place") <= reach)

    named = primaries.groupBy("source_id").agg(F.min("title").alias("title"))
    about = primaries.select("source_id", *ref).distinct().join(named.withColumnRenamed("source_id", "_named"), F.col("source_id").eqNullSafe(F.col("_named"))).drop("_named")
    heads = first_ones(about, ref).select("source_id", "title", F.struct(*ref).alias("_of"))
    asked = b.select(*ref).distinct()
    led = overlapping(asked, primaries.select(*ref).distinct().withColumn("_of", F.struct(*ref))).select(*ref, "_of")
    led = led.join(heads.withColumnRenamed("_of", "_head"), F.col("_of").eqNullSafe(F.col("_head"))).select(F.struct(*ref).alias("_asked"), "source_id", "title").distinct()
    tops = first_ones(led, ["_asked"])
    b = b.join(knows, "question", "left").select("question", "bridge", F.struct(*ref).alias("_ref"), F.coalesce("_knows", F.lit(0)).alias("_knows"))
    hit = b.join(tops, F.col("_ref").eqNullSafe(F.col("_asked")) & (F.col("_place") <= F.col("_knows") + most))
    hit = hit.groupBy("question", "source_id").agg(F.min("bridge").alias("bridge"), F.min("title").alias("title"))
    hit = hit.join(known, ["question", "source_id"], "left_anti")
    order = Window.partitionBy("question").orderBy("bridge", "title", "source_id")
    return hit.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("title")


def best_window(refs: DataFrame, windows: DataFrame) -> DataFrame:
    """For each reference (ref_id, book, chapter, vs, ve) its best window (window_id, book, chapter, verse_start,
    verse_end): of a whole chapter the widest; else the narrowest that covers it, else the narrowest that overlaps."""
    w = windows.select("book", "chapter", "window_id", F.col("verse_start").alias("s"), F.col("verse_end").alias("e"))
    at = refs.join(w, ["book", "chapter"])
    width = F.col("e") - F.col("s")
    covers = (F.col("s") <= F.col("vs")) & (F.col("ve") <= F.col("e"))
    meets = (F.col("s") <= F.col("ve")) & (F.col("vs") <= F.col("e"))
    tier = F.when(F.col("vs").isNull() | covers, 0).when(meets, 1)
    rank = F.struct(tier, F.when(F.col("vs").isNull(), -width).otherwise(width), F.when(F.col("vs").isNull(), -F.col("s")).otherwise(F.col("s")), "window_id")
    return at.filter(tier.isNotNull()).groupBy("ref_id").agg(F.min_by("window_id", rank).alias("window_id"))


def cross_links(targets: DataFrame, windows: DataFrame, most: int = 2) -> DataFrame:
    """(question, citation, window_id, connection, score, rank): targets (ref_id, question, source_rank, place, citation of the
    source, score and a reference) resolved to their best windows, each window once, `most` for a question. Windows are told
    apart by `same`, if there is that column (their citation, say), else by their id."""
    at = best_window(targets, windows)
    at = at.join(windows.select("window_id", F.col("same")), "window_id") if "same" in windows.columns else at.withColumn("same", F.col("window_id"))
    found = targets.join(at, "ref_id")
    order = Window.partitionBy("question").orderBy("source_rank", "place", "ref_id")
    once = found.withColumn("_n", F.row_number().over(Window.partitionBy("question", "same").orderBy("source_rank", "place", "ref_id"))).filter("_n = 1")
    out = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return out.select("question", "citation", "window_id", F.concat(F.lit("Connected in "), "citation").alias("connection"), "score", "rank")


def grouped_hits(hits: DataFrame) -> DataFrame:
    """(question, source_id, source_rank, score, citation, primary, matched): a question's hits (question, place, source_id, score, citation,
    primary and refs, both as REFS) by source. Sources are in the order of their best scores, ties in that of their first hits; score,
    citation and primary are the first hit's, matched is what all of its hits refer to."""
    by = hits.groupBy("question", "source_id").agg(
        F.max("score").alias("best"), F.min(F.struct("place", "score", "citation", "primary")).alias("f"),
        F.flatten(F.collect_list("refs")).alias("matched"),
    )
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("best"), "f.place")) - 1
    return by.select("question", "source_id", rank.alias("source_rank"), "f.score", "f.citation", "f.primary", "matched")


def aside_refs(groups: DataFrame, sustained: DataFrame, asked: DataFrame) -> DataFrame:
    """(question, source_id, source_rank, place, book, chapter, vs, ve): what of a source's sustained references a question is
    about: those that meet one it asks for (asked: question, asked as REFS), or, if it asks for none, one of the matched windows.

    groups is grouped_hits, sustained is sustained_mentions of those sources.
    """
    at = groups.join(asked, "question", "left").join(sustained, "source_id")
    about = F.when(F.coalesce(F.size("asked"), F.lit(0)) > 0, F.col("asked")).otherwise(F.col("matched"))
    ref = F.struct("book", "chapter", "vs", "ve")
    hit = at.filter(F.coalesce(F.exists(about, lambda x: overlap(x, ref)), F.lit(False)))
    return hit.select("question", "source_id", "source_rank", "place", "book", "chapter", "vs", "ve")


def link_targets(groups: DataFrame, asides: DataFrame) -> DataFrame:
    """(ref_id, question, source_rank, place, citation, score and a reference): for each source with asides these, and then those
    of its primary references that meet no target before them."""
    ref = F.struct("book", "chapter", "vs", "ve")
    each = asides.groupBy("question", "source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", ref.alias("r")))), lambda x: x["r"]).alias("asides"))
    both = groups.join(each, ["question", "source_id"])
    targets = F.aggregate(F.coalesce("primary", F.filter("asides", lambda x: F.lit(False))), F.col("asides"), lambda t, x: F.when(any_overlap(F.array(x), t), t).otherwise(F.concat(t, F.array(x))))
    rows = both.select("question", "source_id", "source_rank", "citation", "score", F.posexplode(targets).alias("place", "r"))
    name = F.concat_ws(":", F.col("question").cast("string"), F.col("source_rank").cast("string"), F.col("place").cast("string"))
    return rows.select(name.alias("ref_id"), "question", "source_rank", "place", "citation", "score", "r.*")


def quoting_chunk(related: DataFrame, chunks: DataFrame) -> DataFrame:
    """related (question, source_id, rank and the reference that led there) with chunk, the first of the source's chunks (source_id,
    chunk, refs) that quotes the reference, or its first one."""
    ref = F.struct("book", "chapter", "vs", "ve")
    at = related.join(chunks.select("source_id", "chunk", "refs"), "source_id")
    quotes = F.coalesce(F.exists("refs", lambda x: overlap(x, ref)), F.lit(False))
    return at.groupBy(*related.columns).agg(F.min(F.struct((~quotes).alias("other"), "chunk")).alias("m")).select(*related.columns, F.col("m.chunk").alias("chunk"))
