"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in Spark SQL.

Documents are dealt into blocks by a hash (16 a shard), so everything that is planned is planned on small tables: sources,
blocks and shards. A source's blocks stand in a permuted order, anew for each pass over
the source; its target says how many blocks it gives, passes included. A tree then
splits these exact quotas among the shards. A node of the tree puts its blocks into an order by a hash of its own and cuts it into
equal runs, one for each child: a child's quotas are how many blocks of each source its run holds, which is a multivariate
hypergeometric draw, and the children divide theirs in turn. A shard takes the next blocks of each
source's permuted order, so shards are disjoint, and shuffles its documents by a hash.

In the last pass a source gives blocks in permuted order as long as they fit whole and trims one more to its documents.
Orders and running sums are made in two steps, bins of a hash first and then the rows of a bin, so that no task sorts all blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.llm.common import written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Shards and blocks of a small corpus. A large one has a shard for each SHARD_WORDS words, in powers of two, and
#: BLOCKS_PER_SHARD blocks for each.
SHARDS = 16
BLOCKS = 4096
SHARD_WORDS = 1 << 23
BLOCKS_PER_SHARD = 16
#: Children of a node of the tree (a power of two), and rows that share a bin of a hash, about.
CHILDREN = 16
BIN_ROWS = 512
#: How often the last pass of a source is filled up with blocks that fit.
FILLS = 2
SEED = 2024
WORD = r"[^\x20\x09-\x0D]+"


def shards_for(words: int) -> int:
    """A power of two, SHARDS at least: as many shards as hold SHARD_WORDS words each."""
    return max(SHARDS, 1 << max(0, (-(-words // SHARD_WORDS) - 1).bit_length()))


def _layout(sized: DataFrame, shards: int | None, blocks: int | None) -> tuple[int, int]:
    shards = shards or shards_for(sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    return shards, blocks or max(BLOCKS, BLOCKS_PER_SHARD * shards)


def running(rows: DataFrame, group: list[str], order: str, ties: list[str], value: Column, bins: int) -> DataFrame:
    """rows with _before, the sum of value over the rows of their group that come earlier by order (a hash, a bigint) and ties.

    bins is about the number of bins that the hashes of all groups are cut into; a group's sums over whole bins
    and a bin's own rows are then two small windows.
    """
    binned = rows.withColumns({"_bin": F.floor((F.col(order) / float(1 << 64) + 0.5) * bins), "_value": value})
    at = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    base = binned.groupBy(*group, "_bin").agg(F.sum("_value").alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(at), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*group, "_bin").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    inside = binned.withColumn("_inside", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return inside.join(base, [*group, "_bin"]).withColumn("_before", F.col("_base") + F.col("_inside")).drop("_bin", "_value", "_base", "_inside")


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, blocks: int = BLOCKS) -> DataFrame:
    """One row for each source (nulls are a source): place, source_size, target and n_blocks.

    Sources by code point, null last, weigh the weights in turn and share all
    words; a target stops at `most` times its source's size and what is over
    is shared by weight among the others, until none is above.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    by_limit = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", (F.row_number().over(every) - 1).cast("int"))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("all", F.sum("source_size").over(whole).cast("double"))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(by_limit), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(by_limit), F.lit(0.0))))
        .withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
        .withColumn("rest", F.col("all") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole))
        .withColumn("open", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(whole))
        .withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("rest") / F.col("open")))
        .withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") * F.lit(blocks) / F.greatest(F.col("all"), F.lit(1.0)))).cast("int"))
        .select("source", "place", "source_size", "target", "n_blocks")
    )


def _block(seed: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.col("n_blocks")).cast("int")


def drawn_blocks(blocks: DataFrame, most: int = MOST_REPEATS, seed: int = SEED, bins: int = 8) -> DataFrame:
    """(place, pass, block, seq, takes): the blocks that each source gives, in permuted order.

    blocks has place, block, words, source_size and target. A source
    gives all its blocks in each whole pass that its target holds. In the last pass
    it gives blocks in permuted order as long as their words fit, then, FILLS times in all, of the others those that are no larger than
    what is left; the smallest that is larger is trimmed: takes is null for a whole block and else the words still wanted.
    """
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size") + 1e-9))).otherwise(0).cast("int")
    every = blocks.withColumn("passes", passes).withColumn("wanted", F.col("target") - F.col("passes") * F.col("source_size"))
    hashed = lambda rows: rows.withColumn("h", F.xxhash64("place", "pass", "block", F.lit(seed)))
    rest = hashed(every.filter("wanted > 1e-6 * target and words > 0").withColumn("pass", F.col("passes"))).withColumn("left", F.col("wanted").cast("double"))
    rest = rest.select("place", "pass", "block", "h", "words", "left")
    taken = None
    for _ in range(FILLS):
        fits = running(rest.filter("words <= left"), ["place"], "h", ["block"], F.col("words"), bins)
        fits = written(fits.filter(F.col("_before") + F.col("words") <= F.col("left")).drop("_before"), "fits")
        taken = fits if taken is None else taken.unionByName(fits)
        used = fits.groupBy("place").agg(F.sum("words").alias("used"))
        rest = rest.join(fits.select("place", "block"), ["place", "block"], "left_anti").join(used, "place", "left")
        rest = written(rest.withColumn("left", F.col("left") - F.coalesce("used", F.lit(0))).drop("used"), "rest")
    least = rest.filter("left > 1e-6 and words > left").groupBy("place").agg(F.min(F.struct("words", "h", "block", "pass", "left")).alias("x"))
    trimmed = least.select("place", "x.pass", "x.block", "x.h", F.col("x.left").alias("takes"))
    last = taken.select("place", "pass", "block", "h", F.lit(None).cast("double").alias("takes")).unionByName(trimmed)
    whole = hashed(every.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).filter("pass < passes"))
    given = whole.select("place", "pass", "block", "h", F.lit(None).cast("double").alias("takes")).unionByName(last)
    ordered = running(given, ["place", "pass"], "h", ["block"], F.lit(1), bins)
    of_pass = given.groupBy("place", "pass").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("place").orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)
    of_pass = of_pass.withColumn("_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return ordered.join(of_pass, ["place", "pass"]).withColumn("seq", F.col("_from") + F.col("_before")).drop("h", "_from", "_before")


def split_quotas(tree: DataFrame, children: int, level: int, seed: int, bins: int) -> DataFrame:
    """The quotas (node, place, n) of the next level: child c of a node is node x children + c.

    Every block of a quota gets a number by a hash of node, level, source and its own place in the quota. In the order of these a
    node's blocks are cut into runs, whose sizes differ by one block at most.
    """
    items = tree.select("node", "place", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("j"))
    items = items.withColumn("h", F.xxhash64("node", F.lit(level), "place", "j", F.lit(seed)))
    totals = tree.groupBy("node").agg(F.sum("n").alias("total"))
    ranked = running(items, ["node"], "h", ["place", "j"], F.lit(1).cast("bigint"), bins).join(totals, "node")
    child = F.col("node") * children + F.floor(F.col("_before") * children / F.col("total"))
    return ranked.groupBy(child.cast("bigint").alias("node"), "place").agg(F.count("*").alias("n"))


def shard_quotas(drawn: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(place, shard, first, quota): how many of each source's drawn blocks each shard takes, and from which on; shards that
    take none of a source have no row for it.

    shards is a power of two. The quotas of a source add up to its drawn blocks and
    shards differ by one block for each level of the tree at most.
    """
    levels = shards.bit_length() - 1
    if 1 << levels != shards:
        raise ValueError("the number of shards is a power of two")
    tree = written(drawn.groupBy("place").agg(F.count("*").alias("n")).select(F.lit(0).cast("bigint").alias("node"), "place", "n"), "tree")
    bins = max(1, -(-(tree.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // BIN_ROWS))
    level, width = 0, 1
    while width < shards:
        children = min(CHILDREN, shards // width)
        tree = written(split_quotas(tree, children, level, seed, max(1, bins // width)), "tree")
        level, width = level + 1, width * children
    before = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    leaf = tree.select("place", F.col("node").cast("int").alias("shard"), F.col("n").alias("quota"))
    return leaf.withColumn("first", F.coalesce(F.sum("quota").over(before), F.lit(0)))


def mixing_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, whole blocks, trimmed documents) of a mix of sized (doc_id, source, size).

    Whole blocks: place, block, shards, one shard for each time that the block is
    taken whole. Trimmed documents: place, doc_id, trim_shard of the documents
    that a source's last, partial block still gives.
    """
    sources = written(source_targets(sized, weights, most, blocks), "sources")
    at = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select("doc_id", "size", "place", "source_size", "target", "n_blocks")
    at = at.withColumn("block", _block(seed))
    totals = written(at.groupBy("place", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target")), "blocks")
    drawn = written(drawn_blocks(totals, most, seed, max(1, blocks // BIN_ROWS)), "drawn")
    leaf = shard_quotas(drawn, shards, seed)
    owned = leaf.select("shard", "place", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)).alias("seq"))
    sharded = written(drawn.join(owned, ["place", "seq"]), "sharded")
    whole = sharded.filter("takes IS NULL").groupBy("place", "block").agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    last = sharded.filter("takes IS NOT NULL").select("place", "block", "takes", F.col("shard").alias("trim_shard"))
    upto = Window.partitionBy("place", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    trimmed = (
        at.join(last, ["place", "block"])
        .groupBy("place", "block", "doc_id", "takes", "trim_shard")
        .agg(F.sum("size").alias("size"))
        .withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0)))
        .filter(F.col("before") + F.col("size") / 2 < F.col("takes"))
        .select("place", "doc_id", "trim_shard")
    )
    return sources, whole, trimmed


def _decided(rows: DataFrame, plan: tuple[DataFrame, DataFrame, DataFrame], seed: int = SEED) -> DataFrame:
    """rows (doc_id, source and more) with the plan's columns: source_size, target and shards, one for each copy."""
    sources, whole, trimmed = plan
    at = rows.join(sources.withColumnRenamed("source", "_source"), rows["source"].eqNullSafe(F.col("_source"))).withColumn("block", _block(seed))
    at = at.join(whole, ["place", "block"], "left")
    last = trimmed.select(F.col("place").alias("_place"), F.col("doc_id").alias("_id"), "trim_shard")
    at = at.join(last, (at["place"] == F.col("_place")) & at["doc_id"].eqNullSafe(F.col("_id")), "left")
    shards = F.concat(F.coalesce("shards", F.array().cast("array<int>")), F.when(F.col("trim_shard").isNotNull(), F.array("trim_shard")).otherwise(F.array().cast("array<int>")))
    return at.withColumn("shards", shards)


def mix(docs: DataFrame, text: str = "text", seed: int = SEED, shards: int | None = None, blocks: int | None = None, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) of each row of docs.

    size is the row's words (a null text has none), taken is size times the copies
    that the mix takes, and shards the shard of each copy. Rows of one source
    that repeat a doc_id are taken or left together; a null doc_id is an id like
    any other. Equal hashes are told apart by the ids behind them, so reruns and other partitionings agree.
    Other columns are ignored, and an empty table gives no rows.
    """
    sized = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size")), "sized")
    shards, blocks = _layout(sized, shards, blocks)
    found = _decided(sized, mixing_plan(sized, seed=seed, shards=shards, blocks=blocks, **options), seed)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mixed_documents(docs: DataFrame, text: str = "text", seed: int = SEED, shards: int | None = None, blocks: int | None = None, **options) -> DataFrame:
    """docs' rows as the mix takes them, repeats included: dealt by shard and shuffled within it. Columns stay."""
    sized = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size")), "sized")
    shards, blocks = _layout(sized, shards, blocks)
    plan = mixing_plan(sized, seed=seed, shards=shards, blocks=blocks, **options)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"))
    copies = _decided(rows, plan, seed).select("row", F.posexplode("shards").alias("copy", "shard"))
    order = F.xxhash64(F.col("row.doc_id"), "copy", F.lit(seed + 2))
    return copies.repartition(shards, "shard").sortWithinPartitions("shard", order).select("row.*")
