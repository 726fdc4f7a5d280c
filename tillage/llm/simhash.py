"""SimHash near-duplicates by an index over the positions of fingerprint bytes.

`simhash_groups` links fingerprints of eight bytes at eight positions. Two that differ in at most
two bits share at least six of the eight positional bytes: that is the
guaranteed minimum of matches. A posting list for one (position, byte) holds
1/256 of all documents, so lists of single bytes would pair off the corpus
with itself. The index therefore keeps the intersections of six lists: one
entry for each way to leave out two positions (28 a fingerprint). Fingerprints
that meet in an entry have reached the minimum count. Within an entry only two bytes are free, so those that a member
links with are looked up: its two bytes with each pattern of one or two bits flipped. The shared bytes of
each pair found are tallied and its bits compared.

Equal fingerprints are one entry of the index, so copies never multiply, and an
entry holds at most 65,536 fingerprints. An entry gives a spanning forest of its links.

`near_keep` finds near copies in the sense of a similarity of shingle sets, which takes fingerprints of more positions;
see there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillage.llm.common import written
from tillage.llm.components import connected_components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
#: Ways to leave out two of eight positions: (mask of the six kept bytes, the two that are left out).
ENTRIES = [
    ((1 << 64) - 1 & ~(0xFF << 8 * i | 0xFF << 8 * j), i, j) for i, j in combinations(range(8), 2)
]
#: Members of an entry that are looked up at a time.
AT_ONCE = 4096


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, 0 if it has no word.

    A-Z are lower-cased, words are runs of anything but ASCII white space,
    repeats count, and a text with fewer words than a shingle is one shingle.
    A bit is 1 if it is set in more than half of the hashes.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), seed)
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[s:e], seed) for s, e in zip(starts, ends)], "<u8")
    n = len(hashes)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    whole = n - n % 255
    ones = bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    ones += bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns and fp, the fingerprint as a signed bigint, one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(b.num_columns - 1).to_pylist()], "<u8")
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(fps.view("<i8"))], names=[*keep, "fp"]
            )

    picked = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(run, f"{kinds}, fp bigint")


class _Forest:
    """Takes pairs and keeps those that join what was apart."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, pairs: np.ndarray) -> None:
        for i, j in pairs.tolist():
            ri, rj = self.root(i), self.root(j)
            if ri != rj:
                self.parent[max(ri, rj)] = min(ri, rj)
                self.links.append((i, j))


def _flips(max_bits: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for n in range(1, max_bits + 1) for c in combinations(range(16), n)], np.int64)


def entry_links(values: np.ndarray, lo: int, hi: int, max_bits: int) -> list[tuple[int, int]]:
    """Links (places in values) that join what max_bits joins, of an entry where only bytes lo and hi differ."""
    one = np.uint64(255)
    free = ((values >> np.uint64(8 * lo)) & one | ((values >> np.uint64(8 * hi)) & one) << np.uint64(8)).astype(np.int64)
    order = np.argsort(free, kind="stable")
    ranked, flips, forest = free[order], _flips(max_bits), _Forest(len(values))
    for a in range(0, len(values) if len(flips) else 0, AT_ONCE):
        wanted = free[a : a + AT_ONCE, None] ^ flips
        at = np.minimum(np.searchsorted(ranked, wanted), len(ranked) - 1)
        i, k = np.nonzero(ranked[at] == wanted)
        pairs = np.stack([i + a, order[at[i, k]]], 1)
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        apart = values[pairs[:, 0]] ^ values[pairs[:, 1]]
        shared = (apart[:, None].view(np.uint8).reshape(-1, 8) == 0).sum(1)
        forest.join(pairs[(shared >= 8 - max_bits) & (np.bitwise_count(apart) <= max_bits)])
    return forest.links


def near_links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links between the ids of distinct fingerprints: (fp, id) in, enough links out
    to join all that a chain of links of at most max_bits (0 to 2) bits joins."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the index leaves out two positions, so max_bits is 0, 1 or 2")
    entry = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).cast("tinyint").alias("way"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bytes"))
                for k, (mask, _, _) in enumerate(ENTRIES)
            ]
        )
    )
    met = (
        classes.filter("id is not null")
        .select(entry.alias("e"), "fp", "id")
        .groupBy("e.way", "e.bytes")
        .agg(F.collect_list(F.struct("fp", "id")).alias("met"))
        .filter(F.size("met") > 1)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = [], []
            for way, row in zip(b.column("way").to_pylist(), b.column("met")):
                values = np.asarray(row.values.field("fp")).view("<u8")
                ids = np.asarray(row.values.field("id"))
                for i, j in entry_links(values, *ENTRIES[way][1:], max_bits):
                    a.append(ids[i])
                    c.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return met.select("way", "met").mapInArrow(run, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    component_id is the smallest doc_id reachable over links between
    fingerprints of at most max_bits differing bits. Null and empty texts have
    fingerprint zero and link like any other. Rows that repeat a doc_id are one
    document, which links with whatever one of its texts links with, so all its rows are of one
    component. A row without doc_id joins its group but never names it; if a
    group has no doc_id at all, its component_id is null. Other columns of docs
    are ignored, and an empty table gives an empty result.
    """
    fps = written(fingerprints(docs, text), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").cast("bigint").alias("id")), "classes")
    several = fps.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a <> z").select("doc_id")
    own = fps.join(several, "doc_id", "left_semi").distinct().join(classes, "fp").select(F.col("doc_id").cast("bigint").alias("a"), F.col("id").alias("b"))
    found = connected_components(near_links(classes, max_bits).unionByName(own))
    named = classes.join(found, classes.id == found.node, "left").select(
        "fp", F.coalesce("component", "id").alias("component_id")
    )
    return fps.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """docs' rows whose doc_id is among kept (kept_id), one row of each, and all rows without a doc_id.

    Of rows that repeat a doc_id the one with the least hash of all its columns, as JSON, stays, so a task that runs again
    chooses the same. Rows that differ only in what JSON doesn't show are one to it, and any of them may stay.
    """
    named = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi")
    nameless = docs.filter(docs["doc_id"].isNull())
    repeats = docs.groupBy(docs["doc_id"].alias("again_id")).count().filter("count > 1 and again_id is not null").select("again_id")
    if not repeats.head(1):
        return named.unionByName(nameless)
    once = named.join(repeats, named["doc_id"] == repeats["again_id"], "left_anti")
    again = named.join(repeats, named["doc_id"] == repeats["again_id"], "left_semi").select(F.struct(*[named[c] for c in docs.columns]).alias("r"))
    hashed = again.select("r", F.sha2(F.to_json("r", {"ignoreNullFields": "false"}), 256).alias("h"))
    chosen = hashed.groupBy(F.col("r.doc_id").alias("again_id")).agg(F.min_by("r", "h").alias("r")).select("r.*")
    return once.unionByName(chosen).unionByName(nameless)


#: Words of a shingle, similarity (as a fraction) and fingerprint of near_keep.
NEAR_WORDS = 5
SIMILAR = (4, 5)
WIDE_BYTES = 64
#: Positional bytes that an index entry holds, and entries of a document.
ENTRY_BYTES = 3
WIDE_ENTRIES = 256
#: The entries whose hubs are looked for first; what these join is compared no more in any entry.
HUB_ENTRIES = 160
#: Bits of the part of the fingerprint that travels with a posting (SKETCH_BYTES) in which a pair may differ: as for WIDE_BITS below, 15.2 % of 64 bits are
#: 9.7 with a deviation of 2.9, or 12.0 and 3.1 for sets of fewer than FINE_LEAST shingles; three and a half deviations more. Two
#: fingerprints that have nothing in common differ in 32 with a deviation of 4, so hardly a meeting by chance passes.
SKETCH_BYTES = 8
SKETCH_BITS, SKETCH_BITS_FEW = 20, 23
#: Members of an entry of which it is looked up here who has a partner; of larger entries all stay and are compared by longer fingerprints.
LOOKED_UP = 2048
#: Bits in which the fingerprints of a pair may differ: 4/5 makes an angle of 27.3 degrees, so 15.2 % of the bits (77.6 of 512)
#: with a standard deviation of 8.1; four deviations more.
WIDE_BITS = 110
#: Bytes of the longer fingerprint that tells apart what no hub has joined, and the bits of it in which a pair may differ. A similarity of 4/5
#: makes up to 15.6 % of the bits, and up to 18.8 % (by exact sums) where a set has fewer than FINE_LEAST shingles; three and a half deviations more.
FINE_BYTES = 384
FINE_BITS, FINE_BITS_FEW, FINE_LEAST = 550, 668, 24
#: Postings of a bucket, which gets one longer fingerprint of each of its documents; entries have numbers below ENTRY_SPAN.
BUCKET_ROWS = 1 << 14
ENTRY_SPAN = 1 << 33
#: Documents whose entries leave a task as one batch.
BATCH_DOCS = 256
_SPREAD = np.random.default_rng(64).integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)
_FINE_SPREAD = np.random.default_rng(FINE_BYTES).integers(0, 1 << 63, FINE_BYTES // 8, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = NEAR_WORDS) -> set[bytes]:
    """The distinct shingles of a text; words are those of fingerprint, fewer than a shingle are one."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(tokens) <= words:
        return {b" ".join(tokens)} if tokens else set()
    return set(map(b" ".join, zip(*(tokens[i:] for i in range(words)))))


def similar(x: set[bytes], y: set[bytes], least: tuple[int, int] = SIMILAR) -> bool:
    both = len(x & y)
    return both > 0 and least[1] * both >= least[0] * (len(x) + len(y) - both)


def shingle_hashes(text: str | None, words: int = NEAR_WORDS) -> np.ndarray:
    """A number for each distinct shingle of a text, made from the XXH64 of its words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ (h >> np.uint64(31))) * _SPREAD[0] + w[i : len(w) - size + 1 + i]
    return np.unique(h)


def wide_fingerprint(h: np.ndarray, spread: np.ndarray = _SPREAD) -> np.ndarray:
    """The SimHash of a set of shingles, given as numbers: eight bytes come from each of their products with the odd
    numbers of spread, mixed. WIDE_BYTES with those of the index."""
    ones = np.zeros(len(spread) * 64, np.int64)
    for a in range(0, len(h), 255):
        x = h[a : a + 255, None] * spread
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h), bitorder="little")


def entry_positions(n: int = WIDE_ENTRIES, seed: int = 3) -> np.ndarray:
    """The positions of n entries: fixed draws of ENTRY_BYTES different ones, no two alike."""
    rng, found = np.random.default_rng(seed), set()
    while len(found) < n:
        found.add(tuple(sorted(rng.choice(WIDE_BYTES, ENTRY_BYTES, replace=False).tolist())))
    return np.array(sorted(found))


def wide_fingerprints(texts: DataFrame) -> DataFrame:
    """(id, n, bits) of texts (id, text): the number of distinct shingles and the fingerprint (zero without a word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, len(b), BATCH_DOCS):
                part = b.slice(a, BATCH_DOCS)
                found = [shingle_hashes(t) for t in part.column("text").to_pylist()]
                cols = [part.column("id"), pa.array([len(x) for x in found], pa.int32()), pa.array([wide_fingerprint(x).tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "bits"])

    return texts.select("id", "text").mapInArrow(run, "id bigint, n int, bits binary")


def postings(classes: DataFrame, entries: int = WIDE_ENTRIES, more: tuple[str, ...] = ()) -> DataFrame:
    """(entry, id, n, sketch, and bigints named by more): each class's places in the first so many ways of the index, an entry being a set of positions and
    the bytes that stand there. sketch is the first bytes of the fingerprint."""
    positions = entry_positions()[np.random.default_rng(entries).permutation(WIDE_ENTRIES)[:entries]]
    names = ["id", "n", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(len(positions), dtype=np.int64) << 8 * ENTRY_BYTES
        weight = np.int64(256) ** np.arange(ENTRY_BYTES)
        for b in batches:
            for a in range(0, len(b), BATCH_DOCS):
                part = b.slice(a, BATCH_DOCS)
                bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint8).reshape(len(part), -1)
                found = (bits[:, positions].astype(np.int64) * weight).sum(2) | number
                sketch = np.ascontiguousarray(bits[:, :SKETCH_BYTES]).view("<i8").ravel()
                i, n, *rest = (np.repeat(x, len(positions)) for x in (*(np.asarray(part.column(c)) for c in names[:2]), sketch, *(np.asarray(part.column(c)) for c in more)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found.ravel(), i, n, *rest)], names=["entry", "id", "n", "sketch", *more])

    return classes.select("bits", *names).mapInArrow(run, "entry bigint, id bigint, n int, sketch bigint" + "".join(f", {c} bigint" for c in more))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns, bounds of the runs of an equal first column) of rows sorted by it; no run is cut."""
    held: list[list[np.ndarray]] = []  # pieces of the run that is still open
    for b in batches:
        now = [np.asarray(c) for c in b.columns]
        if not len(now[0]):
            continue
        if held and held[-1][0][-1] == now[0][0] and now[0][0] == now[0][-1]:
            held.append(now)
            continue
        last = int(np.searchsorted(now[0], now[0][-1]))
        held.append([c[:last] for c in now])
        whole = [np.concatenate(c) for c in zip(*held)]
        if len(whole[0]):
            yield _bounded(whole)
        held = [[c[last:] for c in now]]
    if held:
        yield _bounded([np.concatenate(c) for c in zip(*held)])


def _bounded(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    return columns, np.concatenate(([0], np.flatnonzero(np.diff(columns[0])) + 1, [len(columns[0])]))


def _by_entry(rows: DataFrame) -> DataFrame:
    return rows.repartition("entry").sortWithinPartitions("entry", "id")


def _size_allows(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SIMILAR[1] * np.minimum(n, m) >= SIMILAR[0] * np.maximum(n, m)


def _may_be_near(n: np.ndarray, sketch: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sizes and sketches of pairs allow the similarity."""
    limit = np.where(np.minimum(n, m) < FINE_LEAST, SKETCH_BITS_FEW, SKETCH_BITS)
    return _size_allows(n, m) & (np.bitwise_count((sketch ^ other).astype(np.uint64)) <= limit)


def _partnered(bounds: np.ndarray, n: np.ndarray, sketch: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which postings have, in their entry, one of another label that may be near."""
    n, kept, sizes = n.astype(np.int64), np.zeros(len(n), bool), np.diff(bounds)
    two = bounds[:-1][sizes == 2]
    ok = _may_be_near(n[two], sketch[two], n[two + 1], sketch[two + 1]) & (label[two] != label[two + 1])
    kept[two] = kept[two + 1] = ok
    for at in np.flatnonzero(sizes > 2).tolist():
        lo, hi = int(bounds[at]), int(bounds[at + 1])
        mine = label[lo:hi]
        if (mine == mine[0]).all():
            continue
        if hi - lo > LOOKED_UP:
            kept[lo:hi] = True
            continue
        for i in range(lo, hi, 256):
            rows = slice(i, min(i + 256, hi))
            kept[rows] |= (_may_be_near(n[rows, None], sketch[rows, None], n[None, lo:hi], sketch[None, lo:hi]) & (label[rows, None] != mine[None, :])).any(1)
    return kept


def meetings(posted: DataFrame) -> DataFrame:
    """(entry, id, n, size): the postings whose entry another one has that may be near, size being the number of such in the entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (entry, ids, n, sketch), bounds in _runs(batches):
            kept = _partnered(bounds, n, sketch, np.arange(len(ids)))
            size = np.repeat(np.add.reduceat(kept.astype(np.int64), bounds[:-1]), np.diff(bounds))
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (entry, ids, n, size)], names=["entry", "id", "n", "size"])

    return _by_entry(posted).mapInArrow(run, "entry bigint, id bigint, n int, size bigint")


def hub_pairs(met: DataFrame) -> DataFrame:
    """(id, hub, w): each class with the one of each of its entries that meets most others, w being how many it meets.

    A class has a meeting for each of its entries at most, so these are summed up side by side with them and joined with nothing."""
    weighed = met.withColumn("w", F.sum("size").over(Window.partitionBy("id")))
    hubs = weighed.groupBy("entry").agg(F.max(F.struct("w", (-F.col("id")).alias("minus"), F.col("n").alias("hn"))).alias("h"))
    pairs = met.join(hubs, "entry").select("id", "n", (-F.col("h.minus")).alias("hub"), "h.hn", "h.w")
    return pairs.filter(f"id <> hub and {SIMILAR[1]} * least(n, hn) >= {SIMILAR[0]} * greatest(n, hn)").select("id", "hub", "w").distinct()


def _as_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def best_hub(hubs: DataFrame) -> DataFrame:
    """(a, b): each class with one hub, the one that meets most others."""
    return _as_pairs(hubs.groupBy("id").agg(F.max(F.struct("w", (-F.col("hub")).alias("minus"))).alias("h")).select("id", (-F.col("h.minus")).alias("hub")))


def other_hubs(hubs: DataFrame, joined: DataFrame) -> DataFrame:
    """(a, b): classes and hubs that joined leaves apart."""
    of = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    both = hubs.join(of("id"), "id", "left").join(of("hub"), "hub", "left")
    return _as_pairs(both.filter(F.coalesce("id_of", "id") != F.coalesce("hub_of", "hub")))


def open_entries(classes: DataFrame, joined: DataFrame) -> DataFrame:
    """(entry, id, n, label): the postings of classes whose entry has one that may be near and that joined leaves apart; label is the component.

    Labels are joined to classes and travel with the postings, so no posting is joined with anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (entry, ids, n, sketch, label), bounds in _runs(batches):
            kept = _partnered(bounds, n, sketch, label)
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (entry, ids, n, label)], names=["entry", "id", "n", "label"])

    labelled = classes.join(joined, classes["id"] == joined["node"], "left").select("bits", "id", "n", F.coalesce("component", "id").alias("label"))
    return _by_entry(postings(labelled, more=("label",))).mapInArrow(run, "entry bigint, id bigint, n int, label bigint")


def fine_fingerprints(texts: DataFrame) -> DataFrame:
    """(id, fine) of texts (id, text): the longer fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, len(b), BATCH_DOCS):
                part = b.slice(a, BATCH_DOCS)
                found = [wide_fingerprint(shingle_hashes(t), _FINE_SPREAD).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.binary())], names=["id", "fine"])

    return texts.select("id", "text").mapInArrow(run, "id bigint, fine binary")


def _close(fine: np.ndarray, n: np.ndarray, label: np.ndarray, i: int) -> np.ndarray:
    """The members of an entry after the i-th that have another label, and a size and a fingerprint that allow the similarity."""
    where = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & _size_allows(n[i + 1 :], n[i]))
    apart = np.bitwise_count(fine[where] ^ fine[i]).sum(1, dtype=np.int64)
    return where[apart <= np.where(np.minimum(n[where], n[i]) < FINE_LEAST, FINE_BITS_FEW, FINE_BITS)]


def _prints_of_buckets(dealt: DataFrame, fine: DataFrame) -> DataFrame:
    """(bucket, id, fine): the longer fingerprint of each document of each bucket. A document meets its fingerprint once, with the list of its buckets."""
    buckets = dealt.groupBy("id").agg(F.collect_set("bucket").alias("buckets"))
    return buckets.join(fine, "id").select(F.explode("buckets").alias("bucket"), "id", "fine")


def apart_pairs(opened: DataFrame, fine: DataFrame) -> DataFrame:
    """(a, b): classes that meet in an open entry and have other labels, where sizes and longer fingerprints allow the similarity.

    Entries are dealt to buckets, whose number follows the postings. A bucket gets each of its documents' fingerprints once, ahead of the
    entries, so pairs are compared where they meet and only likely ones leave a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, prints, a, b, held = np.zeros(0, np.int64), np.zeros((0, FINE_BYTES // 8), np.uint64), [], [], 0
        for (key, ids, n, label, found), bounds in _runs(batches):
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if key[lo] % ENTRY_SPAN == 0:
                    known, prints = ids[lo:hi], np.frombuffer(b"".join(found[lo:hi]), np.uint64).reshape(hi - lo, -1)
                    continue
                members, sizes = ids[lo:hi], n[lo:hi].astype(np.int64)
                mine = prints[np.searchsorted(known, members)]
                for i in range(hi - lo - 1):
                    where = _close(mine, sizes, label[lo:hi], i)
                    a.append(np.full(len(where), members[i]))
                    b.append(members[where])
                    held += len(where)
                if held > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                    a, b, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    buckets = opened.count() // BUCKET_ROWS + 1
    dealt = opened.withColumn("bucket", F.pmod(F.xxhash64("entry"), F.lit(buckets)))
    first = F.col("bucket") * F.lit(ENTRY_SPAN)
    ahead = _prints_of_buckets(dealt, fine).select("bucket", first.alias("key"), "id", F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("label"), "fine")
    entries = dealt.select("bucket", (first + F.col("entry") + 1).alias("key"), "id", "n", "label", F.lit(None).cast("binary").alias("fine"))
    rows = ahead.unionByName(entries).repartition("bucket").sortWithinPartitions("key", "id")
    return rows.select("key", "id", "n", "label", "fine").mapInArrow(run, "a bigint, b bigint").distinct()


def counted(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose tally of shared positional bytes reaches an entry's and whose fingerprints differ in few enough bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(len(b), -1) for c in ("s", "t"))
            apart = x ^ y
            kept = ((apart == 0).sum(1) >= ENTRY_BYTES) & (np.bitwise_count(apart).sum(1, dtype=np.int64) <= WIDE_BITS)
            yield b.select(["a", "b"]).filter(pa.array(kept))

    left = classes.select(F.col("id").alias("a"), F.col("bits").alias("s"))
    right = classes.select(F.col("id").alias("b"), F.col("bits").alias("t"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "s", "t").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose texts are similar, compared shingle by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, x = None, set()
        for b in batches:
            ok = []
            for i, s, t in zip(*(b.column(c).to_pylist() for c in ("a", "s", "t"))):
                if i != known:
                    known, x = i, shingles(s)
                ok.append(similar(x, shingles(t)))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = written(counted(pairs, classes), "counted-pairs")
    nodes = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    chosen = written(texts.join(nodes, "id", "left_semi"), "candidates")
    both = pairs.join(chosen.select(F.col("id").alias("b"), F.col("text").alias("t")), "b").join(chosen.select(F.col("id").alias("a"), F.col("text").alias("s")), "a")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a bigint, b bigint")


def near_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, component): for each doc_id with a copy or near copy, the smallest id reachable over such pairs.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 4/5 or more. The search is by the
    fingerprint of these sets: WIDE_ENTRIES entries of ENTRY_BYTES positional bytes each are an index, classes of equal
    fingerprints that meet in an entry have shared that many, their tally is taken over all WIDE_BYTES positions, their bits
    are compared and then the texts themselves, so no pair is linked falsely. At a similarity of 0.8 a pair of one size meets in an
    entry with a probability of 0.93, at 0.82 of 0.97, at 0.85 of 0.99 and at 0.9 of 0.9995 (by simulation); what doesn't meet isn't found. In HUB_ENTRIES of the entries each is first compared with the one that meets most others of all in its
    entries, then, where they are still apart, with that of each entry; what this leaves apart is compared pair by pair in all entries, first by a longer
    fingerprint within the entry. So a large cluster of copies around one text costs its size and not the square of it, and gives a link
    for each of its texts.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("id is not null")
    fps = written(wide_fingerprints(rows), "wide-fingerprints")
    classes = written(fps.groupBy("n", "bits").agg(F.min("id").alias("id")), "wide-classes")
    alone = classes.filter("n > 0")
    texts = rows.join(alone.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    met = written(meetings(postings(alone, HUB_ENTRIES)), "meetings")
    hubs = written(hub_pairs(met), "hub-pairs")
    links = written(verified(best_hub(hubs), texts, alone), "hub-links")
    more = verified(other_hubs(hubs, connected_components(links)), texts, alone)
    links = written(links.unionByName(more), "hub-links")
    opened = written(open_entries(alone, connected_components(links)), "open-entries")
    fine = written(fine_fingerprints(texts.join(opened.select("id").distinct(), "id", "left_semi")), "fine-fingerprints")
    rest = written(apart_pairs(opened, fine).join(_as_pairs(hubs), ["a", "b"], "left_anti"), "apart-pairs")
    several = fps.groupBy("id").agg(F.count_distinct("n", "bits").alias("texts")).filter("texts > 1").select("id")
    of_doc = fps.select("id", "n", "bits").distinct().join(classes.withColumnRenamed("id", "first"), ["n", "bits"]).select("id", "first")
    own = of_doc.join(several, "id", "left_semi").select(F.col("id").alias("a"), F.col("first").alias("b"))
    found = connected_components(links.unionByName(verified(rest, texts, alone)).unionByName(own))
    joined = of_doc.join(found, of_doc["first"] == found["node"], "left")
    return joined.groupBy(F.col("id").alias("node")).agg(F.min(F.coalesce("component", "first")).alias("component"))


def near_keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one document of each group of copies and near copies (see near_components), the one with the smallest doc_id.

    Columns stay as they are. Texts without a word, null ones among them, are copies of each other. Rows that repeat a doc_id are one
    document, of which one row stays; rows without a doc_id can't be named as anyone's copy and all stay. An empty table gives no rows.
    """
    kept = near_components(docs, text).filter("node = component").select(F.col("node").alias("kept_id"))
    return one_of_each(docs, kept)
