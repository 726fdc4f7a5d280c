"""Token-id files coded with a static range asymmetric numeral system (rANS).

One frequency table, counted over all tokens, is shared by all blocks. A block
holds the ids of whole documents and is coded by LANES interleaved states, so
that numpy decodes LANES ids at a step. Blocks don't depend on each other. Each
one is a row of a Parquet table with its checkpoint (shard, place in the shard,
first document, ids before it), the documents' lengths, the lanes' final
states, the words that the states shed, and a CRC-32 of all that: any task
can decode any block, and damage is found before ids are used.

A token file is a folder with two Parquet tables. blocks: shard int, block int, first_doc bigint, ids_before
bigint (in the shard), n_ids bigint, doc_ids array<bigint>, doc_lengths
array<bigint>, states binary, words binary, crc32 bigint. table: id int, slots int (a power of two in sum) of each id that
occurs, and in each row crc32 bigint, the CRC-32 of all (id, slots) in ascending order as little-endian 32-bit numbers. So a folder is decoded
by what stands in it (`open_token_files`), and a damaged table is found before it is used.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillage.llm.common import scratch_dir, written

#: log2 of the slots that the table deals out to the ids.
TABLE_BITS = 18
LANES = 1024
#: A block is closed after the document that brings it to this many ids.
BLOCK_IDS = 1 << 18
#: Ids of a shard, about, as long as there are no more than SHARDS; in a larger corpus shards grow to MOST_IDS.
SHARD_IDS = 1 << 20
SHARDS = 4096
MOST_IDS = 1 << 28
#: Blocks that are coded side by side.
SIDE_BY_SIDE = 4
#: States stay in [LOW, LOW << 32).
LOW = np.uint64(1 << 31)

BLOCK = (
    "shard int, block int, first_doc bigint, ids_before bigint, n_ids bigint, doc_ids array<bigint>, "
    "doc_lengths array<bigint>, states binary, words binary, crc32 bigint"
)


def frequency_slots(counts: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    """Share out 2**bits slots in proportion to counts, at least one for each id that occurs."""
    total, space = int(counts.sum()), 1 << bits
    used = counts > 0
    if not total:
        raise ValueError("no ids to count")
    if used.sum() > space:
        raise ValueError("more ids than slots")
    spare = space - int(used.sum())
    slots = np.where(used, 1 + (counts.astype(np.float64) * spare / total).astype(np.int64), 0)
    left = space - int(slots.sum())
    for i in np.lexsort((np.arange(len(counts)), -counts))[:1]:
        slots[i] += left
    return slots


class Coder:
    """Codes and decodes blocks under one table."""

    def __init__(self, slots: np.ndarray, bits: int = TABLE_BITS, lanes: int = LANES):
        self.bits, self.lanes = np.uint64(bits), lanes
        self.slots = slots.astype(np.uint64)
        self.starts = (np.cumsum(slots) - slots).astype(np.uint64)
        self.limit = self.slots << np.uint64(63 - bits)
        self.id_of_slot = np.repeat(np.arange(len(slots), dtype=np.uint32), slots)
        self.filler = int(np.argmax(slots))

    def encode(self, blocks: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        """(states, words) of each block. Blocks are padded to whole steps with the commonest id; at each step those
        that have one are coded side by side."""
        lanes, n = self.lanes, len(blocks)
        steps = np.array([-(-len(x) // lanes) for x in blocks], np.int64)
        order = np.argsort(-steps, kind="stable")
        longest = int(steps.max(initial=0))
        ids = np.full((n, longest * lanes), self.filler, np.uint32)
        for row, k in zip(ids, order):
            row[: len(blocks[k])] = blocks[k]
        ids = ids.reshape(n, longest, lanes)
        state = np.full((n, lanes), LOW)
        shed = np.zeros((longest, n, lanes), bool)
        words = np.zeros((longest, n, lanes), np.uint32)
        live = 0
        for t in range(longest - 1, -1, -1):
            while live < n and steps[order[live]] > t:
                live += 1
            step, now = ids[:live, t], state[:live]
            slots = self.slots[step]
            over = now >= self.limit[step]
            shed[t, :live] = over
            words[t, :live] = now  # the low half; only where it is shed does it count
            now = np.where(over, now >> np.uint64(32), now)
            whole = now // slots
            state[:live] = (whole << self.bits) + (now - whole * slots) + self.starts[step]
        out: list[tuple[bytes, bytes]] = [(b"", b"")] * n
        for row, k in enumerate(order):
            out[k] = (state[row].astype("<u8").tobytes(), words[: steps[k], row][shed[: steps[k], row]].astype("<u4").tobytes())
        return out

    def decode(self, coded: list[tuple[bytes, bytes, int]]) -> list[np.ndarray]:
        """The ids of each (states, words, number of ids)."""
        lanes, n = self.lanes, len(coded)
        steps = np.array([-(-c[2] // lanes) for c in coded], np.int64)
        state = np.stack([np.frombuffer(c[0], "<u8") for c in coded]).astype(np.uint64)
        words = np.concatenate([np.frombuffer(c[1], "<u4") for c in coded] + [np.zeros(1, "<u4")]).astype(np.uint64)
        at = np.cumsum([0] + [len(c[1]) // 4 for c in coded[:-1]])
        longest = int(steps.max(initial=0))
        out = np.empty((longest, n, lanes), np.uint32)
        mask = np.uint64((1 << int(self.bits)) - 1)
        for t in range(longest):
            live = steps > t
            slot = state & mask
            ids = self.id_of_slot[slot]
            out[t] = ids
            state = self.slots[ids] * (state >> self.bits) + slot - self.starts[ids]
            low = (state < LOW) & live[:, None]
            place = np.cumsum(low, axis=1)
            read = words[np.where(low, at[:, None] + place - 1, len(words) - 1)]
            state = np.where(low, (state << np.uint64(32)) | read, state)
            at = at + place[:, -1]
        return [out[: steps[k], k].reshape(-1)[: coded[k][2]] for k in range(n)]


def _crc(*parts: bytes) -> int:
    value = 0
    for p in parts:
        value = zlib.crc32(p, value)
    return value


def count_ids(tokens: DataFrame, width: str) -> DataFrame:
    """(id, n) over all rows of tokens (ids: little-endian, of the width in bytes). Each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            ids = np.concatenate([np.frombuffer(x.as_buffer() or b"", width) for x in b.column("ids")])
            if len(ids) and int(ids.max()) >= len(total):
                total = np.pad(total, (0, int(ids.max()) + 1 - len(total)))
            total += np.bincount(ids, minlength=len(total))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def shards_for(n_ids: int) -> int:
    return max(1, -(-n_ids // MOST_IDS), min(SHARDS, -(-n_ids // SHARD_IDS)))


def slot_table(tokens: DataFrame, width: str, bits: int = TABLE_BITS) -> tuple[np.ndarray, int]:
    """(the shared table, how many ids there are). Its size is bound by the vocabulary, and more than 2**bits ids are refused."""
    rows = count_ids(tokens, width).limit((1 << bits) + 1).toPandas()
    if not len(rows):
        return np.array([1 << bits]), 0
    counts = np.zeros(int(rows["id"].max()) + 1, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return frequency_slots(counts, bits), int(counts.sum())


def encode_blocks(tokens: DataFrame, slots: np.ndarray, width: str, shards: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Block rows (see BLOCK) of tokens (doc_id, ids binary), documents in ascending doc_id order.

    Rows are dealt out by ranges of doc_id, so a shard is bounded whatever the
    sources' sizes; shard numbers ascend with doc_id, nulls first. Equal
    doc_ids stand in the order of their ids' bytes.
    """
    in_order = tokens.select("doc_id", "ids").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, coder = TaskContext.get().partitionId(), Coder(slots)
        full, docs, lengths, parts, size, before, number = [], [], [], [], 0, 0, 0

        def close() -> None:
            nonlocal docs, lengths, parts, size
            full.append((docs, lengths, np.concatenate(parts)))
            docs, lengths, parts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal before, number
            rows = []
            for (ids, counts, data), (states, words) in zip(full, coder.encode([x[2] for x in full])):
                lens = np.array(counts, "<i8")
                rows.append((shard, number, ids[0], before, len(data), ids, counts, states, words, _crc(lens.tobytes(), states, words)))
                before += len(data)
                number += 1
            full.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
            names = [x.split()[0] for x in BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for doc, ids in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                data = np.frombuffer(ids.as_buffer() or b"", width)
                docs.append(doc)
                lengths.append(len(data))
                parts.append(data)
                size += len(data)
                if size >= block_ids:
                    close()
                    if len(full) == SIDE_BY_SIDE:
                        yield flush()
        if docs:
            close()
        if full:
            yield flush()

    return in_order.mapInArrow(run, BLOCK)


def decode_blocks(blocks: DataFrame, slots: np.ndarray, visit: Callable[[np.ndarray], list], columns: str) -> DataFrame:
    """One row for each document in the blocks: doc_id, shard, start (in the shard), n_tokens and what visit makes of its ids.

    columns names visit's values as a Spark schema. A block whose CRC-32 differs raises.
    """
    spark_schema = f"shard int, doc_id bigint, start bigint, n_tokens bigint, {columns}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(spark_schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(slots)
        for b in batches:
            todo = [{n: b.column(n)[i] for n in b.schema.names} for i in range(b.num_rows)]
            for k in range(0, len(todo), SIDE_BY_SIDE):
                rows, group = [], todo[k : k + SIDE_BY_SIDE]
                for x in group:
                    lens = np.asarray(x["doc_lengths"].values, "<i8")
                    if _crc(lens.tobytes(), x["states"].as_buffer(), x["words"].as_buffer()) != x["crc32"].as_py():
                        raise ValueError(f"block {x['block']} of shard {x['shard']} is damaged")
                decoded = coder.decode([(x["states"].as_py(), x["words"].as_py(), x["n_ids"].as_py()) for x in group])
                for x, ids in zip(group, decoded):
                    at, shard = 0, x["shard"].as_py()
                    before = x["ids_before"].as_py()
                    for doc, n in zip(x["doc_ids"].as_py(), x["doc_lengths"].as_py()):
                        rows.append((shard, doc, before + at, n, *visit(ids[at : at + n])))
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return blocks.select("shard", "block", "ids_before", "n_ids", "doc_ids", "doc_lengths", "states", "words", "crc32").mapInArrow(run, spark_schema)


def global_starts(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """docs with start counted over all shards. There is one row per shard to add up, however long the shards are."""
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_before"))
    return docs.join(F.broadcast(before), "shard").withColumn("start", F.col("start") + F.col("_before")).drop("_before")


TABLE = "id int, slots int, crc32 bigint"


def _table_crc(ids: np.ndarray, slots: np.ndarray) -> int:
    return zlib.crc32(np.stack([ids, slots], 1).astype("<u4").tobytes())


def write_table(spark: SparkSession, slots: np.ndarray, path: str) -> None:
    ids = np.flatnonzero(slots)
    crc = _table_crc(ids, slots[ids])
    rows = pa.table({"id": pa.array(ids, pa.int32()), "slots": pa.array(slots[ids], pa.int32()), "crc32": pa.array(np.full(len(ids), crc), pa.int64())})
    spark.createDataFrame(rows).coalesce(1).write.parquet(path)


def read_table(table: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """The slots of each id, from the rows of a table file, of which there are 2**bits at most; one whose CRC-32 or sum is wrong raises."""
    rows = table.select("id", "slots", "crc32").limit((1 << bits) + 1).toPandas().sort_values("id")
    ids, slots = rows["id"].to_numpy(), rows["slots"].to_numpy()
    if not len(rows) or int(slots.sum()) != 1 << bits or (rows["crc32"] != _table_crc(ids, slots)).any() or (np.diff(ids) == 0).any():
        raise ValueError("the table of a token file is damaged")
    out = np.zeros(int(ids[-1]) + 1, np.int64)
    out[ids] = slots
    return out


def open_token_files(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """(blocks, slots) of the token file at path, as decode_blocks takes them."""
    return spark.read.schema(BLOCK).parquet(f"{path}/blocks"), read_table(spark.read.schema(TABLE).parquet(f"{path}/table"))


def write_token_files(docs: DataFrame, tokenize: Callable, end_id: int, width: str, text: str = "text") -> str:
    """Tokenize docs and write them as a token file in the shared folder; gives its path.

    tokenize makes, once for each Python worker, a function from an Arrow array of texts to
    a list of bytes: ids of the numpy type in width (<u2 or <u4). A null text counts as
    empty; every document ends with end_id. The number of shards follows the ids. Further columns are ignored.
    """
    end = np.array([end_id], width).tobytes()
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenize()
        for b in batches:
            ids = [x + end for x in encode(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    tokens = written(picked.mapInArrow(run, "doc_id bigint, ids binary"), "tokens")
    slots, n_ids = slot_table(tokens, width)
    path = f"{scratch_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_table(spark, slots, f"{path}/table")
    encode_blocks(tokens, slots, width, shards_for(n_ids)).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


def word_tokenizer(path: str, cache: int = 600_000) -> Callable:
    """A maker of encoders for a tokenizers file that works word by word (see WordEncoder)."""

    def make() -> Callable:
        from tillage.llm.wordcache import WordEncoder

        return WordEncoder.shared(path, cache)

    return make


def token_file_digest(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from files written and read back.

    start counts all ids of the documents before it in ascending doc_id order
    (nulls first, repeats in the order of their ids' bytes), n_tokens includes
    the end id, and ids_crc32 is of the ids as little-endian uint32. An empty table gives no rows.
    """
    make = word_tokenizer(path)
    blocks, slots = open_token_files(docs.sparkSession, write_token_files(docs, make, end_id, make().dtype.str))
    found = decode_blocks(blocks, slots, lambda ids: [zlib.crc32(ids.astype("<u4").tobytes())], "ids_crc32 bigint")
    return global_starts(found, blocks).select("doc_id", "start", "n_tokens", "ids_crc32")
