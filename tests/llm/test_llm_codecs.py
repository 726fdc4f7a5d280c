"""Exact round trips and the library's own results for token files, FLAC and SentencePiece."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillage.llm import flac, rans, spiece
from tillage.llm.wordcache import WordEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "It's DON'T I'LL <|endoftext|>x", "Ñandú ΣΑΣ İx Å ﬁ É", "a--b!!?? 12ab3", "nb sp x\x1cy", "日本語 😀", "word " * 5000, "x" * 3000]


def test_word_encoder_equals_library():
    texts = pa.array(ODD * 3, pa.string())
    library = Tokenizer.from_file(WORDS)
    for limit in (10, 100_000):
        coder = WordEncoder(WORDS, limit)
        for text, got in zip(texts.to_pylist(), coder(texts, at_once=4)):
            assert np.frombuffer(got, coder.dtype).tolist() == library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=500), min_size=1, max_size=4), st.integers(1, 40))
def test_rans_round_trip(blocks, lanes):
    data = [np.array(b, np.uint32) for b in blocks]
    counts = np.bincount(np.concatenate([*data, np.array([7], np.uint32)]), minlength=301)
    coder = rans.Coder(rans.frequency_slots(counts, 12), 12, lanes)
    coded = coder.encode(data)
    back = coder.decode([(*c, len(d)) for c, d in zip(coded, data)])
    assert all((a == b).all() for a, b in zip(back, data))


def test_slots():
    s = rans.frequency_slots(np.array([0, 1, 10**9, 5]), 8)
    assert s.sum() == 256 and s[0] == 0 and (s[1:] > 0).all()
    with pytest.raises(ValueError):
        rans.frequency_slots(np.ones(300, int), 8)


def test_token_files(spark):
    docs = [(i * 7 % 1000, t, "s") for i, t in enumerate(ODD * 4)] + [(None, "null id", "s"), (5, "twice", "s"), (5, "again", "s"), (5, "again", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, start string").repartition(5)
    got = rans.token_file_digest(df, WORDS).collect()
    library = Tokenizer.from_file(WORDS)
    ids = [(d, np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for d, t, _ in docs]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes()))
    at, want = 0, []
    for d, x in ids:
        want.append((d, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    key = lambda r: r[1]
    assert sorted(map(tuple, got), key=key) == want
    assert rans.token_file_digest(df.limit(0), WORDS).count() == 0


def test_damaged_block_and_table(spark):
    df = spark.createDataFrame([(i, "some words here " * 9) for i in range(20)], "doc_id long, text string")
    make = rans.word_tokenizer(WORDS)
    path = rans.write_token_files(df, make, 2, "<u2")
    blocks, slots = rans.open_token_files(spark, path)
    bad = blocks.withColumn("words", F.concat(F.expr("substring(words, 1, octet_length(words) - 1)"), F.lit(b"\x99")))
    with pytest.raises(Exception, match="damaged"):
        rans.decode_blocks(bad, slots, lambda ids: [len(ids)], "n int").count()
    table = spark.read.parquet(f"{path}/table")
    last = table.agg(F.max("id")).first()[0]
    one = F.when(F.col("id") == last, 1).otherwise(0)
    for wrong in (table.filter(F.col("id") != last), table.limit(0), table.withColumn("slots", F.col("slots") + one), table.withColumn("id", F.col("id") + one), table.unionByName(table.limit(1)), table.withColumn("crc32", F.col("crc32") + one)):
        with pytest.raises(ValueError, match="damaged"):
            rans.read_table(wrong)


def test_token_files_are_decoded_by_what_stands_in_them(spark):
    """A decoder of its own, state by state, that has the folder and nothing else."""
    import pyarrow.parquet as pq

    texts = ["a line of words, " * 40, "", None, "Überall  sonst"] * 9
    path = rans.write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rans.word_tokenizer(WORDS), 2, "<u2")
    folder = path.removeprefix("file:")
    table = sorted((r["id"], r["slots"]) for r in pq.read_table(f"{folder}/table").to_pylist())
    total, starts, at = sum(n for _, n in table), {}, 0
    by_slot = []
    for i, n in table:
        starts[i], at = at, at + n
        by_slot += [i] * n
    slots, got = dict(table), {}
    for b in pq.read_table(f"{folder}/blocks").to_pylist():
        states, words, ids = np.frombuffer(b["states"], "<u8").tolist(), iter(np.frombuffer(b["words"], "<u4").tolist()), []
        while len(ids) < b["n_ids"]:
            for lane, x in enumerate(states):
                slot = x % total
                i = by_slot[slot]
                ids.append(i)
                x = slots[i] * (x // total) + slot - starts[i]
                states[lane] = x if x >= 1 << 31 else x << 32 | next(words)
        at = 0
        for doc, n in zip(b["doc_ids"], b["doc_lengths"]):
            got[doc], at = ids[at : at + n], at + n
    library = Tokenizer.from_file(WORDS)
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}


PAYLOADS = st.one_of(st.binary(max_size=5000), st.integers(0, 255).map(lambda b: bytes([b]) * 3000), st.text(max_size=900).map(lambda t: t.encode()))


@settings(max_examples=40, deadline=None)
@given(st.lists(PAYLOADS, min_size=1, max_size=5))
def test_flac_round_trip(raw):
    data = [x + b"\0" * (max(64, -(-len(x) // 64) * 64) - len(x)) for x in raw]
    made = flac.encode_payloads(data)
    streams, tables = [s for s, _ in made], [t for _, t in made]
    for known in (tables, None):
        for x, p in zip(flac.decode_streams(streams, known), data):
            assert flac.to_pcm(x, 8)[0] == p


def test_flac_slabs(monkeypatch):
    """Slabs and small batches change nothing: the stream, its samples and its features are those of one pass."""
    raw = bytes(np.random.default_rng(5).integers(32, 122, 70_000).astype(np.uint8)) + bytes(22_016)
    whole = flac.encode_payloads([raw, raw[:64]])
    monkeypatch.setattr(flac, "SLAB", 4 * flac.BLOCK)
    monkeypatch.setattr(flac, "BATCH_BYTES", 5 * flac.BLOCK)
    monkeypatch.setattr(flac, "BATCH_FRAMES", 3)
    cut = flac.encode_payloads([raw, raw[:64]])
    assert [d for d, _ in cut] == [d for d, _ in whole] and (cut[0][1] == whole[0][1]).all()
    x = flac.decode_streams([d for d, _ in cut], [n for _, n in cut])[0]
    assert flac.to_pcm(x, 8)[0] == raw
    one, many = flac.Features(), flac.Features()
    one.add(x)
    for a in range(0, len(x), 1000):
        many.add(x[a : a + 1000])
    d = np.diff(x.astype(int))
    assert str(one) == str(many) and f"turns={((d[1:] * d[:-1]) < 0).sum()}" in str(one)


def test_flac_md5():
    data, table = flac.encode_payloads([b"some payload " * 40])[0]
    bad = bytearray(data)
    bad[26] ^= 1  # within the MD5 of the stream info
    with pytest.raises(flac.FlacError, match="MD5"):
        flac.decode_streams([bytes(bad)], [table])


def test_flac_memory_of_a_long_text():
    """24 MB in one text: what is needed beyond it and its stream is bounded (64 MB took 316 MB)."""
    import subprocess
    import sys

    code = """
import resource, numpy as np, pyarrow as pa
from tillage.llm import flac
raw = (b"The quick brown fox jumps over the lazy dog, %d times. " * 80)[:4096] * (MB << 8)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
data, table = flac.encode_payloads([raw])[0]
b = pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([table], pa.list_(pa.int32()))], names=["media", "frame_sizes"])
n = sum(len(x) for _, x, _, _, _ in flac._Media(b, flac.PCM_SAMPLES))
assert n == len(raw) == MB << 20
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    got = subprocess.run([sys.executable, "-c", code.replace("MB", "24")], capture_output=True, text=True, timeout=600)
    assert int(got.stdout.split()[-1]) < 500, got.stderr


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, v, n):
        self.bits += format(v & ((1 << n) - 1), f"0{n}b") if n else ""

    def bytes(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return int("1" + self.bits, 2).to_bytes(len(self.bits) // 8 + 1, "big")[1:]


def test_flac_other_encoders():
    """A 16-bit stream as other encoders write it: partitions, escapes, both Rice codings, wasted bits, verbatim, LPC."""
    rng = np.random.default_rng(4)
    want, frames = [], []
    for number, kind in enumerate(["partitions", "escape", "rice2", "wasted", "verbatim", "lpc"]):
        x = np.cumsum(rng.integers(-40, 41, 192)).astype(np.int64)
        x = x * 4 if kind == "wasted" else x
        w = Writer()
        for v, n in ((0x3FFE, 14), (0, 1), (0, 1), (1, 4), (0, 4), (0, 4), (4, 3), (0, 1), (number, 8)):
            w.put(v, n)
        w.put(flac.crc8(w.bytes()), 8)
        y, bits = (x >> 2, 14) if kind == "wasted" else (x, 16)
        if kind == "verbatim":
            w.put(1 << 1, 8)
            for v in y:
                w.put(int(v), 16)
        else:
            order = 2
            w.put(0, 1)
            w.put(32 + order - 1 if kind == "lpc" else 8 + order, 6)
            w.put(int(kind == "wasted"), 1)
            if kind == "wasted":
                w.put(1, 2)
            for v in y[:order]:
                w.put(int(v), bits)
            coefs, shift = ([29, -13], 4) if kind == "lpc" else ([2, -1], 0)
            if kind == "lpc":
                w.put(6 - 1, 4)
                w.put(shift, 5)
                for c in coefs:
                    w.put(c, 6)
            r = [int(y[t] - ((coefs[0] * y[t - 1] + coefs[1] * y[t - 2]) >> shift)) for t in range(order, 192)]
            parts = 2 if kind in ("partitions", "escape") else 0
            wide = 5 if kind == "rice2" else 4
            w.put(int(kind == "rice2"), 2)
            w.put(parts, 4)
            at = 0
            for p in range(1 << parts):
                n = (192 >> parts) - (order if p == 0 else 0)
                if kind == "escape" and p == 2:
                    w.put(15, 4)
                    w.put(9, 5)
                    for v in r[at : at + n]:
                        w.put(v, 9)
                else:
                    k = 5 if p % 2 else 0
                    w.put(k, wide)
                    for v in r[at : at + n]:
                        f = 2 * v if v >= 0 else -2 * v - 1
                        w.bits += "0" * (f >> k) + "1"
                        w.put(f, k)
                at += n
        body = w.bytes()
        crc = 0
        for b in body:
            crc = ((crc << 8) & 0xFFFF) ^ int(flac.CRC16[(crc >> 8) ^ b])
        frames.append(body + crc.to_bytes(2, "big"))
        want.append(x)
    info = (192).to_bytes(2, "big") * 2 + b"\0" * 6 + (8000 << 44 | 15 << 36 | 192 * 6).to_bytes(8, "big") + b"\0" * 16
    stream = b"fLaC" + b"\x00\x00\x00\x22" + info + b"\x84\x00\x00\x02ab" + b"".join(frames)
    assert (flac.decode_streams([stream])[0] == np.concatenate(want)).all()
    bad = bytearray(stream)
    bad[len(stream) - 40] ^= 1
    with pytest.raises(flac.FlacError):
        flac.decode_streams([bytes(bad)])


def test_media_on_spark(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (3, "y"), (3, "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("media", F.lit(1))
    got = {(r.doc_id, r.n_bytes): r for r in flac.media_digest(df).collect()}
    import hashlib

    for d, t in docs:
        n, p = flac.payload_of(t)
        r = got[d, n]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    blocks = flac.pcm_blocks(flac.encode_table(df.filter("doc_id = 8")), samples=1000).orderBy("block").collect()
    assert b"".join(r.pcm for r in blocks) == flac.payload_of(ODD[8])[1] and [r.sample_offset for r in blocks[:3]] == [0, 1000, 2000]
    media = flac.encode_table(df.filter("doc_id = 8"))
    pcm = flac.write_pcm(media, 1000)
    wanted = spark.createDataFrame([(8, 990, 2010), (8, 5, 6), (8, 10**9, 10**9 + 5), (8, 4, 4)], "doc_id long, start long, stop long")
    raw = flac.payload_of(ODD[8])[1]
    assert {r.start: bytes(r.pcm) for r in flac.seek(pcm, wanted, 1000).collect()} == {990: raw[990:2010], 5: raw[5:6]}
    assert flac.media_digest(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_library(library):
    import random

    rnd = random.Random(6)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = ODD + ["  ", " a  b ", "a\n\n  b\tc", "\x00\x01", "aaaaaaaaaaaaaa", "     ", "▁a b"] + ["".join(rnd.choices(pieces, k=25)) for _ in range(400)]
    for limit in (50, 200_000):
        coder = spiece.Encoder(spiece.PieceModel(PIECES), limit)
        for t, got in zip(texts, coder(texts, at_once=16)):
            assert np.frombuffer(got, coder.dtype).tolist() == library.encode(t or ""), t
            if "▁" not in (t or ""):
                assert coder.model.decode(np.frombuffer(got, coder.dtype).tolist()) == (t or "")


def test_long_runs_of_spaces(library):
    import time

    for text in (" " * 100_000, "a" + " " * 3001 + "b", "  x" * 20_000):
        began = time.time()
        coder = spiece.Encoder(spiece.PieceModel(PIECES))
        got = np.frombuffer(coder([text])[0], coder.dtype).tolist()
        assert time.time() - began < 5
        assert got == library.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=14), st.dictionaries(st.text("ab", min_size=2, max_size=4), st.integers(-5, 0), max_size=8))
def test_merges_restated(word, score):
    model = spiece.PieceModel.__new__(spiece.PieceModel)
    model.score = score
    parts = list(word)
    while True:
        known = [(score[parts[i] + parts[i + 1]], -i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in score]
        if not known:
            break
        i = -max(known)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert model.merges(word) == parts


def test_unigram_is_viterbi(library):
    """With kind unigram the pass finds the largest sum of scores, here by trying all cuts."""
    model = spiece.PieceModel(PIECES, "unigram")

    def best(word):
        if not word:
            return 0.0
        return max((model.score[word[:i]] + best(word[i:]) for i in range(1, len(word) + 1) if word[:i] in model.ids), default=-1e18)

    words = sorted(["▁there", "▁the", "▁then", "▁other", "▁cat", "▁cats"])
    for w, ids in zip(words, model.encode_sorted(words)):
        assert "".join(model.pieces[i] for i in ids) == w
        assert sum(model.score[model.pieces[i]] for i in ids) == pytest.approx(best(w))


def test_pieces_on_spark(spark, library):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").withColumn("ids", F.lit("x"))
    for r in spiece.encode_and_check(df, PIECES).collect():
        assert r.ids == library.encode(ODD[r.doc_id] or "") and r.round_trip and r.n_tokens == len(r.ids)
    back = spiece.decode(spiece.encode(df.drop("ids"), PIECES), PIECES)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert spiece.encode_and_check(df.limit(0), PIECES).count() == 0
