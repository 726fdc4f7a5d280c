"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is cut into marked words: each starts with its spaces, shown as the mark
U+2581, and no piece crosses such a start. The distinct new words of some texts are
sorted, which lays their trie out in depth-first order, and the forward pass
walks it: at each character place it settles the best last piece of the prefix
that ends there, and the next word takes over all places that it shares with the
word before it.

What is best depends on the model. For a unigram model it is the piece with the
largest sum of scores (Viterbi). For a BPE model, such as the public 32k one, the
library doesn't maximise a sum: it merges the neighbours with the best-scored
union until none is left. That too has one last piece for each prefix: the piece
next to which the merges of the prefix before it would stay as they are. The
forward pass tests this by undoing merges at the seam, so the results equal the
library's. Runs of marks, which hold pieces of equal score, are merged directly.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words and seams that a Python worker keeps at most.
WORDS = 200_000
SEAMS = 150_000
#: Texts handled at a time within a batch, which bounds the memory of long ones.
ROWS = 500
_cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


class PieceModel:
    """The pieces, scores and kinds of a SentencePiece file; kind is "bpe" or "unigram"."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.kind = kind
        self.unknown = sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        ranked = sorted(self.ids, key=lambda p: (-self.score[p], self.ids[p]))
        self.rank = {p: r for r, p in enumerate(ranked)}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.usable: set[str] = set()
        self.reach: dict[str, int] = {}  # the longest piece that ends in two characters
        self.control = [sp.is_control(i) for i in range(n)]

    def merges(self, word: str) -> list[str]:
        """The pieces that merging the best-scored neighbours, leftmost first, leaves of a word, in n log n steps."""
        parts: list[str | None] = list(word)
        n, get = len(parts), self.score.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, word[i : i + 2]) for i in range(n - 1) if (s := get(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, union = heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or parts[i] + parts[j] != union:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = union, None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := get(union + parts[after[i]])) is not None:
                    heappush(heap, (-s, i, union + parts[after[i]]))
            if before[i] >= 0 and (s := get(parts[before[i]] + union)) is not None:
                heappush(heap, (-s, before[i], parts[before[i]] + union))
        return [p for p in parts if p is not None]

    def _split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge, the last one, made this piece; None for a single character
        or a piece that merges can't make."""
        if piece not in self.halves:
            if len(piece) == 1:
                self.halves[piece] = None
            else:
                whole = self.score.pop(piece)
                parts = self.merges(piece)
                self.score[piece] = whole
                self.halves[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[piece]

    def _stays(self, left: str, right: str) -> bool:
        """Whether merging would keep left and right apart if they stood next to each other."""
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, ok, rank = left, right, True, self.rank
        bound = len(rank)
        while ok:
            # a and b meet at the seam in the state just before the merges of rank `bound` and later
            joined = rank.get(a + b)
            if joined is not None and joined < bound:
                ok = False
                break
            ra = rank[a] if len(a) > 1 else -1
            rb = rank[b] if len(b) > 1 else -1
            if ra < 0 and rb < 0:
                break
            # undo the later of the two merges; of equal ranks the right one came later
            if ra > rb:
                bound, a = ra, self._split(a)[1]
            else:
                bound, b = rb + 1, self._split(b)[0]
        if len(self.fits) >= SEAMS:
            self.fits.clear()
        self.fits[left, right] = ok
        return ok

    def _reachable(self) -> set[str]:
        """The pieces that can be in a result: of a BPE model those that merges can make."""
        if not self.usable:
            self.usable = {p for p in self.ids if self.kind != "bpe" or len(p) == 1 or self._split(p)}
            for p in self.usable:
                if len(p) > 1:
                    self.reach[p[-2:]] = max(len(p), self.reach.get(p[-2:], 1))
        return self.usable

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each word of a sorted list, reusing the forward pass of shared prefixes."""
        last: list[str] = [""]  # the last piece of the prefix that ends at each place
        best: list[float] = [0.0]
        before = ""
        bpe = self.kind == "bpe"
        usable, seen, reach = self._reachable(), self.fits.get, self.reach
        unknown = min(self.score.values(), default=0.0) - 10.0
        for word in words:
            if bpe and word.startswith(MARK * 2):
                yield self._as_ids(self.merges(word))
                continue
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                far = reach.get(word[end - 2 : end], 1) if end > 1 else 1
                first = end - far if end > far else 0
                if bpe:
                    for start in range(first, end):
                        piece = word[start:end]
                        if piece in usable:
                            if not start:
                                break
                            stays = seen((last[start], piece))
                            if stays or stays is None and self._stays(last[start], piece):
                                break
                    else:
                        piece = word[end - 1]
                    last.append(piece)
                    continue
                found, score = word[end - 1], best[end - 1] + unknown
                for start in range(first, end):
                    piece = word[start:end]
                    if piece in usable and (best[start] + self.score[piece] > score or found not in usable):
                        found, score = piece, best[start] + self.score[piece]
                last.append(found)
                best.append(score)
            before = word
            parts, end = [], len(word)
            while end:
                parts.append(last[end])
                end -= len(last[end])
            yield self._as_ids(parts[::-1])

    def _as_ids(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8")]
            else:
                out.append(self.unknown)
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids: pieces joined, byte pieces decoded together, marks as spaces, the first one dropped."""
        if not hasattr(self, "raw"):
            self.raw = [p.encode() for p in self.pieces]
            for b, i in self.bytes.items():
                self.raw[i] = bytes([b])
            for i, c in enumerate(self.control):
                if c:
                    self.raw[i] = b""
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


class Encoder:
    """Encodes batches of texts. Words once encoded are kept, in two stores of up to `limit` words each: when the newer one is
    full the older one goes, so words that keep coming back stay. Results don't depend on the limit."""

    _made: dict[tuple, Encoder] = {}

    @classmethod
    def shared(cls, path: str, kind: str, limit: int = WORDS) -> Encoder:
        if (path, kind, limit) not in cls._made:
            cls._made[path, kind, limit] = cls(PieceModel(path, kind), limit)
        return cls._made[path, kind, limit]

    def __init__(self, model: PieceModel, limit: int = WORDS):
        self.model, self.limit = model, limit
        self.dtype = np.dtype("<u2" if len(model.pieces) <= 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _missing(self, cut: list[list[str]]) -> set[str]:
        """The words in neither store; those in the older one move up."""
        new = set().union(*cut).difference(self.words)
        back = new.intersection(self.older)
        self.words.update((w, self.older[w]) for w in back)
        return new - back

    @staticmethod
    def marked(text: str) -> list[str]:
        """The words of a text, which starts with a mark of its own; a word's only mark is left out."""
        if MARK in text or "  " in text or text[:1] == " " or text[-1:] == " ":
            return [w if w[1:2] == MARK else w[1:] for w in _cut(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def __call__(self, texts: list[str | None], at_once: int = 128) -> list[bytes]:
        out = []
        for start in range(0, len(texts), at_once):
            cut = [self.marked(t) if t else [] for t in texts[start : start + at_once]]
            new = self._missing(cut)
            if len(self.words) + len(new) > self.limit:
                self.older, self.words = self.words, {}
                new = self._missing(cut)
            order = sorted(new)
            for w, ids in zip(order, self.model.encode_sorted([w if w[:1] == MARK else MARK + w for w in order])):
                self.words[w] = array(self.dtype.char, ids).tobytes()
            get = self.words.__getitem__
            out += [b"".join(map(get, x)) for x in cut]
        return out


def encode(docs: DataFrame, path: str, kind: str = "bpe", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns and ids (array<int>) of each whole text; a null or empty text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.shared(path, kind)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                found = [np.frombuffer(x, coder.dtype) for x in coder(b.column(b.num_columns - 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(found)], names=[*keep, "ids"])

    picked = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(run, f"{kinds}, ids array<int>")


def decode(tokens: DataFrame, path: str, kind: str = "bpe", ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns and text, decoded from ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Encoder.shared(path, kind).model
        for b in batches:
            texts = [model.decode(x or []) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    picked = tokens.select(*keep, F.col(ids).alias("_ids"))
    kinds = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(run, f"{kinds}, text string")


def encode_and_check(docs: DataFrame, path: str, kind: str = "bpe", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, ids, round_trip) of each row of docs, from its whole text.

    ids is what encode gives, ids_crc32 the CRC-32 of them as little-endian
    uint32, and round_trip whether decode gives the text back (true for a null
    text, whose ids are empty). A text that holds the mark U+2581 itself comes
    back with spaces for it. Other columns are ignored; repeated rows give equal rows; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.shared(path, kind)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                texts = b.column("text").to_pylist()
                found = [np.frombuffer(x, coder.dtype) for x in coder(texts)]
                same = [coder.model.decode(x.tolist()) == (t or "") for x, t in zip(found, texts)]
                sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in found]
                cols = [b.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array(sums, pa.int64()), _lists(found), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_crc32", "ids", "round_trip"])

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>, round_trip boolean")


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*found, np.zeros(0, "<u2")]).astype(np.int32)))
