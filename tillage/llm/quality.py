"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it.
Each byte has a fixed description (its kind and the bits of its value); learned
filters look at eight bytes at a time, and their answers are max-pooled over a
chunk. A document's chunks are pooled by mean and by maximum and combined into
one probability. Filters and combination are trained together by backpropagation
(Adam) on a bounded sample of labelled documents, each with all of its chunks, with
balanced classes; the intercept is then moved to the classes' shares among all labels.

For scoring, a filter is a table from (place, byte) to a number, so a chunk costs
eight look-ups at each place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import bounded_sample, filter_texts, held_out, sigmoid, written

WIDTH = 8
STEP = 4
STRIDE = 128
CHUNK = STRIDE + WIDTH
FILTERS = 24
PLACES = (CHUNK - WIDTH) // STEP + 1
#: Bytes scored at a time, which bounds the memory of a very long text.
PIECE = STRIDE * 2048
#: Chunks whose filter answers are held at a time in training.
CHUNKS_AT_ONCE = 2048
THRESHOLD = 0.3
UPDATES = 500
#: The training sample: documents of each class, and bytes of all of them.
PER_CLASS = 1000
SAMPLE_BYTES = 48 << 20


def _byte_kinds() -> np.ndarray:
    b = np.arange(256)
    lower, upper = (b >= 97) & (b <= 122), (b >= 65) & (b <= 90)
    kinds = [b == 0, lower, upper, (b >= 48) & (b <= 57), b == 32, (b == 10) | (b == 13) | (b == 9), b >= 128]
    kinds += [(b > 32) & (b < 127) & ~lower & ~upper & ~((b >= 48) & (b <= 57))]
    kinds += [((b >> k) & 1) * (b > 32) for k in range(5)]
    return np.stack(kinds, 1).astype(np.float32)


KINDS = _byte_kinds()


def chunks(data: bytes) -> np.ndarray:
    """Rows of CHUNK bytes at every STRIDE, zeros after the end; each byte is in one at least."""
    n = max(1, -(-(len(data) - WIDTH) // STRIDE)) if len(data) > CHUNK else 1
    padded = np.zeros(n * STRIDE + WIDTH, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]


def _windows(rows: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(rows, WIDTH, axis=1)[:, ::STEP]


@dataclass
class QualityModel:
    filters: np.ndarray  # (WIDTH * kinds, FILTERS)
    offset: np.ndarray  # (FILTERS,)
    mean_w: np.ndarray
    max_w: np.ndarray
    bias: float
    constant: float | None = None

    def tables(self) -> np.ndarray:
        return np.einsum("bk,wkf->wbf", KINDS, self.filters.reshape(WIDTH, KINDS.shape[1], -1))

    def pooled(self, rows: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """ReLU of each filter's largest answer in each chunk."""
        windows = _windows(rows)
        out = np.take(tables[0], windows[..., 0], axis=0)
        for k in range(1, WIDTH):
            out += np.take(tables[k], windows[..., k], axis=0)
        return np.maximum(out.max(1) + self.offset, 0)

    def scorer(self):
        """text -> probability, over the whole text; a null text counts as empty."""
        if self.constant is not None:
            return lambda text: self.constant
        tables = self.tables()

        def score(text: str | None) -> float:
            data = (text or "").encode("utf-8", "surrogatepass")
            total, top, n = np.zeros(len(self.offset)), np.zeros(len(self.offset)), 0
            for at in range(0, max(1, len(data) - WIDTH), PIECE):
                h = self.pooled(chunks(data[at : at + PIECE + WIDTH]), tables)
                total += h.sum(0)
                top = np.maximum(top, h.max(0))
                n += len(h)
            return float(sigmoid(self.mean_w @ (total / n) + self.max_w @ top + self.bias))

        return score


def gradient(p: dict[str, np.ndarray], docs: list[np.ndarray], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean logistic loss over documents (their chunks) with labels y, and its gradient for each parameter:
    w filters, o offsets, m and x weights of mean and maximum, b bias. Of equal maxima each gets its share."""
    rows = np.concatenate(docs)
    sizes = np.array([len(d) for d in docs])
    of = np.repeat(np.arange(len(docs)), sizes)
    first = np.cumsum(sizes) - sizes
    kinds, filters = KINDS.shape[1], len(p["o"])
    tables = QualityModel(p["w"], p["o"], p["m"], p["x"], 0.0).tables()
    where, h = np.empty((len(rows), filters), np.int64), np.empty((len(rows), filters), p["w"].dtype)
    pieces = [slice(a, a + CHUNKS_AT_ONCE) for a in range(0, len(rows), CHUNKS_AT_ONCE)]
    for s in pieces:
        windows = _windows(rows[s])
        answers = np.take(tables[0], windows[..., 0], axis=0)
        for k in range(1, WIDTH):
            answers += np.take(tables[k], windows[..., k], axis=0)
        where[s] = answers.argmax(1)
        h[s] = np.maximum(np.take_along_axis(answers, where[s][:, None], 1)[:, 0] + p["o"], 0)
    mean = np.add.reduceat(h, first) / sizes[:, None]
    top = np.maximum.reduceat(h, first)
    z = mean @ p["m"] + top @ p["x"] + p["b"]
    loss = float(np.mean(np.logaddexp(0, z) - y * z))
    e = ((sigmoid(z) - y) / len(docs)).astype(p["w"].dtype)
    is_top = (h == top[of]) & (h > 0)
    share = is_top / np.maximum(np.add.reduceat(is_top.astype(p["w"].dtype), first), 1)[of]
    dh = (e[of, None] * (p["m"] / sizes[of, None] + p["x"] * share)) * (h > 0)
    dw = np.zeros((WIDTH, kinds, filters), p["w"].dtype)
    for s in pieces:
        windows, at = _windows(rows[s]), where[s]
        for k in range(WIDTH):
            seen = KINDS[windows[np.arange(len(at))[:, None], at, k]]
            dw[k] += np.einsum("rfk,rf->kf", seen, dh[s])
    return loss, {"w": dw.reshape(-1, filters), "o": dh.sum(0), "m": mean.T @ e, "x": top.T @ e, "b": e.sum(keepdims=True)}


def fit(docs: list[np.ndarray], y: np.ndarray, epochs: int | None = None, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> QualityModel:
    """Train on each document's chunks (rows of CHUNK bytes) and its label, for some UPDATES steps at least."""
    epochs = epochs or max(10, -(-UPDATES * batch // len(docs)))
    rng, kinds = np.random.default_rng(seed), KINDS.shape[1]
    p = {
        "w": rng.normal(0, 0.35, (WIDTH * kinds, FILTERS)).astype(np.float32),
        "o": np.zeros(FILTERS, np.float32),
        "m": rng.normal(0, 0.1, FILTERS).astype(np.float32),
        "x": rng.normal(0, 0.1, FILTERS).astype(np.float32),
        "b": np.zeros(1, np.float32),
    }
    m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        for ids in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)):
            _, g = gradient(p, [docs[i] for i in ids], y[ids])
            t += 1
            pace = rate * (1 - 0.8 * epoch / epochs)
            for k in p:
                d = g[k] + decay * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                p[k] = (p[k] - pace * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return QualityModel(p["w"], p["o"], p["m"], p["x"], float(p["b"][0]))


def within_bytes(rows: list[tuple], most: int) -> list:
    """Ids of rows (id, label, hash, bytes), labels in turns and each in the order of its hashes, as long as they fit `most` bytes.
    A row that doesn't fit is left out whole."""
    turn: dict[int, int] = {}
    queue = []
    for i, y, h, n in sorted(rows, key=lambda r: (r[2], r[0])):
        turn[y] = turn.get(y, 0) + 1
        queue.append((turn[y], y, i, n))
    kept, used = [], 0
    for _, _, i, n in sorted(queue):
        if used + n <= most:
            kept.append(i)
            used += n
    return kept


def train(docs: DataFrame, labels: DataFrame, text: str = "text", per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES, key: str = "doc_id", label: str = "quality") -> QualityModel:
    """Train on a bounded sample of labelled rows that aren't held out: at most per_class of each class and
    sample_bytes of text in all. A sampled document is trained on with all of its chunks.

    Labels that are null or neither 0 nor 1 don't count, of several labels of one
    document the smallest does, and of several texts the least. With one class only the score is a constant,
    (n1 + 1) / (n + 2) of the labels. Columns other than key, text and label are ignored, whatever they are called.
    """
    marks = (
        labels.select(F.col(key).alias("_id"), F.col(label).alias("_mark"))
        .filter(F.col("_mark").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
        .groupBy("_id")
        .agg(F.min("_mark").cast("int").alias("_y"))
    )
    shares = {r["_y"]: r["count"] for r in marks.groupBy("_y").count().collect()}
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    prior = (n1 + 1) / (n0 + n1 + 2)
    picked = bounded_sample(marks, "_y", "_id", per_class, seed=3)
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    chosen = texts.join(F.broadcast(picked), "_id").groupBy(F.col("_id").cast("bigint").alias("k"), F.col("_y").alias("y"), F.col("_hash").alias("h")).agg(F.min("_text").alias("t"))
    chosen = written(chosen.select("k", "y", "h", F.coalesce(F.col("t"), F.lit("")).cast("binary").alias("t")), "quality-sample")
    ids = within_bytes([tuple(r) for r in chosen.select("k", "y", "h", F.octet_length("t")).collect()], sample_bytes)
    sample = sorted((r.k, r.y, bytes(r.t)) for r in chosen.filter(F.col("k").isin(ids)).collect()) if ids else []
    y = np.array([r[1] for r in sample], np.float32)
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros((1, 1)), np.zeros(1), np.zeros(1), np.zeros(1), 0.0, prior)
    parts = [chunks(r[2]) for r in sample]
    smaller = [i for i in range(len(y)) if y[i] == (y.mean() < 0.5)]
    repeats = int(round(max(y.mean(), 1 - y.mean()) * len(y) / max(1, len(smaller)))) - 1
    more = smaller * max(0, min(repeats, 9))
    parts, y = parts + [parts[i] for i in more], np.concatenate([y, y[more]]) if more else y
    model = fit(parts, y)
    model.bias += float(np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean())))
    return model


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns and score; only the text is looked at, all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            found = [of(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.float64())], names=[*keep, "score"])

    picked = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(run, f"{kinds}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; a null text is scored like an empty one.

    Repeated rows get equal scores, a score equal to the threshold counts as good, further columns are ignored and
    an empty table gives no rows.
    """
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs' rows whose score reaches the threshold, a null text scored like an empty one; columns stay as they are."""
    model = train(docs, labels)
    held: list = []

    def accept(text: str | None) -> bool:
        if not held:
            held.append(model.scorer())
        return held[0](text) >= threshold

    return filter_texts(docs, accept)
