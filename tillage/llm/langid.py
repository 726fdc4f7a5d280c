"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased texts give hashed n-grams of one to three characters, counted over
the whole text. Document frequencies are counted over all training rows. The
weights are trained by follow-the-regularised-leader with elastic-net penalties
on a sample of at most `max_docs` labelled rows, at most `per_lang` of each
language, chosen by hash and dealt to the languages in turns; a temperature is then fitted to a fifth of the sample
that training leaves out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.llm.common import bounded_sample, filter_texts, held_out

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Code points hashed at a time, which bounds the memory of a very long text.
PIECE = 1 << 20


def ngram_counts(text: str, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """How often each bucket's character n-grams occur in the whole text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    counts, most, shift = np.zeros(buckets, np.int64), max(orders), np.uint32(32 - (buckets - 1).bit_length())
    for at in range(0, len(points), PIECE):
        piece = points[at : at + PIECE + most - 1]
        h = np.zeros(len(piece), np.uint32)
        for n in range(1, most + 1):
            if len(piece) < n:
                break
            h = (h[: len(piece) - n + 1] + piece[n - 1 :] + np.uint32(n)) * np.uint32(2654435761)
            if n in orders:
                counts += np.bincount((h[:PIECE] >> shift).astype(np.int64), minlength=buckets)
    return counts


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, which: np.ndarray, tf: np.ndarray) -> np.ndarray:
        value = (1 + np.log(tf)) * self.idf[which]
        norm = np.sqrt(value @ value) or 1.0
        return (value / norm).astype(np.float32) @ self.weights[which] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability), (`und`, 0) without a letter or without a model."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        counts = ngram_counts(text, len(self.idf))
        which = np.flatnonzero(counts)
        z = self.logits(which, counts[which]) / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(p))
        return self.langs[k], float(p[k] / p.sum())


def document_frequencies(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """(documents that have each bucket, documents) over all rows. The driver gets `buckets` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(buckets, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                df += ngram_counts(t, buckets) > 0
                n += 1
        where = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *where], pa.int64()), pa.array([n, *df[where]], pa.int64())], names=["bucket", "df"]
        )

    rows = docs.filter(F.col(text).isNotNull()).select(text).mapInArrow(run, "bucket bigint, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(buckets, np.int64)
    real = rows[rows.bucket >= 0]
    out[real.bucket.to_numpy()] = real.df.to_numpy()
    return out, int(rows[rows.bucket < 0].df.sum())


def _sample(docs: DataFrame, text: str, lang: str, key: str, per_lang: int, max_docs: int, buckets: int) -> list:
    """Sparse counts of the sampled rows: at most per_lang of a language, max_docs in all.

    The total is dealt in turns, a row of each language at a time, so a language
    keeps its share whatever its size, and what small ones leave goes to the rest.
    """
    turn = F.row_number().over(Window.partitionBy("_lang").orderBy("_hash", "_id"))
    picked = (
        bounded_sample(docs.select(F.col(key).alias("_id"), F.col(lang).alias("_lang")), "_lang", "_id", per_lang, seed=11)
        .withColumn("_turn", turn)
        .orderBy("_turn", "_hash", "_id", "_lang")
        .limit(max_docs)
        .select("_id")
        .distinct()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, tf, names, keys = [], [], [], []
            for k, name, t in zip(*(c.to_pylist() for c in b.columns)):
                counts = ngram_counts(t, buckets)
                nz = np.flatnonzero(counts)
                which.append(nz.astype("<i4").tobytes())
                tf.append(counts[nz].astype("<i8").tobytes())
                names.append(name)
                keys.append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(names, pa.string()), pa.array(which, pa.binary()), pa.array(tf, pa.binary())],
                names=["k", "lang", "which", "tf"],
            )

    texts = docs.select(F.col(key).alias("_id"), F.col(lang).alias("l"), F.col(text).alias("t"))
    chosen = texts.join(F.broadcast(picked), "_id", "left_semi").groupBy(F.col("_id").cast("bigint").alias("k")).agg(F.min(F.struct("l", "t")).alias("r"))
    chosen = chosen.select("k", "r.l", "r.t")
    rows = chosen.mapInArrow(run, "k bigint, lang string, which binary, tf binary").collect()
    found = [(r.k, r.lang, np.frombuffer(r.which, "<i4"), np.frombuffer(r.tf, "<i8")) for r in rows]
    return sorted(found, key=lambda r: (r[0], r[1], r[2].tobytes()))


def fit_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, dims: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by FTRL-proximal; l1 and l2 are the elastic net, l1 leaves most weights exactly 0."""
    z, n = np.zeros((dims + 1, n_classes)), np.zeros((dims + 1, n_classes))

    def weights(zi: np.ndarray, ni: np.ndarray, penalty: float) -> np.ndarray:
        return -np.sign(zi) * np.maximum(np.abs(zi) - penalty, 0) / ((beta + np.sqrt(ni)) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            which, value, y = examples[i]
            zi, ni = z[which], n[which]
            w = weights(zi, ni, l1)
            wb = weights(z[-1], n[-1], 0.0)
            s = value @ w + wb
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = value[:, None] * p
            z[which] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[which] = ni + g * g
            z[-1] += p - (np.sqrt(n[-1] + p * p) - np.sqrt(n[-1])) / alpha * wb
            n[-1] += p * p
    return weights(z[:-1], n[:-1], l1).astype(np.float32), weights(z[-1], n[-1], 0.0)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by ternary search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    lo, hi = np.log(0.05), np.log(20.0)
    for _ in range(60):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_on: Column | None = None, per_lang: int = 800, max_docs: int = 4000, buckets: int = BUCKETS) -> LanguageModel:
    """A model of the rows that train_on marks and whose lang, key and text aren't null.

    Document frequencies are of all of those; weights are of the bounded
    sample. Without any such row the model has no language.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    rows = rows.filter(train_on) if train_on is not None else rows
    df, n = document_frequencies(rows, text, buckets)
    idf = np.log((1 + n) / (1 + df)) + 1
    sample = _sample(rows, text, lang, key, per_lang, max_docs, buckets)
    langs = sorted({r[1] for r in sample})
    model = LanguageModel(langs, idf, np.zeros((buckets, len(langs)), np.float32), np.zeros(len(langs)))
    if not langs:
        return model
    examples = []
    for _, name, which, tf in sample:
        value = (1 + np.log(tf)) * idf[which]
        examples.append((which, value / (np.sqrt(value @ value) or 1.0), langs.index(name)))
    apart = [i for i in range(len(examples)) if i % 5 == 0] if len(examples) >= 20 else []
    rest = sorted(set(range(len(examples))) - set(apart))
    model.weights, model.bias = fit_ftrl([examples[i] for i in rest], len(langs), buckets)
    scores = np.array([examples[i][1] @ model.weights[examples[i][0]] + model.bias for i in apart])
    model.temperature = fit_temperature(scores, np.array([examples[i][2] for i in apart]))
    return model


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns with lang_pred and score. Only the text is looked at, all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    picked = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row: trained on the rows not held out.

    lang_pred is a language learned, or `und` (score 0) where the text is null
    or has no letter or no row has a language to learn from. Of languages that are equally
    likely the first by code point is told. Repeated rows get equal results (of
    a doc_id that repeats with different texts, training takes the least language and
    text); columns other than doc_id, text and lang are ignored, and an empty table gives no rows.
    """
    model = train(docs, train_on=~held_out(), **options)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.3, **options) -> DataFrame:
    """docs whose language is told with a probability of `least` or more; columns stay as they are."""
    model = train(docs, train_on=~held_out(), **options)
    known = lambda found: found[0] != UNKNOWN and found[1] >= least
    return filter_texts(docs, lambda t: known(model.predict(t)), text="text")
