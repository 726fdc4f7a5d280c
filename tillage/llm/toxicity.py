"""Toxicity by a classifier chain of linear models.

The categories form a chain. Each has a logistic model over the words (and beginnings
of words) of the whole text that tell most about toxicity, and over the probabilities of all earlier
categories. Those probabilities come, in training, from models that did not see
the document (out-of-fold): a fold's documents take part neither in the choice of the words nor in the fit
of the model that answers for them. So a later model meets earlier answers as good as it will meet when scoring.

The labels mark only whether a document is toxic. The earlier categories are found in the data: the
toxic training documents are grouped by the telling words they hold (k-means on directions), so that
documents that abuse in the same words, and so in one language, are one kind. The last
category is toxicity itself, learned from the labels alone.

All this is fitted on a sample of at most `per_class` labelled documents of each label.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import bounded_sample, held_out, sigmoid, written

#: Kinds of toxicity that are found in the data, and the last category.
KINDS = 3
LAST = "toxic"
#: Words and beginnings of words that the models look at, at most, and how much one must tell (a squared z score).
WORDS = 256
TELLS = 12.0
#: How many times more of the toxic than of the other documents must hold it, so that words of a language don't count.
LIFT = 8.0
FOLDS = 5
THRESHOLD = 0.4

_words = re.compile(r"\w+").findall


#: Feature 0 of every model: the logarithm of the number of words.
LENGTH = "#words"


def words_of(text: str | None) -> dict[str, int]:
    """Counts of the lower-cased words of a whole text, and under ^ of the first 4 and 5 letters
    of each longer word, as insults are inflected; nothing for a null text."""
    found: dict[str, int] = Counter(_words(text.lower())) if text else {}
    starts: dict[str, int] = {}
    for w, n in found.items():
        if len(w) > 4:
            starts["^" + w[:4]] = starts.get("^" + w[:4], 0) + n
            if len(w) > 5:
                starts["^" + w[:5]] = starts.get("^" + w[:5], 0) + n
    return {**found, **starts}


def strength(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1.0 + np.asarray(counts, np.float64)), 3.0)


def length_value(words: dict[str, int]) -> float:
    return float(np.log2(1 + sum(n for w, n in words.items() if w[0] != "^")) / 8)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.0003, steps: int = 300) -> np.ndarray:
    """Weights (intercept last) by accelerated gradient descent; classes weigh the same, so rare ones count."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    n1 = y.sum()
    if not 0 < n1 < len(y):
        w = np.zeros(x.shape[1])
        w[-1] = 12.0 if n1 else -12.0
        return w
    share = np.where(y > 0, 0.5 / n1, 0.5 / (len(y) - n1))
    v = np.ones(x.shape[1])
    for _ in range(12):  # the largest curvature, by power iteration
        v = x.T @ (share * (x @ v))
        v /= np.linalg.norm(v)
    rate = 1.0 / (0.25 * np.linalg.norm(x.T @ (share * (x @ v))) + l2)
    w, ahead = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    keep = np.r_[np.full(x.shape[1] - 1, l2), 0.0]
    for t in range(steps):
        g = x.T @ (share * (sigmoid(x @ ahead) - y)) + keep * ahead
        new = ahead - rate * g
        ahead = new + t / (t + 3) * (new - w)
        w = new
    return w


@dataclass
class ToxicityChain:
    words: list[str]
    order: list[str]
    weights: list[np.ndarray] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A column for each category in chain order, from rows of values of LENGTH and words."""
        for w in self.weights:
            x = np.hstack([x, sigmoid(x @ w[:-1] + w[-1])[:, None]])
        return x[:, len(self.words) :]

    def scorer(self):
        """text -> probabilities in chain order. Words that are absent cost nothing."""
        place = {w: i for i, w in enumerate(self.words)}
        n = len(place)

        def score(text: str | None) -> list[float]:
            words = words_of(text)
            which = [place[w] for w in words if w in place]
            value = strength([words[self.words[i]] for i in which])
            length = length_value(words)
            earlier: list[float] = []
            for w in self.weights:
                s = float(w[which] @ value + w[0] * length + w[n : n + len(earlier)] @ np.array(earlier) + w[-1])
                earlier.append(float(sigmoid(np.array(s))))
            return earlier

        return score


def kinds_of(x: np.ndarray, kinds: int = KINDS, rounds: int = 20) -> np.ndarray:
    """The kind (0 to kinds - 1) of each row of word values, by k-means on the rows' directions.

    The first centre is the commonest direction, each further one the row farthest from those chosen; ties go to
    the first row. Rows without a word are of the last kind. Kinds are numbered by size.
    """
    norm = np.sqrt((x * x).sum(1))
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    live = np.flatnonzero(norm > 0)
    out = np.full(len(x), kinds - 1)
    if not len(live):
        return out
    u = unit[live]
    mean = u.sum(0)
    centres = [mean / np.linalg.norm(mean)]
    while len(centres) < kinds:
        centres.append(u[int(np.argmin(np.max(u @ np.array(centres).T, axis=1)))])
    c = np.array(centres)
    for _ in range(rounds):
        of = (u @ c.T).argmax(1)
        sums = np.stack([u[of == k].sum(0) if (of == k).any() else c[k] for k in range(kinds)])
        c = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    by_size = np.argsort(-np.bincount(of, minlength=kinds), kind="stable")
    out[live] = np.argsort(by_size)[of]
    return out


def fit_chain(words: list[str], x: np.ndarray, targets: dict[str, np.ndarray], shares: dict[str, float], fold: np.ndarray, chosen: list[np.ndarray]) -> ToxicityChain:
    """Fit the chain on rows of values of LENGTH and words; targets in chain order, fold the number of each row's fold.

    chosen holds, for each fold, the columns that documents of the other folds choose, and last those that all choose.
    shares gives each category's share among all documents, to which its intercept is moved.
    """
    chain = ToxicityChain([words[c] for c in chosen[-1]], list(targets))
    answers = np.zeros((len(x), 0))
    for name, y in targets.items():
        shift = np.log(shares[name] / (1 - shares[name]))
        unseen = np.zeros(len(x))
        for k in range(len(chosen) - 1):
            inputs = np.hstack([x[:, chosen[k]], answers])
            w = fit_logistic(inputs[fold != k], y[fold != k])
            unseen[fold == k] = sigmoid(inputs[fold == k] @ w[:-1] + w[-1] + shift)
        w = fit_logistic(np.hstack([x[:, chosen[-1]], answers]), y)
        w[-1] += shift
        chain.weights.append(w)
        answers = np.hstack([answers, unseen[:, None]])
    return chain


def _telling(counts: DataFrame, n0: Column, n1: Column, n_words: int) -> DataFrame:
    """The at most n_words words of counts that tell most, n0 and n1 being the documents of both labels that hold each."""
    total0, total1 = (F.col(c) for c in ("t0", "t1"))
    p1, p0 = (n1 + 0.5) / (total1 + 1), (n0 + 0.5) / (total0 + 1)
    tells = F.pow(p1 - p0, 2) / (p1 * (1 - p1) / (total1 + 1) + p0 * (1 - p0) / (total0 + 1))
    return counts.filter(n0 + n1 >= 3).withColumn("tells", tells).filter((F.col("tells") >= TELLS) & (p1 / p0 >= LIFT)).orderBy(F.desc("tells"), "word").limit(n_words)


def telling_words(rows: DataFrame, n_words: int, folds: int) -> list[list[str]]:
    """For each fold the words that tell most in the other folds, and last those of all rows (k, y, fold, t).

    Words are counted as documents that hold them, by label and fold. The driver gets n_words words a list.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, int], list[int]] = {}
            for y, f, t in zip(*(b.column(c).to_pylist() for c in ("y", "fold", "t"))):
                for w in words_of(t):
                    seen.setdefault((w, f), [0, 0])[y] += 1  # documents, not places
            cols = [pa.array([w for w, _ in seen], pa.string()), pa.array([f for _, f in seen], pa.int32())]
            cols += [pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names=["word", "fold", "n0", "n1"])

    sizes = {(r["y"], r["fold"]): r["count"] for r in rows.groupBy("y", "fold").count().collect()}
    each = rows.select("y", "fold", "t").mapInArrow(split, "word string, fold int, n0 bigint, n1 bigint")
    sums = [F.sum(F.when(F.col("fold") != k, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for k in range(folds + 1) for c in ("n0", "n1")]
    counts = written(each.groupBy("word").agg(*sums), "toxicity-words")
    lists = None
    for k in range(folds + 1):
        total = {y: sum(n for (z, f), n in sizes.items() if z == y and f != k) for y in (0, 1)}
        top = _telling(counts.withColumns({"t0": F.lit(total[0]), "t1": F.lit(total[1])}), F.col(f"n0_{k}"), F.col(f"n1_{k}"), n_words).select(F.lit(k).alias("k"), "word")
        lists = top if lists is None else lists.unionByName(top)
    found = lists.collect()
    return [sorted({r["word"] for r in found if r["k"] == k}) for k in range(folds + 1)]


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", kinds: int = KINDS, n_words: int = WORDS, per_class: int = 3200, folds: int = FOLDS) -> ToxicityChain:
    """A chain learned from labelled documents that aren't held out.

    Labels that are null or neither 0 nor 1 don't count; of several labels of one
    document the largest does, of several texts the least. Without labels the chain is empty. Columns other than
    key, text and label are ignored, whatever they are called.
    """
    marks = (
        labels.select(F.col(key).alias("_id"), F.col(label).alias("_mark"))
        .filter(F.col("_mark").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
        .groupBy("_id")
        .agg(F.max("_mark").cast("int").alias("_y"))
    )
    overall = {r["_y"]: r["count"] for r in marks.groupBy("_y").count().collect()}
    picked = bounded_sample(marks, "_y", "_id", per_class, seed=5)
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    rows = texts.join(F.broadcast(picked), "_id").groupBy(F.col("_id").cast("bigint").alias("k"), F.col("_y").alias("y")).agg(F.min("_text").alias("t"))
    rows = written(rows.withColumn("fold", F.pmod(F.xxhash64("k", F.lit(17)), F.lit(folds)).cast("int")), "toxicity-sample")
    lists = telling_words(rows, n_words, folds)
    if not rows.head(1):
        return ToxicityChain([], [])
    words = [LENGTH, *sorted(set().union(*lists))]
    wanted = set(words)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, values, lengths = [], [], []
            for t in b.column("t").to_pylist():
                counts = words_of(t)
                found.append(sorted(wanted.intersection(counts)))
                values.append(strength([counts[w] for w in found[-1]]).tolist())
                lengths.append(length_value(counts))
            cols = [b.column("k"), b.column("y"), b.column("fold"), pa.array(found, pa.list_(pa.string())), pa.array(values, pa.list_(pa.float64())), pa.array(lengths, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "y", "fold", "words", "counts", "length"])

    picked_rows = rows.select("k", "y", "fold", "t").mapInArrow(pick, "k bigint, y int, fold int, words array<string>, counts array<double>, length double").collect()
    sample = sorted((r.k, r.y, r.fold, r.words, r.counts, r.length) for r in picked_rows)
    place = {w: i for i, w in enumerate(words)}
    x = np.zeros((len(sample), len(words)), np.float32)
    for i, (_, _, _, found, values, length) in enumerate(sample):
        x[i, 0] = length
        x[i, [place[w] for w in found]] = values
    toxic = np.array([r[1] for r in sample], np.float64)
    fold = np.array([r[2] for r in sample])
    chosen = [np.array([0, *(place[w] for w in ws)]) for ws in lists]
    kind = np.full(len(sample), -1)
    kind[toxic > 0] = kinds_of(x[toxic > 0][:, chosen[-1][1:]].astype(np.float64), kinds)
    targets = {f"kind_{k + 1}": (kind == k).astype(np.float64) for k in range(kinds)}
    overall = (overall.get(1, 0) + 1) / (sum(overall.values()) + 2)
    shares = {name: max(overall * (y.sum() + 1) / (toxic.sum() + 1), 1e-4) for name, y in targets.items()}
    shares = {name: min(share, 1 - 1e-4) for name, share in shares.items()}
    return fit_chain(words, x, targets | {LAST: toxic}, shares | {LAST: overall}, fold, chosen)


def classify(docs: DataFrame, labels: DataFrame, kinds: int = KINDS, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """(doc_id, held_out, p_<category> for each in chain order, toxic_pred) for each row of docs.

    Whole texts are scored from their words alone. A null text has no words and is scored like an empty one; repeated
    rows get equal results; a probability equal to the threshold counts as toxic. Without labels every probability is
    0. Columns other than doc_id and the text are ignored, and an empty table gives no rows.
    """
    chain = train(docs, labels, text=text, kinds=kinds)
    names = [*(f"kind_{k + 1}" for k in range(kinds)), LAST]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = chain.scorer()
        for b in batches:
            found = [score(t) or [0.0] * len(names) for t in b.column("_text").to_pylist()]
            cols = [pa.array([f[i] for f in found], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", *[f"p_{n}" for n in names]])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(
        run, "doc_id bigint, " + ", ".join(f"`p_{n}` double" for n in names)
    )
    return scored.select("doc_id", held_out().alias("held_out"), *[f"p_{n}" for n in names], (F.col(f"p_{LAST}") >= threshold).cast("int").alias("toxic_pred"))
