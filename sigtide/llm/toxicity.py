"""Toxicity: a linear classifier on character n-grams that are scaled by their naive Bayes log-count ratio.

Training takes a bounded sample of labelled rows (``PER_CLASS`` of each class). The share of a class's documents that hold an n-gram
gives its log-count ratio; logistic regression is fitted on the ratios of the n-grams a text holds. Ratio and weight of a slot
multiply into one number, so the model that goes to the tasks is one bounded array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtide.llm import hashed_text as ht
from sigtide.llm.common import fold, sample_ids, whole_text

PER_CLASS, BITS, SIZES = 2000, 20, range(3, 6)
#: A ratio counts from so many standard errors on, which leaves out what long texts gather by chance; smoothing, rounds, step and decay of the fit.
MIN_ERRORS, SMOOTH, ROUNDS, RATE, DECAY = 4.0, 0.5, 12, 0.1, 1e-4


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def slots(text: str, seen: np.ndarray) -> np.ndarray:
    """The distinct slots of a whole text's n-grams. ``seen``: a scratch array of falses, left as it was."""
    for part in ht.blocks(text.lower(), SIZES.stop - 2):
        c = ht.codes(part)
        for _, s in ht.ngrams(np.where(ht.blanks(c), np.uint64(32), c), SIZES, BITS):
            seen[s] = True
    out = np.flatnonzero(seen)
    seen[out] = False
    return out


def total(text: str, m: Model) -> float:
    """The weights of a whole text's n-grams, each once."""
    found = [np.zeros(0, np.int64)]
    for part in ht.blocks(text.lower(), SIZES.stop - 2):
        c = ht.codes(part)
        found += [s[m.weights[s] != 0] for _, s in ht.ngrams(np.where(ht.blanks(c), np.uint64(32), c), SIZES, BITS)]
    return float(m.weights[np.unique(np.concatenate(found))].sum(dtype=np.float64)) + m.bias


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Log-count ratios, then logistic regression by stochastic gradient descent; classes weigh the same."""
    size = 1 << BITS
    pos, neg = (np.bincount(np.concatenate([*(r for r, y in zip(rows, labels, strict=True) if y == k), np.zeros(0, np.int64)]), minlength=size) for k in (1, 0))
    n = [max(1, int((labels == k).sum())) for k in (1, 0)]
    ratio = np.log((pos + SMOOTH) / (n[0] + 2 * SMOOTH)) - np.log((neg + SMOOTH) / (n[1] + 2 * SMOOTH))
    ratio[np.abs(ratio) < MIN_ERRORS * np.sqrt(1 / (pos + SMOOTH) + 1 / (neg + SMOOTH))] = 0
    rows = [r[ratio[r] != 0] for r in rows]
    w, bias, rng = np.full(size, 0.1), 0.0, np.random.default_rng(3)
    weight = [len(rows) / 2 / n[1], len(rows) / 2 / n[0]]
    for k in range(ROUNDS):
        rate = RATE * (1 - k / ROUNDS)
        for i in rng.permutation(len(rows)):
            r, y = rows[i], int(labels[i])
            x = ratio[r]
            p = 1 / (1 + np.exp(-np.clip(w[r] @ x + bias, -30, 30)))
            g = weight[y] * (p - y)
            # A step of the length of the features, as in normalised gradient descent, keeps long texts from throwing the weights about.
            w[r] -= rate * (g * x / (1 + np.sqrt(x @ x)) + DECAY * w[r])
            bias -= rate * g
    return Model((w * ratio).astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class, whole texts. Without both classes: no weights, the bias at the only class's side."""
    picked = F.broadcast(sample_ids(labels, label, per_class))  # 2 * per_class ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([slots(t, seen).astype(np.int32) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))],
                                             ["label", "slots"])

    got = docs.join(picked, "doc_id").select("label", "text", F.xxhash64("doc_id", "text").alias("o"))
    got = got.dropDuplicates(["o"]).orderBy("o").select("label", "text").mapInArrow(run, "label int, slots array<int>").toArrow()
    y = np.asarray(got.column(0).to_numpy(), np.int64)
    x = [np.asarray(r.values, np.int64) for r in got.column(1)] if len(y) else []
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0 if not len(y) else 2.0 * float(y[0]) - 1.0)
    return fit(x, y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text; ``docs`` as ``whole_text`` gives them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^20 numbers, however large the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            z = np.array([total(t.as_py(), m) for t in b.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text",
             per_class: int = PER_CLASS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Labels of held-out rows are never read, nor is anything but the text a feature.

    Null and empty texts have no n-gram and get the bias; a null id cannot be labelled and is not held out. Repeated rows are scored as often as
    they come; of repeated labels the larger counts. Other columns are ignored.
    """
    d = whole_text(docs, id_col, text_col)
    model = train(d.where(fold() != 1), labels.where(fold() != 1), label, per_class)
    return score(d, model).select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
