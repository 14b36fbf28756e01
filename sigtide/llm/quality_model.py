"""Quality classifier: supervised subword embeddings.

Hashed vectors of words, of character n-grams inside words, and of two marks (this run of words is new, or came before) are
learned with a softmax output by stochastic gradient descent on numpy, on a bounded sample of labelled rows (``PER_CLASS`` of each
class). A document is the mean of its vectors. As the output is linear in that mean, each vector's two logits fold into one
number per slot before scoring: the same result from one bounded array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtide.llm import hashed_text as ht
from sigtide.llm.common import fold, fresh, sample_ids, whole_text

PER_CLASS, BITS, SIZES, DIM = 1500, 18, range(3, 5), 8
ROUNDS, RATE = 10, 2.0
#: Slots of the marks; how often a mark counts beside a word, as it stands for all of the word's n-grams.
NEW, SEEN, MARK_WEIGHT = 0, 1, 4


@dataclass(frozen=True)
class Model:
    logits: np.ndarray  # per slot: positive minus negative
    bias: float


def features(text: str) -> Iterator[np.ndarray]:
    """Slots of a whole text's features, in arrays. Blocks bound the arrays of characters only: words and word runs are those of the whole text."""
    words, found = ht.Words(), []
    overlap = SIZES.stop - 2
    for at, part in enumerate(ht.blocks(text, overlap)):
        c = ht.codes(part)
        last = at * ht.BLOCK + len(part) == len(text)
        own = c if last else c[:ht.BLOCK]
        w = words.add(own)
        if last:
            w = np.concatenate([w, words.end()])
        found.append(w)
        yield (w >> np.uint64(64 - BITS)).astype(np.int64)
        yield from ht.subwords(c, SIZES, BITS, len(own))
    seen = ht.seen_before(np.concatenate(found))
    yield np.repeat(np.where(seen, SEEN, NEW), MARK_WEIGHT)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """``rows``: distinct slots of a document and their shares, which add up to 1."""
    rng = np.random.default_rng(9)
    vec = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    n = [max(1, int((labels == k).sum())) for k in (0, 1)]
    for k in range(ROUNDS):
        for at, i in enumerate(rng.permutation(len(rows))):
            rate = np.float32(RATE * (1 - (k + at / len(rows)) / ROUNDS))
            slot, share = rows[i]
            y = int(labels[i])
            hidden = share @ vec[slot]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            g = p.copy()
            g[y] -= 1
            g *= np.float32(len(rows) / 2 / n[y])
            back = out @ g
            out -= rate * np.outer(hidden, g)
            bias -= np.float32(0.1) * rate * g
            vec[slot] -= rate * share[:, None] * back
    return Model((vec @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class, whole texts. Without both classes: the bias at the only class's side."""
    picked = F.broadcast(sample_ids(labels, label, per_class))  # 2 * per_class ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.unique(np.concatenate([*features(t), np.zeros(0, np.int64)]), return_counts=True) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k].astype(np.int32) for r in rows], pa.list_(pa.int32())) for k in (0, 1))],
                                             ["label", "slots", "counts"])

    got = docs.join(picked, "doc_id").select("label", "text", F.xxhash64("doc_id", "text").alias("o"))
    got = got.dropDuplicates(["o"]).orderBy("o").select("label", "text").mapInArrow(run, "label int, slots array<int>, counts array<int>").toArrow()
    y = np.asarray(got.column(0).to_numpy(), np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0 if not len(y) else 4.0 * float(y[0]) - 2.0)
    x = [(np.asarray(s.values), np.asarray(c.values, np.float32)) for s, c in zip(got.column(1), got.column(2), strict=True)]
    return fit([(s, c / max(1, c.sum(dtype=np.float64)).astype(np.float32) if len(c) else c) for s, c in x], y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text; ``docs`` as ``whole_text`` gives them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 numbers, however large the corpus

    def one(text: str, m: Model) -> float:
        n, total = 0, 0.0
        for s in features(text):
            n += len(s)
            total += float(m.logits[s].sum(dtype=np.float64))
        return total / max(1, n) + m.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            z = np.array([one(t.as_py(), m) for t in b.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
            per_class: int = PER_CLASS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Labels of held-out rows are never read, nor is anything but the text a feature.

    Null and empty texts have no feature and get the bias; a null id cannot be labelled and is not held out. Repeated rows are scored as often as
    they come; of repeated labels the larger counts. Other columns are ignored.
    """
    d = whole_text(docs, id_col, text_col)
    model = train(d.where(fold() != 1), labels.where(fold() != 1), label, per_class)
    return score(d, model).select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
              per_class: int = PER_CLASS) -> DataFrame:
    """The rows that score the threshold or more, with all columns and whole texts. The model is fitted on ``labelled``, which may be a larger table."""
    t = whole_text(labelled, id_col, text_col)
    model = train(t.where(fold() != 1), labels.where(fold() != 1), "quality", per_class)
    row, text = fresh(docs, "row", "text")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text))
    return score(d.select(F.col(row).alias("doc_id"), F.col(text).alias("text")), model).where(F.col("score") >= threshold).select("doc_id.*")
