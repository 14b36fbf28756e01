"""Held-out accuracy of the classifiers, exact scoring, and that held-out labels are never read."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigtide.llm import hashed_text as ht
from sigtide.llm import quality_model, toxicity

from .helpers import ROWS, awkward, empty

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("run,label,least", [(toxicity.toxicity, "toxic", 0.93), (quality_model.quality, "quality", 0.97)])
def test_held_out_accuracy(tables, run, label, least):
    docs, labels = tables
    got = run(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean(held) >= least


@pytest.mark.parametrize("run,label", [(toxicity.toxicity, "toxic"), (quality_model.quality, "quality")])
def test_held_out_labels_and_other_columns_change_nothing(tables, run, label):
    docs, labels = tables
    docs = docs.limit(300)
    turned = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col(label)).otherwise(F.col(label)))
    one = {r.doc_id: r.score for r in run(docs, labels).collect()}
    two = {r.doc_id: r.score for r in run(docs.withColumns({"lang": F.lit("x"), "source": F.lit(None)}), turned).collect()}
    assert one == two


@pytest.mark.parametrize("run", [toxicity.toxicity, quality_model.quality])
def test_awkward_rows(spark, tables, run):
    docs, labels = tables
    d = awkward(spark)
    some = spark.createDataFrame([(1, 1, 1, "x"), (1, 0, 0, "x"), (2, None, None, "x"), (None, 1, 1, "x"), (6, 0, 0, "x"), (7, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    got = run(d, some).collect()
    assert len(got) == len(ROWS) and all(np.isfinite(r.score) for r in got)
    none = [r.score for r in got if r.doc_id == 2]
    assert len(set(none)) == 1
    assert run(empty(spark), some).count() == 0
    assert run(d, some.limit(0)).count() == len(ROWS)


def test_scores_of_whole_texts_do_not_depend_on_blocks(monkeypatch):
    text = " ".join(f"word{i} moron" for i in range(3000))
    weights = np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32)
    m = toxicity.Model(weights, 0.5)
    seen = np.zeros(1 << toxicity.BITS, bool)
    whole = toxicity.total(text, m), toxicity.slots(text, seen).tolist()
    monkeypatch.setattr(ht, "BLOCK", 777)
    assert np.allclose(whole[0], toxicity.total(text, m)) and whole[1] == toxicity.slots(text, seen).tolist() and not seen.any()


def test_quality_features_of_whole_texts_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    passage = " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(2000))
    texts = [" \n ".join([passage] * 3), "x" * 5000 + "  \t" + "y" * 3000 + " x", passage[:777] + " " * 1600 + passage, "", " ", "a b c", "x" * 776 + " y z", "x" * 777 + " y z", "x" * 1554]
    counts = lambda t: np.bincount(np.concatenate(list(quality_model.features(t))), minlength=1 << quality_model.BITS).tolist()
    whole = [counts(t) for t in texts]
    monkeypatch.setattr(ht, "BLOCK", 777)
    assert [counts(t) for t in texts] == whole
    monkeypatch.setattr(ht, "BLOCK", 1)
    assert [counts(t) for t in texts[3:]] == whole[3:]


def test_repeats_far_back_in_a_long_text_count_as_seen():
    passage = " ".join(f"w{i}" for i in range(ht.BLOCK // 5))
    assert len(passage) > ht.BLOCK
    marks = list(quality_model.features(" ".join([passage] * 3)))[-1]
    assert abs(float((marks == quality_model.SEEN).mean()) - 2 / 3) < 1e-3


def test_words_and_ngrams_against_loops():
    text = "  Ab cd\n\nab cd ab cd ab xé😀 "
    c = ht.codes(text)
    w = ht.words(c).tolist()
    parts = text.split()
    assert len(w) == len(parts) and all((w[i] == w[j]) == (parts[i] == parts[j]) for i in range(len(w)) for j in range(len(w)))
    runs = [tuple(parts[i:i + 3]) for i in range(len(parts) - 2)]
    assert ht.seen_before(ht.words(c)).tolist() == [r in runs[:i] for i, r in enumerate(runs)]
    flat = "".join(" " if x in " \n" else x for x in text)
    grams = [flat[i:i + 3] for i in range(len(flat) - 2)]
    slots = dict(ht.ngrams(ht.codes(flat), range(3, 4), 20))[3].tolist()
    assert all((slots[i] == slots[j]) == (grams[i] == grams[j]) for i in range(len(grams)) for j in range(len(grams)))
    inner = [g for g in grams if g[1] != " "]
    assert len(np.concatenate(list(ht.subwords(c, range(3, 4), 18)))) == len(inner)
    assert len(ht.words(ht.codes(" \n"))) == 0 and len(ht.words(ht.codes(""))) == 0
