"""Line-first quality rules against a plain count of every measure."""

import re
from collections import Counter

from sigtide.llm.quality_rules import clean_lines, keep_good, quality_rules

from .helpers import awkward, empty


def slow(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_measures_of_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality_rules(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = slow(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def test_verdict_follows_labels(spark, sf):
    good = quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in good if r.quality == 1)
    assert sum(r.kept for r in good if r.quality == 0) <= 0.1 * sum(r.quality == 0 for r in good)


def test_rules_one_by_one(spark):
    good = "This is a plain sentence of ordinary words that goes on for a while."
    bad = {"markup": "re*** nt### of%%% are&&& an$$$ on### it*** we%%% go&&& to$$$", "shouting": "BUY!! NOW!! ALL!! OF!! IT!! HERE!! TODAY!! OR!! NEVER!! EVER!!",
           "capitals": "ALL OF THIS LINE IS SHOUTED AT THE READER WITHOUT END.", "menu": "Home | News | Sport | About | Contact | Terms of the site",
           "stock": "Licensed under CC BY-NC 4.0, all rights reserved by us.", "stub": "Next page"}
    rows = [(k, "\n".join([good] + [x] * 4 + [good.upper().lower()])) for k, x in bad.items()] + [("fine", f"{good}\nAnother line follows, with words of its own and no fault at all.")]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for k in bad:
        want = 1 - 4 * len(bad[k]) / len(rows[[r[0] for r in rows].index(k)][1].replace("\n", ""))
        assert abs(got[k].kept_share - want) < 1e-9, k
    assert got["fine"].kept_share == 1.0 and got["fine"].kept


def test_failing_lines_go_and_the_rest_stays(spark):
    good = ["This is a plain sentence of ordinary words that goes on for a while.", "", "Dies ist ein weiterer Satz mit eigenen Wörtern, der bleibt.",
            "  \t", "Une autre phrase suit, avec des mots qui sont bien à elle.", "Y otra frase más cierra el texto, sin falta alguna."]
    bad = ["re*** nt### of%%% are&&& an$$$ on### it***", "BUY!! NOW!! ALL!! OF!! IT!!", "ALLES HIER WIRD OHNE ENDE GESCHRIEN", "Home | News | Sport | About | Contact",
           "All rights reserved by us.", "Next page"]
    last = "One more sentence of some length stands at the very end, so that the greater part of this text passes."
    mixed = [x for pair in zip(good, bad, strict=True) for x in pair]
    rows = [(k, "\n".join([b, *good, b]), "x") for k, b in enumerate(bad)] + [(6, "\n".join(good), "x"), (7, "\n".join([*mixed, last]), "y")]
    rows += [(8, "\n".join(good[:1] + bad * 5), "z"), (9, None, "z"), (10, "", "z"), (6, "\n".join(good), "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, kept_share string")
    got = clean_lines(d)
    assert got.columns == d.columns
    want = [(k, "\n".join(good), "x") for k in range(6)] + [(6, "\n".join(good), "x")] * 2 + [(7, "\n".join([*good, last]), "y")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    again = quality_rules(got).collect()
    assert all(r.kept_share == 1.0 and r.kept for r in again)
    assert clean_lines(empty(spark)).count() == 0 and clean_lines(awkward(spark)).count() == keep_good(awkward(spark)).count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_awkward_rows(spark):
    d = awkward(spark)
    got = quality_rules(d)
    assert got.count() == d.count() and got.where("doc_id = 1 or doc_id = 2").where("n_words > 0 or kept").count() == 0
    kept = keep_good(d)
    assert kept.columns == d.columns
    assert quality_rules(empty(spark)).count() == 0 and keep_good(empty(spark)).count() == 0
    many = "\n".join(f"Line {i} holds word{i} and also row{i} but no cell{i} here{i}." for i in range(20_000))
    long = spark.createDataFrame([(1, many)], "doc_id long, text string")
    assert quality_rules(long).first().kept and keep_good(long).first().text == many


def test_plan_has_no_python_and_no_shuffle(spark, sf):
    plan = quality_rules(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
