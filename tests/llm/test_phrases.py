"""Phrase collocations against brute force."""

import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigtide.llm import phrases
from sigtide.llm.phrases import collocations
from tests.llm.helpers import awkward, empty


def brute(docs, top, least):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    found = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if any(len(q) > len(p) and g == lang and b >= least and 2 * b >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in f.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1))


def run(df, **given):
    return sorted(tuple(r) for r in collocations(df, **given).collect())


WORDS = st.lists(st.sampled_from(["a", "B", "b", "Ä", "c,", ".", "\t", "a\n", "  "]), max_size=60).map(" ".join)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(WORDS, st.sampled_from(["en", "de", None])), min_size=1, max_size=12))
def test_equals_brute_force(spark, docs):
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    assert run(df, top=5, least=2, part_bytes=60) == brute(docs, 5, 2)


def test_parts_and_ties_do_not_matter(spark):
    docs = [("x y z. x y! y z", "en")] * 30 + [("p q; r s", "en")] * 30 + [("x y z", None)] * 12
    df = spark.createDataFrame(docs, "text string, lang string").repartition(5)
    assert run(df, part_bytes=9) == run(df) == brute(docs, 2000, 10)


def test_counts_beyond_64_bits(spark):
    """The score's products pass 64 bits long before its counts do."""
    a, l, r = 3_000_000_000, 4_000_000_001, 5_000_000_003
    got = spark.range(1).select(F.expr(f"cast(1000000 as decimal(38,0)) * {a}L * {a}L div (cast({l}L as decimal(38,0)) * {r}L)")).first()[0]
    assert got == 1_000_000 * a * a // (l * r)


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = run(df.withColumn("lang", F.lit(None).cast("string")), top=5)
    assert {r[0] for r in rows} <= {"und"} and rows[0][2] == "dolor sit amet"
    assert run(empty(spark).withColumn("lang", F.lit("en"))) == []


def test_words_go_out_packed_and_no_shuffle_runs_twice(spark, monkeypatch):
    """Level 1 sends lists by slice, not a row a word; a plan with shuffles is not run only to ask for its partitions."""
    levels, real = [], phrases.bucketed

    def spy(df, key, name, *given):
        levels.append((df, given))
        return real(df, key, name, *given)

    monkeypatch.setattr(phrases, "bucketed", spy)
    docs = [(" ".join(f"w{i}" for i in range(500)), "en")] * 12
    rows = run(spark.createDataFrame(docs, "text string, lang string").coalesce(1))
    assert rows == brute(docs, 2000, 10) and len(rows)
    words = levels[0][0]
    assert words.where("slice is not null").count() <= 128 and words.where("ids is not null").count() == 1
    assert len(levels) == 3 and len({given for _, given in levels}) == 1 and levels[0][1][0] > 0
