"""Spelling variants against brute force over all pairs."""

import re
import zlib
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sigtide.llm.spelling import spelling_variants, variants
from tests.llm.helpers import awkward, empty


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def judged(words):
    form, count = {}, {}
    for w in words:
        ns = [x for x in words if near(w, x)]
        count[w] = len(ns)
        best = min(ns, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, count[w], words.get(form.get(w))) for w, n in words.items())


def rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.text("abà", min_size=1, max_size=6), st.integers(3, 60), min_size=1, max_size=60))
def test_variants_equal_all_pairs(spark, words):
    assert rows(variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == judged(words)


def test_long_chain_of_forms(spark):
    words = {"a" * k: 3 << k for k in range(5, 25)}
    got = rows(variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == judged(words) and {r[2] for r in got} == {"a" * 24}


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    count = Counter()
    for i, text in docs.select("doc_id", "text").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    got = rows(spelling_variants(docs))
    assert [(r[0], r[3]) for r in got] == sorted(words.items())
    some = {w: n for w, n in words.items() if w < "c"}  # all pairs of the words that start with a and b, and their neighbours' counts
    assert [r for r in got if r[0] in some and r[1] in (None, *some)] == [r for r in judged_within(words, some) if r[1] in (None, *some)]


def judged_within(words, some):
    form, count, seen = {}, {}, {}
    for w in words:
        for i in range(len(w)):
            seen.setdefault(w[:i] + "*" + w[i + 1:], set()).add(w)
            seen.setdefault(w[:i] + w[i + 1:], set()).add(w)
    for w in words:
        ns = {x for i in range(len(w)) for k in (w[:i] + "*" + w[i + 1:], w[:i] + w[i + 1:]) for x in seen.get(k, ())} | seen.get(w, set())
        ns = [x for x in ns if near(w, x)] + [d for d in {w[:i] + w[i + 1:] for i in range(len(w))} if d in words and d not in ns]
        ns = set(ns)
        count[w] = len(ns)
        best = min(ns, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), words[w], count[w], words.get(form.get(w))) for w in some)


def test_awkward_rows(spark):
    got = rows(spelling_variants(awkward(spark)))
    assert {r[0] for r in got} >= {"lorem", "dolor", "consectetur"} and all(r[3] >= 3 for r in got)
    assert rows(spelling_variants(empty(spark))) == []
