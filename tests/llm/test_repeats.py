"""Removal of repeated word runs against brute force."""

import random

from sigtide.llm.repeats import remove_repeats
from tests.llm.helpers import LONG, awkward, empty


def brute(docs, size=20):
    """Rows (id, n_words, kept) for docs in their order."""
    seen, out = set(), []
    for i, text in docs:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            run = tuple(w[k:k + size])
            if run in seen:
                gone[k:k + size] = [True] * size
            seen.add(run)
        out.append((i, len(w), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def run(df, **given):
    return sorted(((r.doc_id, r.n_words, r.kept) for r in remove_repeats(df, **given).collect()), key=repr)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40))
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 29, 35, 60)]
    out = []
    for _ in range(60):
        w = []
        for _ in range(rng.randrange(6)):
            w += [word() for _ in range(rng.randrange(15))]
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            w += p[a:] if rng.random() < 0.5 else p
        out.append(rng.choice([" ", "\n", " \t"]).join(w))
    return out + [out[3], out[3], "t " * 55, "", "u v " * 12]


def test_equals_brute_force(spark):
    for seed in range(2):
        docs = list(enumerate(texts(seed)))
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        want = sorted(brute(docs), key=repr)
        assert run(df, part_bytes=2000) == want
        assert run(df) == want


def test_ranges(spark):
    p = " ".join(f"w{i}" for i in range(25))
    rows = {r.doc_id: r for r in remove_repeats(spark.createDataFrame([(1, p), (2, f"x y {p} z"), (3, f"{p} {p}")], "doc_id long, text string")).collect()}
    assert [tuple(x) for x in rows[1].removed] == [] and [tuple(x) for x in rows[2].removed] == [(2, 27)] and [tuple(x) for x in rows[3].removed] == [(0, 50)]
    assert rows[2].kept == "x y z" and rows[3].kept == ""


def test_hot_passage_and_equal_ids(spark):
    p = " ".join(f"w{i}" for i in range(40))
    docs = [(i, p) for i in range(300)] + [(0, p)] * 2 + [(None, p)]
    got = run(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), part_bytes=500)
    assert sorted(got, key=lambda r: r[2] == "")[0] == (0, 40, p) and sum(r[2] == "" for r in got) == len(docs) - 1


def test_awkward_rows(spark):
    got = run(awkward(spark))
    n = len(LONG.split())
    assert len(got) == 10 and [r for r in got if r[0] == 5][0][1] == n and [r for r in got if r[0] == 4] == [(4, 0, "")]
    assert (6, 3, "tie tie tie") in got and (7, 3, "tie tie tie") in got
    assert [r[2] for r in got if r[0] == 5] == [brute([(5, LONG)])[0][2]]
    assert run(empty(spark)) == []
