"""SimHash classes against brute force over all pairs, and the Golay code against its definition."""

import re

import numpy as np
import xxhash

from sigtide.llm import golay
from sigtide.llm.simhash import classes, fingerprint, keep_one, near_duplicates


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def slow_classes(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        if x is not None:
            low[find(i)] = min(x, low.get(find(i), x))
    return [low.get(find(i)) for i in range(len(ids))]


def test_golay_is_perfect_and_keys_are_shared():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 23, 4000)
    k = golay.keys(x)
    assert set((k >= 0).sum(1).tolist()) == {1, 6}
    for a in range(0, 23, 3):
        for b in range(0, 23, 2):
            y = golay.keys(x ^ (1 << a) ^ ((1 << b) if b != a else 0))
            assert ((k[:, :, None] == y[:, None, :]) & (k[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_fingerprint_of_texts(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for t in [*texts, "", " \t", "one", "A b  C\nd\x0be", "Ünï ÉÀ x y z"]:
        assert fingerprint(t) == slow_fingerprint(t)


def test_all_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    want = {(r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, slow_classes([r.doc_id for r in rows], fps), strict=True)}
    got = near_duplicates(docs)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(rows)
    assert {r.doc_id for r in keep_one(docs).collect()} == {w[2] for w in want}


def test_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = list(map(int, base))
    for k, b in enumerate(base):
        for d in (1, 2, 3, 4, 5, 6):
            fps.append(int(b) ^ sum(1 << int(i) for i in rng.choice(64, d, replace=False)))
        if k == 0:   # one large group, at most 4 bits from its centre
            fps += [int(b) ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)][:600]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "key long, fp long")
    want = slow_classes(list(range(len(fps))), fps)
    import sigtide.llm.simhash as s
    for block in (4096, 16):
        links = s.near_links(df.select("fp"), 4, block)
        root = {r.node: r.root for r in s.components(links).collect()}
        mine = {}
        for i, f in enumerate(fps):
            x = int(np.uint64(f).astype(np.int64))
            mine.setdefault(root.get(x, x), set()).add(i)
        theirs = {}
        for i, c in enumerate(want):
            theirs.setdefault(c, set()).add(i)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_edge_cases(spark):
    schema = "doc_id long, text string, fp long, root string, `key` string"
    none = spark.createDataFrame([], schema)
    assert near_duplicates(none).count() == 0 and keep_one(none).count() == 0
    rows = [(None, None, 1, "a", "b"), (7, "", 1, "a", "b"), (7, "", 1, "a", "b"), (3, "x y z", 1, "a", "b"), (None, "x y z", 1, "a", "b"),
            (None, "alone here", 1, "a", "b"), (9, "long " * 100_000, None, None, None)]
    d = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(d).collect()), key=repr)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (3, 3), (None, 3), (None, None), (9, 9)], key=repr)
    kept = keep_one(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([7, 3, None, 9], key=repr)
    assert classes(spark.createDataFrame([], "key long, fp long")).count() == 0
