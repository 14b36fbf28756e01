"""Archives round trip; neighbours against brute force."""

import gzip
import hashlib
import io

import numpy as np

from sigtide.llm import ann, warc
from sigtide.llm.queries import op5_nearest_neighbours
from sigtide.session import work_dir


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, bytes string, refers_to string")


def slow(rows):
    last = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            last[b] = max(i, last.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = b in last and (i is None or i < last[b])
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last[b] if again else None))
    return sorted(out, key=repr)


BIG = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 60_000   # several chunks, with what looks like record edges
ROWS = [(1, "http://a", "x" * 1000), (2, "http://b", "x" * 1000), (9, None, "x" * 1000), (9, "u", "x" * 1000), (None, "u", "x" * 1000), (3, "u", "y" * 999), (4, "u", "y" * 999),
        (5, "bad\r\nurl", None), (6, "u", ""), (7, "u", BIG), (8, "u", BIG), (None, "u", "z" * 2000), (10, "u", "é" * 500)]


def test_round_trip(spark):
    d = pages(spark, [(*r, "a", "b", "c") for r in ROWS]).repartition(3)
    got = warc.archive(d)
    assert sorted((tuple(r)[:5] for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == slow(ROWS)
    assert warc.archive(pages(spark, [])).count() == 0


def test_long_url(spark):
    """A header longer than several reads of the archive."""
    rows = [(1, "http://a/" + "xy z" * 100_000, "<p>one</p>"), (2, "http://b/", "two" * 1000)]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in got.collect()) == [(1, 10, "response"), (2, 3000, "response")]


def test_all_pages(spark, sf):
    d = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in d.collect()]
    rows += [(1_000_000 + i, u, h) for i, u, h in rows[::3]]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted((tuple(r) for r in got.drop("target_uri").collect()), key=repr) == slow(rows)


def test_chunk_table_carries_data_and_digests(spark):
    m = warc.write(pages(spark, [(*r, "a", "b", "c") for r in ROWS]), work_dir(spark, "warc"))
    assert m.groupBy().sum("records").first()[0] == len(ROWS)
    rows = [r for r in warc.read(m).collect() if r.page_id == 8]
    rows.sort(key=lambda r: r.chunk_no)
    assert len(rows) > 2 and max(r.chunk_bytes for r in rows) <= warc.CHUNK
    body = b""
    for k, r in enumerate(rows):
        body += bytes(r.data)
        assert r.chunk_no == k and r.payload_so_far == len(body) and r.digest_so_far == hashlib.sha1(body).hexdigest()
    assert body == BIG.encode()
    file = m.first().file.removeprefix("file:").replace("///", "/")
    text = gzip.open(file).read()   # any gzip reader sees plain records
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")
    assert sum(1 for _, c in warc.records(io.BytesIO(open(file, "rb").read())) if list(c) is not None) == m.first().records


def exact(ids, x, queries, top):
    out = []
    for q in queries:
        s = ann.scores(x[ids == q], x)[0]
        near = sorted((-v, i) for v, i in zip(s.tolist(), ids.tolist(), strict=True) if i != q)[:top]
        out += [(int(q), k + 1, i, -v) for k, (v, i) in enumerate(near)]
    return out


def test_recall_of_the_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = {r[:1] + r[2:3]: r[3] for r in exact(ids, x, ids[ids % 20 == 0], 20)}
    got = op5_nearest_neighbours(spark, sf).collect()
    hits = [r for r in got if (r.query_id, r.vec_id) in want]
    assert len(hits) >= 0.9 * len(want) and all(r.score == want[r.query_id, r.vec_id] for r in hits)
    assert len(got) == len(want)


def test_all_probes_find_all_with_ties_and_small_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)).round(1)
    x[100:250] = x[100]   # one vector, many ids
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0] * 7 + [None]), (904, [float("inf")] + [1.0] * 7), (905, [1.0, 2.0]), (None, [1.0] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as part", "2 as v", "3 as rank")
    for p in (ann.Params(probes=16, vector_block=64, query_block=8), ann.Params(probes=16)):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(d, p=p).collect())
        assert got == exact(np.arange(400), x, range(0, 400, 20), 20)


def by_rows(rows, is_query, top):
    """Every row against every other of its length, from the contract."""
    out = []
    for i, (q, a) in enumerate(rows):
        if is_query(q):
            near = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), v) for j, (v, b) in enumerate(rows) if j != i and len(a) == len(b))[:top]
            out += [(q, k + 1, v, -s) for k, (s, v) in enumerate(near)]
    return sorted(out)


def test_repeated_ids_and_other_lengths_are_candidates(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-9, 9, 6).astype(float).tolist()) for i in range(90)]
    rows += [(20, rows[20][1]), (20, [9.0] * 6), (1, [8.0] * 6), (1, [8.0] * 6), (7, rows[7][1])]   # ids that come two and three times
    rows += [(i, rng.integers(1, 9, 3).astype(float).tolist()) for i in range(100, 130)] + [(140, [1.0, 2.0])]   # two other lengths
    rows += [(140, [float(i), 1.0]) for i in range(1, 3)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for p in (ann.Params(probes=16, vector_block=16, query_block=2), ann.Params(probes=16)):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(d, p=p).collect())
        assert got == by_rows(rows, lambda i: i % 20 == 0, 20)


def test_queries_whose_parts_hold_too_few_see_the_rest(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=5).round(2).tolist()) for i in range(60)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(d, p=ann.Params(probes=2)).collect()   # 2 of 16 parts hold about 8
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, k) for q in (0, 20, 40) for k in range(1, 21)]
    want = {(q, v) for q, _, v, _ in by_rows(rows, lambda i: i % 20 == 0, 20)}
    assert {(r.query_id, r.vec_id) for r in got} == want


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    got = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [0.5, 3.0]), (3, None)], schema)).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got)] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
