"""Approximate nearest neighbours with learned partitions.

On a bounded sample: the neighbour graph, cut into equal parts that few neighbours straddle, and a small classifier that learns the
part of a vector. The classifier then places every vector in its most probable part, and sends a query to several. Queries and vectors
meet in blocks of bounded size; each block gives a query's best few, the blocks' results are merged. Scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigtide.llm.common import stored


@dataclass(frozen=True)
class Params:
    """``sample`` bounds the fit; ``parts`` and ``probes`` trade work for recall; the block sizes bound a task's memory."""

    sample: int = 4096
    neighbours: int = 10
    parts: int = 16
    probes: int = 13
    vector_block: int = 4096
    query_block: int = 512


@dataclass(frozen=True)
class Router:
    weights: np.ndarray  # (dimensions + 1, parts)

    def logits(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return unit @ self.weights[:-1] + self.weights[-1]


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """(n, k): the k nearest of each row by inner product, itself left out."""
    out = np.zeros((len(x), min(k, len(x) - 1)), np.int64)
    for at in range(0, len(x), 512):
        s = x[at:at + 512] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at:at + 512] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, :out.shape[1]]
    return out


def bisect(nodes: np.ndarray, src: np.ndarray, dst: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Half of the nodes (true): split at the median of the smoothest vector on the graph, then swap nodes while that saves edges."""
    n = len(nodes)
    place = np.full(int(max(nodes.max(), src.max(initial=0), dst.max(initial=0))) + 1, -1)
    place[nodes] = np.arange(n)
    inside = (place[src] >= 0) & (place[dst] >= 0)
    a, b = place[src[inside]], place[dst[inside]]
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1e-9

    def spread(v: np.ndarray) -> np.ndarray:
        return np.bincount(a, v[b], n) + np.bincount(b, v[a], n)

    v = rng.normal(size=n)
    for _ in range(60):
        v = v - (v @ degree) / degree.sum()
        v = 0.5 * v + 0.5 * spread(v) / degree
        v /= np.abs(v).max() + 1e-300
    half = np.zeros(n, bool)
    half[np.argsort(v, kind="stable")[: n // 2]] = True
    for _ in range(30):
        same = spread(half.astype(float))
        gain = np.where(half, (degree - same) - same, same - (degree - same))
        left, right = np.flatnonzero(half), np.flatnonzero(~half)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right), max(1, n // 40))
        good = gain[left[:m]] + gain[right[:m]] > 2
        if not good.any():
            break
        half[left[:m][good]], half[right[:m][good]] = False, True
    return half


def partition(x: np.ndarray, p: Params, rng: np.random.Generator) -> np.ndarray:
    """Equal parts of the neighbour graph by repeated halving."""
    nbr = graph(x, p.neighbours)
    src, dst = np.repeat(np.arange(len(x)), nbr.shape[1]), nbr.ravel()
    part, todo = np.zeros(len(x), np.int64), [(np.arange(len(x)), 0, p.parts)]
    while todo:
        nodes, first, many = todo.pop()
        part[nodes] = first
        if many > 1 and len(nodes) > 1:
            half = bisect(nodes, src, dst, rng)
            todo += [(nodes[half], first, many // 2), (nodes[~half], first + many // 2, many - many // 2)]
    return part


def fit(x: np.ndarray, p: Params = Params()) -> Router:
    """``x``: the sample, in any order that is always the same. Softmax regression on the parts by gradient descent with momentum."""
    rng = np.random.default_rng(7)
    if len(x) < 2 * p.parts:
        return Router(np.zeros((x.shape[1] + 1, 1)))
    part = partition(x, p, rng)
    unit = np.c_[x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), np.ones(len(x))]
    want = np.eye(p.parts)[part]
    w = np.zeros((unit.shape[1], p.parts))
    speed = np.zeros_like(w)
    for _ in range(200):
        z = unit @ w
        e = np.exp(z - z.max(axis=1, keepdims=True))
        speed = 0.9 * speed - 4.0 * (unit.T @ (e / e.sum(axis=1, keepdims=True) - want) / len(x) + 1e-4 * w)
        w += speed
    return Router(w)


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in the order of the components: equal vectors score equally wherever they stand."""
    out = np.zeros((len(q), len(v)))
    for d in range(q.shape[1]):
        out += q[:, d, None] * v[None, :, d]
    return out


def best(query_rows: np.ndarray, query_ids: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, top: int) -> pd.DataFrame:
    """The top vectors of a block for each query of a block; ties go to the smaller id, a query's own row is not its neighbour."""
    order = np.argsort(ids, kind="stable")
    rows, ids, v = rows[order], ids[order], v[order]
    out = []
    for at in range(0, len(q), 64):
        s = scores(q[at:at + 64], v)
        s[query_rows[at:at + 64, None] == rows[None, :]] = -np.inf
        k = min(top, s.shape[1])
        edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        for i, e in enumerate(edge):
            near = np.flatnonzero((s[i] >= e) & (s[i] > -np.inf))
            near = near[np.argsort(-s[i, near], kind="stable")[:k]]
            out.append((np.full(len(near), query_rows[at + i]), np.full(len(near), query_ids[at + i]), rows[near], ids[near], s[i, near]))
    c = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
    kinds = (np.int64, np.int64, np.int64, np.int64, float)
    return pd.DataFrame({n: x.astype(t) for n, x, t in zip(("query_row", "query_id", "row", "vec_id", "score"), c, kinds, strict=True)})


def sound(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, vec_id, v): vectors that take part, as doubles: not null or zero, all components finite. ``row`` tells rows of one id apart."""
    x = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    x = x.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
                & F.exists("v", lambda c: c != 0))
    return x.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def nearest(vectors: DataFrame, is_query: str = "vec_id % 20 = 0", top: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", p: Params = Params()) -> DataFrame:
    """Of each query row its ``top`` nearest found by inner product: query_id, rank, vec_id, score.

    ``is_query``: a condition on vec_id. Null, zero and non-finite vectors and null ids take no part. Every other row is a candidate of every
    query but itself: rows that repeat an id are told apart, and each query among them has its own ranks. A query meets vectors of its own
    length alone; those of the commonest length (the smaller of two as common) are routed, of any other length all are compared. A query whose
    parts hold fewer than ``top`` vectors is sent to its remaining parts as well. Other columns are ignored; an empty table has no neighbours.
    Parts and queries of any size are cut into blocks, so a part that holds a third of all vectors is many tasks.
    """
    spark = vectors.sparkSession
    x = stored(sound(vectors, id_col, vec_col), "vectors")
    lengths = sorted((-r["count"], r["n"]) for r in x.groupBy(F.size("v").alias("n")).count().collect())  # one row per length
    n, width = (-lengths[0][0], lengths[0][1]) if lengths else (1, 1)
    some = x.where((F.size("v") == width) & (F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(n)) < 2 * p.sample))  # keeps the ordered sample below small in every task
    got = some.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id", "v").limit(p.sample).select("v").toArrow()
    sample = np.array(got.column(0).to_pylist(), float) if got.num_rows else np.zeros((0, width))
    router = spark.sparkContext.broadcast(fit(sample, p))  # a number per dimension and part

    def place(first: int, last: int | None):  # noqa: ANN202
        """Parts of a vector from the ``first`` to before the ``last`` most probable; one of any other length has the part -length."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sizes = np.diff(np.asarray(b.column(2).offsets))
                parts = [np.array([-k][first:last], np.int32) for k in sizes]
                own = np.flatnonzero(sizes == width)
                if len(own):
                    m = np.asarray(b.column(2).take(pa.array(own)).flatten()).reshape(len(own), width)
                    for i, best_parts in zip(own, np.argsort(-router.value.logits(m), axis=1, kind="stable")[:, first:last], strict=True):
                        parts[i] = best_parts.astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts, pa.list_(pa.int32()))], ["row", "vec_id", "v", "parts"])
        return run

    kinds = "row long, vec_id long, v array<double>, parts array<int>"
    placed = stored(x.mapInArrow(place(0, 1), kinds).select("row", "vec_id", "v", F.col("parts")[0].alias("part")), "placed")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        def block(d: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return d["row"].to_numpy(), d["vec_id"].to_numpy(), np.stack(d["v"].to_numpy()) if len(d) else np.zeros((0, 1))

        if a.empty or b.empty:
            a, b = a[:0], b[:0]
        return best(*block(a), *block(b), top)

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("part").agg(F.ceil(F.count("*") / size).alias(name))  # a row per part

    def search(asked: DataFrame) -> DataFrame:
        """Best of each block for the queries ``asked`` (row, vec_id, v, part)."""
        many = F.broadcast(blocks(placed, p.vector_block, "nv").join(blocks(asked, p.query_block, "nq"), "part"))
        v = placed.join(many, "part").withColumn("vb", F.pmod(F.xxhash64("row"), F.col("nv")))
        v = v.select("part", "vb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("qb"), "row", "vec_id", "v")
        q = asked.join(many, "part").withColumn("qb", F.pmod(F.xxhash64("row", F.lit(3)), F.col("nq")))
        q = q.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nv") - 1)).alias("vb"), "qb", "row", "vec_id", "v")
        keys = ["part", "vb", "qb"]
        found = "query_row long, query_id long, row long, vec_id long, score double"
        return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(meet, found)

    def ask(queries: DataFrame, first: int, last: int | None) -> DataFrame:
        return stored(queries.mapInArrow(place(first, last), kinds).select("row", "vec_id", "v", F.explode("parts").alias("part")), "asked")

    by = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)

    queries = x.where(is_query)
    found = stored(ranked(search(ask(queries, 0, p.probes))), "found")
    full = found.groupBy("query_row").count().where(F.col("count") >= top).select(F.col("query_row").alias("row"))
    rest = ask(queries.join(full, "row", "left_anti"), p.probes, None)
    if not rest.isEmpty():
        found = ranked(found.drop("rank").unionByName(search(rest)))
    return found.select("query_id", "rank", "vec_id", "score")
