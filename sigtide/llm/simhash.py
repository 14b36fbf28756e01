"""SimHash near-duplicates by fuzzy hashing with the Golay code.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Fingerprints that differ in 4 bits at most differ, in the two
segments that agree best, in 2 bits each at most; so in one of the three pairs of segments both segments share a Golay
key. Every distinct fingerprint goes out under its keys for each pair (24 bits each), meets the others there, and true
distances decide. What leaves a bucket is a spanning forest of its links, not its pairs; components of the links are the classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigtide.llm import golay
from sigtide.llm.common import components, fresh, row_key, stored, whole_text

SEED, SHINGLE, MAX_BITS = 42, 4, 4
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Fingerprints of one bucket that a task compares at once; a larger bucket is dealt out as pairs of blocks.
BLOCK = 4096


def fingerprint(text: str) -> int:
    """The SimHash of one text: bit i is set if it is set in over half of the shingles' hashes. No words: zero."""
    from xxhash import xxh64_intdigest

    words = WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-SHINGLE]]).tolist()
    stops = (ends[SHINGLE - 1:] - 1).tolist()
    counts, n = np.zeros(64, np.int64), len(stops)
    for at in range(0, n, 65_536):
        h = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at:at + 65_536], stops[at:at + 65_536], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["key", "fp"])


def fingerprints(keyed: DataFrame) -> DataFrame:
    """(key, text) to (key, fp), the fingerprint as a signed 64-bit number."""
    kind = keyed.schema["key"].dataType.simpleString()
    return keyed.select("key", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_fingerprints, f"key {kind}, fp long")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            fp = np.asarray(whole.column(0))[at:at + 4096]
            u = fp.view(np.uint64)
            mask = np.uint64((1 << golay.LENGTH) - 1)
            parts = [golay.keys((u >> np.uint64(s)) & mask) for s in (0, 23, 46)]
            for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
                joint = (parts[a][:, :, None].astype(np.int64) << 12 | parts[b][:, None, :]) | pair << 24
                rows, i, j = np.nonzero((parts[a][:, :, None] >= 0) & (parts[b][:, None, :] >= 0))
                yield pa.RecordBatch.from_arrays([pa.array(joint[rows, i, j]), pa.array(fp[rows])], ["bucket", "fp"])


def _forest(left: np.ndarray, right: np.ndarray | None, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the near pairs of one block, or of two, connect: breadth first from every fingerprint.

    A fingerprint leaves the unvisited rest at its first link, so at most one link per member comes out.
    """
    nodes = left if right is None else np.concatenate([left, right])
    side = np.zeros(len(nodes), bool) if right is None else np.arange(len(nodes)) >= len(left)
    rest = np.arange(len(nodes))
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            step, front = front[:64], front[64:]
            near = np.bitwise_count(nodes[step][:, None] ^ nodes[rest][None, :]) <= bits
            if right is not None:
                near &= side[step][:, None] != side[rest][None, :]
            hit = near.any(axis=0)
            if hit.any():
                yield nodes[step[near[:, hit].argmax(axis=0)]], nodes[rest[hit]]
                front, rest = np.concatenate([front, rest[hit]]), rest[~hit]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole runs of equal bucket from batches sorted by bucket: (buckets, fingerprints, sides)."""
    tail: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        if not b.num_rows:
            continue
        got = tuple(np.asarray(b.column(i)) for i in range(3))
        if tail:
            got = tuple(np.concatenate(x) for x in zip(*tail, got, strict=True))
        cut = int(np.searchsorted(got[0], got[0][-1]))
        tail = [tuple(x[cut:] for x in got)]
        if cut:
            yield tuple(x[:cut] for x in got)
    yield from tail


def _links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for bucket, fp, side in _runs(batches):
        u = fp.view(np.uint64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        sizes = np.diff(starts)
        a, b = [], []
        # Buckets of a few members, nearly all of them, are compared together: member k with member k + gap.
        for gap in range(1, 8):
            i = np.flatnonzero((np.repeat(sizes, sizes)[:-gap] <= 8) & (bucket[:-gap] == bucket[gap:]) & ~side[:-gap] & ~side[gap:])
            i = i[np.bitwise_count(u[i] ^ u[i + gap]) <= bits]
            a.append(u[i])
            b.append(u[i + gap])
        two = np.add.reduceat(side, starts[:-1]) > 0
        for r in np.flatnonzero((sizes > 8) | two):
            x, s = u[starts[r]:starts[r + 1]], side[starts[r]:starts[r + 1]]
            for p, q in _forest(x[~s], x[s] if two[r] else None, bits):
                a.append(p)
                b.append(q)
        a, b = np.concatenate(a), np.concatenate(b)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy().view(np.int64)), pa.array(pair[:, 1].copy().view(np.int64))], ["src", "dst"])


def near_links(distinct_fp: DataFrame, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (src, dst) that span every component of the distinct fingerprints under distance ``bits`` (at most 4)."""
    if bits > MAX_BITS:
        raise ValueError("two of three segments within 2 bits need a distance of 4 at most")
    keyed = distinct_fp.select("fp").mapInArrow(_buckets, "bucket long, fp long")
    keyed = keyed.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1")
    small = keyed.where(F.col("n") <= block).select("bucket", "fp", F.lit(False).alias("side"))
    # A large bucket becomes blocks: each alone, and each two of them side by side.
    hot = keyed.where(F.col("n") > block).withColumn("k", F.ceil(2 * F.col("n") / block).cast("int"))
    hot = hot.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    hot = hot.select("bucket", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    hot = hot.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp",
                     (F.col("own") > F.col("other")).alias("side"))
    link = lambda b: _links(b, bits)
    schema = "src long, dst long"
    return (small.sortWithinPartitions("bucket").mapInArrow(link, schema)
            .union(hot.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(link, schema)))


def classes(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(key, fp) to (fp, root): the class of each distinct fingerprint that has a link; others are classes of their own."""
    links = stored(near_links(fps.select("fp").distinct(), bits), "links")
    return components(links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable, its own included).

    Equal fingerprints are one class from the start, so copies are never paired. Null and empty texts have fingerprint zero and
    link like others. A row with a null id takes part; its class has the smallest id that is not null, or null if there is none.
    Repeated rows come out as often as they came in; other columns are ignored. An empty table gives an empty result.
    """
    d = whole_text(docs, id_col, text_col)
    fps = stored(fingerprints(d.select(F.col("doc_id").alias("key"), "text")), "fingerprints")
    low = fps.groupBy("fp").agg(F.min("key").alias("low"))
    named = low.join(classes(fps, bits).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named, "classes")
    first = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = named.join(first, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """One row of each class of near-duplicates, the one with the smallest id; all columns stay.

    Null ids lose against others; rows that repeat one id are told apart by their texts, and of equal rows one stays.
    """
    key, nth = fresh(docs, "key", "nth")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    tagged = docs.withColumn(key, row_key(F.col(f"`{id_col}`"), text))
    narrow = tagged.select(F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(key).alias("key")).alias("key"),
                           text.alias("text"))
    fps = stored(fingerprints(narrow), "fingerprints")
    best = fps.groupBy("fp").agg(F.min("key").alias("key"))
    best = best.join(classes(fps, bits).withColumnRenamed("node", "fp"), "fp", "left")
    best = best.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("key").alias("key"))
    won = tagged.join(best.select(F.col("key.key").alias(key)), key, "left_semi")
    return won.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))).where(F.col(nth) == 1).drop(key, nth)
