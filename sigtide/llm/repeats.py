"""Exact repeats of long word runs: fixed-block anchors, probes by every rolling window, extension of the hits.

A window of 20 words holds at least one whole block of 10 that starts at a multiple of 10. So every text's non-overlapping
blocks are the index, every rolling window of 10 words is a probe, and a repeat holds a probe that hits a block elsewhere. Hits
are extended to the 20-word windows around them, which are judged by 96 bits over all documents: all but the first occurrence go, and
runs of such windows are the maximal repeats.

Documents lie in parts (bounded runs of documents of one task), bucketed by part, so they are never shuffled. A part sends
its distinct probes as sorted numbers within a slice of the hash range, gets its hits back, sends one row per distinct candidate
window, and gets the verdicts back. A passage with any number of copies is one row per part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigtide.llm.common import bucketed, whole_text

WINDOW, BLOCK = 20, 10
#: Bytes of text of a part: what one task holds in memory at a time, with some ten times that for its hashes.
PART_BYTES = 12_000_000
#: Bits of a probe's hash within its slice.
LOW = 30
_BASE, _MIX = 0x100000001B3, np.uint64(0x9E3779B97F4A7C15)
_RANGES = "array<struct<start:int,stop:int>>"


def _numbered(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to parts: documents as the numbers of their words (doc_id, at), and one row of the part's distinct words."""
    task, number = TaskContext.get().partitionId() << 24, 0
    names = ["part", "doc_id", "at", "words"]

    def part(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks()
        split = pc.ascii_split_whitespace(t.column(1).combine_chunks())
        got = split.flatten().dictionary_encode()
        at, none = got.indices.to_numpy(), pc.index(got.dictionary, "").as_py()
        real = at != none  # white space at a text's ends leaves empty strings
        upto = np.concatenate([[0], np.cumsum(real)])
        ends = upto[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))])]
        docs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[real], pa.int32()))
        me, words = pa.array(np.full(t.num_rows, task + number)), pa.list_(pa.binary())
        yield from pa.table([me, t.column(0), docs, pa.nulls(t.num_rows, words)], names).to_batches(max_chunksize=1000)
        yield pa.RecordBatch.from_arrays([me[:1], pa.nulls(1, t.column(0).type), pa.nulls(1, docs.type),
                                          pa.ListArray.from_arrays(pa.array([0, len(got.dictionary)], pa.int32()), got.dictionary.cast(pa.binary()))], names)

    size, rows = 0, []
    for b in batches:
        lengths = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)
        a = 0
        for i, n in enumerate(lengths):
            size += int(n)
            if size >= part_bytes:
                yield from part([*rows, b.slice(a, i + 1 - a)])
                size, rows, a, number = 0, [], i + 1, number + 1
        if a < b.num_rows:
            rows.append(b.slice(a))
    if rows:
        yield from part(rows)


def _rolling(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of so many words, put together from windows of powers of two."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    whole, done, run, span = np.zeros(len(h) + 1, np.uint64), 0, h, 1
    while True:
        power = np.uint64(pow(_BASE, span, 1 << 64))
        if size & span:
            whole = whole[:len(run) - done] * power + run[done:]
            done += span
        if done == size:
            break
        run = run[:-span] * power + run[span:]
        span *= 2
    whole = (whole ^ (whole >> np.uint64(29))) * _MIX
    return whole ^ (whole >> np.uint64(32))


class _Words:
    """The words of a part's documents one after the other."""

    def __init__(self, t: pa.Table):
        self.docs = t.filter(pc.is_valid(t.column("at")))
        self.distinct = [w for x in t.filter(pc.is_valid(t.column("words"))).column("words").chunks for w in x.flatten().to_pylist()]
        self.lengths = pc.list_value_length(self.docs.column("at")).to_numpy().astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.numbers = np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy() for c in self.docs.column("at").chunks)])
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.at = np.arange(len(self.numbers))

    def ranks(self) -> np.ndarray:
        """The rank of each document of the part: by id, null ids last, then as stored."""
        at = pc.sort_indices(self.docs.select(["doc_id"]).append_column("nth", pa.array(np.arange(self.docs.num_rows))),
                             sort_keys=[("doc_id", "ascending"), ("nth", "ascending")], null_placement="at_end").to_numpy()
        rank = np.empty(len(at), np.int64)
        rank[at] = np.arange(len(at))
        return rank

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(places where a window of so many words of one document starts, their hashes)."""
        from xxhash import xxh64_intdigest

        h = np.array([xxh64_intdigest(w, seed) for w in self.distinct], np.uint64)[self.numbers] if self.distinct else np.zeros(0, np.uint64)
        h = _rolling(h, size)
        starts = self.at[:len(h)]
        inside = starts + size <= self.ends[self.doc[:len(h)]] if len(h) else np.zeros(0, bool)
        return starts[inside], h[inside]


def _keys(h: np.ndarray, bits: int) -> np.ndarray:
    """A slice number of so many bits with LOW bits of the hash behind it."""
    return h >> np.uint64(64 - LOW - bits)


def _written(ordered: np.ndarray) -> bytes:
    """Sorted numbers as their steps, all lowest bytes first, then all second bytes and so on: steps are small, so that the later ones are zeros to the codec."""
    return np.diff(ordered.astype("<u4"), prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _read(values: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.cumsum(np.ascontiguousarray(np.frombuffer(x.as_py(), np.uint8).reshape(4, -1).T).view("<u4")[:, 0], dtype=np.uint32) for x in values]


def _probes(t: pa.Table, bits: int) -> pa.Table:
    """One part: per slice its distinct windows, those among them that are aligned blocks, and those that it has twice."""
    w = _Words(t)
    starts, h = w.windows(BLOCK)
    keys = _keys(h, bits)
    first = (w.ends - w.lengths)[w.doc[starts]]
    blocks = np.unique(keys[(starts - first) % BLOCK == 0])
    every, n = np.unique(keys, return_counts=True)
    lists = [every, blocks, every[n > 1]]
    edges = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(LOW)
    cuts = [np.searchsorted(x, edges) for x in lists]
    some = np.flatnonzero(np.diff(cuts[0]))
    low = np.uint64((1 << LOW) - 1)
    cols = [pa.array([_written(x[c[s]:c[s + 1]] & low) for s in some], pa.binary()) for x, c in zip(lists, cuts, strict=True)]
    return pa.table([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), t.column("part")[0].as_py())), *cols], ["slice", "part", "probes", "blocks", "twice"])


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _hits(t: pa.Table) -> pa.Table:
    """One slice: of each part's probes those that hit a block and are found at two places at least."""
    blocks = np.unique(np.concatenate(_read(t.column("blocks"))))
    hits = [x[_among(x, blocks)] for x in _read(t.column("probes"))]
    found, n = np.unique(np.concatenate(hits), return_counts=True)
    again = np.union1d(found[n > 1], np.concatenate(_read(t.column("twice"))))
    hits = [x[_among(x, again)] for x in hits]
    out = pa.table([t.column("part"), t.column("slice"), pa.array([_written(x) for x in hits], pa.binary())], ["part", "slice", "hits"])
    return out.filter(pa.array([bool(len(x)) for x in hits]))


def _ends(order: np.ndarray, *of: np.ndarray) -> np.ndarray:
    """Where, in an order that puts equal ones together, a new one begins."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in of:
        new[1:] |= x[order][1:] != x[order][:-1]
    return new


def _candidates(docs: pa.Table, hits: pa.Table, bits: int) -> pa.Table:
    """One part: the 20-word windows around its hits, one row per distinct window, for its first occurrence there."""
    kinds = {"a": pa.int64(), "b": pa.int64(), "doc_id": docs.schema.field("doc_id").type, "part": pa.int64(), "twice": pa.bool_()}
    if not docs.num_rows or not hits.num_rows:
        return pa.table([pa.array([], k) for k in kinds.values()], list(kinds))
    w = _Words(docs)
    known = np.sort(np.concatenate([x.astype(np.uint64) + (np.uint64(s) << np.uint64(LOW))
                                    for s, x in zip(hits.column("slice").to_pylist(), _read(hits.column("hits")), strict=True)]))
    starts, h = w.windows(BLOCK)
    hit = np.zeros(len(w.at) + 1, np.int32)
    hit[starts] = _among(_keys(h, bits), known)
    upto = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
    starts, a = w.windows(WINDOW)
    around = upto[starts + WINDOW - BLOCK + 1] > upto[starts]
    starts, a, b = starts[around], a[around], w.windows(WINDOW, 1)[1][around] >> np.uint64(32)
    order = np.lexsort((w.ranks()[w.doc[starts]] << 32 | starts, b, a))
    first = np.flatnonzero(_ends(order, a, b))
    many = np.diff(np.concatenate([first, [len(a)]])) > 1
    first = order[first]
    ids = w.docs.column("doc_id").take(pa.array(w.doc[starts[first]]))
    return pa.table([pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)), ids, pa.array(np.full(len(first), docs.column("part")[0].as_py())), pa.array(many)], list(kinds))


def _cleaned(docs: pa.Table, judged: pa.Table) -> pa.Table:
    """One part: its documents without the words of windows that start earlier somewhere."""
    names = ["doc_id", "kept", "n_words", "removed"]
    ranges = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    if not docs.num_rows:
        return pa.table([pa.array([], k) for k in (docs.schema.field("doc_id").type, pa.string(), pa.int64(), ranges)], names)
    w = _Words(docs)
    gone = np.zeros(len(w.at) + WINDOW + 1, np.int32)
    if judged.num_rows:
        a, b = (judged.column(c).to_numpy().view(np.uint64) for c in "ab")
        by = np.lexsort((b, a))
        a, b, own = a[by], b[by], judged.column("own").to_numpy()[by]
        starts, x = w.windows(WINDOW)
        y = w.windows(WINDOW, 1)[1] >> np.uint64(32)
        at = np.searchsorted(a, x)
        maybe = np.flatnonzero(at < len(a))
        same = np.zeros(len(x), bool)
        while len(maybe):  # equal first halves stand side by side
            maybe = maybe[a[at[maybe]] == x[maybe]]
            same[maybe] = b[at[maybe]] == y[maybe]
            maybe = maybe[~same[maybe]]
            at[maybe] += 1
            maybe = maybe[at[maybe] < len(a)]
        starts, at = starts[same], at[same]
        order = np.lexsort((w.ranks()[w.doc[starts]] << 32 | starts, at))
        later = starts[order][~(_ends(order, at) & own[at[order]])]
        gone[later] += 1  # a place starts one window
        gone[later + WINDOW] -= 1
    out = np.cumsum(gone, dtype=np.int32)[:len(w.at)] > 0
    change = np.concatenate([[True], w.doc[1:] != w.doc[:-1]]) if len(out) else np.zeros(0, bool)
    begin = np.flatnonzero(out & (change | ~np.concatenate([[False], out[:-1]])))
    end = np.flatnonzero(out & np.concatenate([change[1:] | ~out[1:], [True]])) + 1
    starts = w.ends - w.lengths
    of = w.doc[begin]
    spans = pa.StructArray.from_arrays([pa.array((begin - starts[of]).astype(np.int32)), pa.array((end - starts[of]).astype(np.int32))], fields=list(ranges.value_type))
    removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(w.ends) + 1)), pa.int32()), spans)
    left = np.concatenate([[0], np.cumsum(~out)])[np.concatenate([[0], w.ends])]
    words = pa.array(w.distinct, pa.binary()).cast(pa.string()).take(pa.array(w.numbers[~out]))
    kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words), " ")
    return pa.table([w.docs.column("doc_id"), kept, pa.array(w.lengths), removed], names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document: doc_id, kept (its kept words joined by spaces), n_words, removed (ranges of word numbers, end exclusive).

    A word goes if a run of 20 words over it also starts earlier: in a document of a smaller id, or before in the same one. Judged on the input.
    Null texts have no words. Null ids count as the largest. Rows that repeat an id stand in the order in
    which they are stored; of equal rows one is first. Other columns are ignored; an empty table gives an empty result; a text longer than a part is a part alone.
    """
    d = whole_text(docs, id_col, text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    d = bucketed(d.mapInArrow(partial(_numbered, part_bytes=part_bytes), f"part long, doc_id {kind}, at array<int>, words array<binary>"), "part", "words")
    parts = d.select("part").distinct().count()
    bits = min(16, max(6, (2 * parts).bit_length()))  # a slice holds the distinct windows of half a part, until there are 32,768 parts
    probes = d.groupBy("part").applyInArrow(lambda t: _probes(t, bits), "slice int, part long, probes binary, blocks binary, twice binary")
    hits = probes.groupBy("slice").applyInArrow(_hits, "part long, slice int, hits binary")
    found = d.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(lambda t, x: _candidates(t, x, bits), f"a long, b long, doc_id {kind}, part long, twice boolean")
    same = Window.partitionBy("a", "b")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "part")
    judged = found.withColumn("place", place).withColumn("own", F.col("place") == F.min("place").over(same))
    judged = judged.where("twice or not own").select("part", "a", "b", "own")  # a part's first occurrences stay where no verdict comes back
    return d.groupBy("part").cogroup(judged.groupBy("part")).applyInArrow(_cleaned, f"doc_id {kind}, kept string, n_words long, removed {_RANGES}")
