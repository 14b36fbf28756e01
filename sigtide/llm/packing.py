"""Packing token sequences: Martello-Toth dominance reduction, then best fit.

Both work on how many pieces there are of each length, so their input is bounded by the capacity, however many
documents there are. The plan says which ranks within a length go to which sequences; every piece knows its rank from a
count per (part, length) and its place within that, and looks its sequence up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sigtide.llm import chunks
from sigtide.llm.common import stored, whole_text

CAPACITY, END = 2048, 0
Pattern = tuple[tuple[int, int], ...]  # (length, how many), in the order they stand in a sequence


def _largest_pair(sizes: list[int], n: dict[int, int], room: int) -> int:
    """The largest sum of two remaining items that fits, 0 if none."""
    best, i, j = 0, 0, bisect_left(sizes, room + 1) - 1
    while i <= j:
        total = sizes[i] + sizes[j]
        if total > room:
            j -= 1
        else:
            if i < j or n[sizes[i]] > 1:
                best = max(best, total)
            i += 1
    return best


def _smallest(sizes: list[int], n: dict[int, int], k: int) -> list[int]:
    out: list[int] = []
    for s in sizes:
        out += [s] * min(n[s], k - len(out))
        if len(out) == k:
            break
    return out


def reduce_dominated(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fix sets that dominate every other set around their largest item; give back the fixed sets and the counts left.

    With ``room`` beside an item: nothing fits, it stays alone. One item fills the room exactly: that item (what others would fill
    the room fits in its place). At most one item fits: the largest that does. At most two fit and the largest single item is
    no smaller than the largest pair: that item.
    """
    n = {s: c for s, c in counts.items() if c > 0}
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for s in sorted(n, reverse=True):
            while n.get(s, 0):
                n[s] -= 1  # the item itself; the rest are what could stand beside it
                sizes = sorted(x for x, c in n.items() if c) if s > capacity // 2 or n[s] == 0 else sorted(n)
                room = capacity - s
                at = bisect_left(sizes, room + 1) - 1
                mate = sizes[at] if at >= 0 and n[sizes[at]] else 0
                n[s] += 1
                low = _smallest(sizes, n, 3)
                alone = mate == 0
                one = mate == room or len(low) < 2 or low[0] + low[1] > room
                two = one or ((len(low) < 3 or sum(low) > room) and mate >= _largest_pair(sizes, n, room))
                if not (alone or two):
                    break
                times = n[s] if alone else n[s] // 2 if mate == s else min(n[s], n[mate])
                fixed.append((((s, 1),) if alone else ((s, 2),) if mate == s else ((s, 1), (mate, 1)), times))
                for x in (s,) if alone else (s, mate):
                    n[x] -= times
                changed = True
                n = {x: c for x, c in n.items() if c}
    return fixed, n


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, over classes of equal sequences: an item goes where the least room is left that takes it."""
    by_room: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            if room not in by_room:
                insort(rooms, room)
            by_room.setdefault(room, []).append((pattern, times))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        for room in rooms[bisect_left(rooms, s):]:
            if not left:
                break
            fits = room // s
            rest = []
            for pattern, times in by_room[room]:
                full = min(times, left // fits)
                left -= full * fits
                part = left if full < times else 0
                left -= part
                put(room - fits * s, (*pattern, (s, fits)), full)
                put(room - part * s, (*pattern, (s, part)), int(part > 0))
                if times - full - (part > 0):
                    rest.append((pattern, times - full - (part > 0)))
            by_room[room] = rest
            if not rest:
                del by_room[room]
                rooms.pop(bisect_left(rooms, room))
        each = capacity // s
        put(capacity - each * s, ((s, each),), left // each)
        put(capacity - left % each * s, ((s, left % each),), int(left % each > 0))
    return [x for room in rooms for x in by_room[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, sequence, offset): ranks from the first on go to consecutive sequences, until the next row."""
    fixed, left = reduce_dominated(counts, capacity)
    rank = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    for pattern, times in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for s, many in pattern:
            for _ in range(many):
                rows.append((s, rank[s], sequence, offset))
                rank[s] += times
                offset += s
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
               with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, the part and the rank there; ``ids`` if asked for."""
    d = whole_text(docs, id_col, text_col)
    key = to_arrow_type(d.schema["doc_id"].dataType)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
    kinds = [key, pa.int32(), *[pa.int64()] * 5] + [pa.list_(pa.int32())] * with_ids

    def finish(part: int, documents: Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]) -> pa.Table:
        seen, tables = np.zeros(capacity + 1, np.int64), [pa.table([pa.array([], k) for k in kinds], names)]
        end = np.array([END], "<u4").tobytes()
        for keys, ends, ids in documents:
            rows, bodies, flat = [], [], ids.astype("<u4").tobytes()
            for i, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                raw = flat[4 * x:4 * y] + end
                n = y - x + 1
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((i, k, a, z - a, zlib.crc32(memoryview(raw)[4 * a:4 * z]), part, seen[z - a]))
                    seen[z - a] += 1
                    if with_ids:
                        bodies.append(np.frombuffer(raw, "<i4")[a:z])
            c = np.array(rows, np.int64).T
            cols = [keys.take(pa.array(c[0])), pa.array(c[1].astype(np.int32)), *map(pa.array, c[2:])]
            tables.append(pa.table(cols + [pa.array(bodies, pa.list_(pa.int32()))] * with_ids, names))
        return pa.concat_tables(tables)

    return chunks.token_ids(d, partial(chunks.byte_bpe, tokenizer), finish, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part long, nth long"
                            + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document, its ids and an end id, in as few sequences of ``capacity`` ids as dominance and best fit find.

    Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for). Only documents longer than a
    sequence are cut, the first piece takes the remainder. A null or empty text is the end id alone. Repeated rows are packed as often as they come; null ids
    stay null; an empty table packs into nothing. Other columns are ignored. ``tokenizer``: a path that every executor has.
    """
    spark = docs.sparkSession
    p = stored(cut_pieces(docs, tokenizer, capacity, id_col, text_col, with_ids), "pieces")
    each = stored(p.groupBy("part", "length").count(), "lengths")
    rows = plan({r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)  # capacity rows at most
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = each.select("part", "length", F.coalesce(before, F.lit(0)).alias("first"))
    ranked = p.join(first, ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    shared = spark.sparkContext.broadcast(rows)  # bounded by the capacity, like the lengths
    given = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = t[:, 0] << 48 | t[:, 1]
        for b in batches:
            size, rank = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("length", "rank"))
            at = np.searchsorted(keys, size << 48 | rank, side="right") - 1
            new = [pa.array(t[at, 2] + rank - t[at, 1]), pa.array(t[at, 3])]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in given), *new], [*given, "sequence_id", "offset"])

    kinds = ", ".join(f"{c} {p.schema[c].dataType.simpleString()}" for c in given)
    return ranked.select(*given, "rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")
