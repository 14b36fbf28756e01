"""Phrase collocations by set-oriented mining (SETM) over sorted occurrence relations.

Level 1 numbers the words of a part (a bounded run of documents of one task) and writes the occurrence
relation, in order of piece and position, with a dictionary of the part's distinct words and their counts. Each further level
counts the groups over all parts, semi-joins every part's relation with those that are frequent, and merge-joins it with
itself at the next position of the same piece. Distinct groups of a part, never occurrences, are shuffled, as packed lists by slice
of a hash: the relation lies in buckets by part, and a part gets back only its own frequent groups, packed as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigtide.llm import packed
from sigtide.llm.common import bucket_count, bucketed, stored

#: Bytes of text of a part: what one task holds in memory at a time, with some ten times that for its numbers.
PART_BYTES = 12_000_000
MIN_COUNT, MAX_WORDS, TOP, ABSORBED_PERCENT, SCALE = 10, 3, 2000, 50, 1_000_000
#: Piece ends become line feeds, tabs become spaces; then words stand between single spaces.
_CUT = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_END, _NONE, _FIRST = 0, 1, 2  # a piece's end, the empty string between two spaces, the first word's number


def _packed(x: np.ndarray, steps: bool = False, kind: str = "<u4") -> bytes:
    return packed.squeezed(packed.written(x, steps, kind))


def _unpacked(column: pa.ChunkedArray, steps: bool = False, kind: str = "<u4") -> list[np.ndarray]:
    return [packed.read(packed.unsqueezed(x.as_py()), steps, kind) for x in column]


def _numbered(texts: list[bytes], first: int, slices: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Texts of one language to their occurrences in order (a number per word from ``first`` on, one mark between pieces), words in order of their
    numbers, the slices of their hashes, in order too, and their counts."""
    cut = [t.lower().translate(_CUT).replace(b"\n", b" \n ") + b" \n" for t in texts]
    got = pc.split_pattern(pa.array(cut, pa.binary()).cast(pa.string()), " ").flatten().dictionary_encode()
    at, words = got.indices.to_numpy(), got.dictionary
    number, real = np.zeros(len(words), np.int32), np.ones(len(words), bool)
    for mark, n in (("\n", _END), ("", _NONE)):
        place = pc.index(words, mark).as_py()
        if place >= 0:
            number[place], real[place] = n, False
    own = np.flatnonzero(real)
    words = words.take(pa.array(own))
    of = np.fromiter((crc32(w) % slices for w in words.cast(pa.binary()).to_pylist()), np.int32, len(own))
    by = pc.sort_indices(pa.table([pa.array(of), words], ["slice", "word"]), [("slice", "ascending"), ("word", "ascending")]).to_numpy()
    number[own[by]] = np.arange(first, first + len(own), dtype=np.int32)
    ids = number[at]
    ids = ids[ids != _NONE]
    ids = ids[(ids != _END) | np.concatenate([[True], ids[:-1] != _END])]
    return ids, words.take(pa.array(by)), of[by], np.bincount(at, minlength=len(number))[own[by]]


def _relation(batches: Iterator[pa.RecordBatch], part_bytes: int, slices: int) -> Iterator[pa.RecordBatch]:
    """(lang, text) to rows of the relation (part, ids) and of the part's dictionary by slice (part, lang, slice, start, words, n, total)."""
    names = ["part", "ids", "lang", "slice", "start", "words", "n", "total"]
    kinds = [pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
    number = count(TaskContext.get().partitionId() << 12)  # parts of a task; one of over 4,096 would be of 48 GB

    def rows(many: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(many, t) for c, t in zip(names, kinds, strict=True)], names)

    def part(by_lang: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        at, first = next(number), _FIRST
        for lang, texts in by_lang.items():
            ids, words, of, n = _numbered(texts, first, slices)
            yield rows(1, part=[at], ids=[_packed(ids)])
            some, starts = np.unique(of, return_index=True)
            runs = [*zip(starts, np.append(starts, len(of))[1:], strict=True)]
            m = len(runs)
            yield rows(m, part=[at] * m, lang=[lang] * m, slice=some, start=starts + first,
                       words=[packed.squeezed("\n".join(words[a:z].to_pylist()).encode()) for a, z in runs],
                       n=[_packed(n[a:z]) for a, z in runs], total=[int(n[a:z].sum()) for a, z in runs])
            first += len(of)

    size, by_lang = 0, {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
            size += len(text)
            if size >= part_bytes:
                yield from part(by_lang)
                size, by_lang = 0, {}
    yield from part(by_lang)


def _count_words(t: pa.Table, slices: int, least: int) -> pa.Table:
    """One slice: words that occur ``least`` times over all parts, by language, and per part the numbers and names of its own among them."""
    names, kinds = ["part", "id", "g", "lang", "word", "f", "name"], [pa.int64(), pa.binary(), pa.binary(), pa.string(), *[pa.list_(x) for x in (pa.string(), pa.int64(), pa.int64())]]
    rows: list[list] = [[] for _ in names]
    given, at = t.column("slice")[0].as_py(), 1
    for lang in pc.unique(t.column("lang")).to_pylist():
        own = t.filter(pc.equal(t.column("lang"), lang))
        texts = pa.array([packed.unsqueezed(x.as_py()) for x in own.column("words")], pa.binary()).cast(pa.string())
        lists = pc.split_pattern(texts, "\n")
        codes = (every := lists.flatten().dictionary_encode()).indices.to_numpy()
        f = np.zeros(len(every.dictionary), np.int64)
        np.add.at(f, codes, np.concatenate(_unpacked(own.column("n"))).astype(np.int64))
        ranked = pc.sort_indices(every.dictionary).to_numpy()
        ranked = ranked[f[ranked] >= least]
        name = np.full(len(f), -1, np.int64)
        name[ranked] = np.arange(at, at + len(ranked)) * slices + given
        at += len(ranked)
        for column, value in zip(rows, (None, None, None, lang, every.dictionary.take(pa.array(ranked)).to_pylist(), f[ranked], name[ranked]), strict=True):
            column.append(value)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        for part, start, z, size in zip(own.column("part").to_pylist(), own.column("start").to_pylist(), ends, np.diff(ends, prepend=0), strict=True):
            g = name[codes[z - size:z]]
            held = np.flatnonzero(g >= 0)
            if len(held):
                for column, value in zip(rows, (part, _packed(start + held, True), _packed(g[held], False, "<u8"), None, None, None, None), strict=True):
                    column.append(value)
    return pa.table([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)


def _extend(left: pa.Table, right: pa.Table, slices: int, last: bool) -> pa.Table:
    """One part: its relation (ids) and its frequent groups (id, g) to the groups one word longer, by slice, and their relation unless it is the last.

    The relation is in order of piece and position, so the merge join at the next position pairs neighbouring rows.
    """
    names = ["part", "ids", "slice", "start", "g1", "g2", "n"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    empty = pa.table([pa.array([], t) for t in kinds], names)
    if not left.num_rows or not right.num_rows:
        return empty
    ids = np.concatenate(_unpacked(left.column("ids"))).astype(np.int32)
    frequent, g = np.concatenate(_unpacked(right.column("id"), True)).astype(np.int32), np.concatenate(_unpacked(right.column("g"), False, "<u8")).astype(np.int64)
    order = np.argsort(g)  # so that keys sort as names do
    frequent, g = frequent[order], g[order]
    place = np.full(max(int(ids.max()), int(frequent.max())) + 1, -1, np.int32)
    place[frequent] = np.arange(len(frequent), dtype=np.int32)
    kept = place[ids]  # the semi-join
    both = (kept[:-1] >= 0) & (kept[1:] >= 0)
    if not both.any():
        return empty
    pairs = kept[:-1][both].astype(np.int64) * len(frequent) + kept[1:][both]
    keys, n = np.unique(pairs, return_counts=True)
    one, two = g[keys // len(frequent)], g[keys % len(frequent)]
    of = ((one.astype(np.uint64) * _MIX ^ two.astype(np.uint64)) * _MIX >> np.uint64(40)).astype(np.int64) % slices
    by = np.argsort(of, kind="stable")
    some, starts = np.unique(of[by], return_index=True)
    ends = np.append(starts[1:], len(by))
    runs = [by[a:z] for a, z in zip(starts, ends, strict=True)]
    m, part = len(some), left.column("part")[0].as_py()
    out = [pa.table([pa.array(np.full(m, part)), pa.nulls(m, kinds[1]), pa.array(some, pa.int32()), pa.array(starts + _FIRST, pa.int32()),
                     pa.array([_packed(one[r], True, "<u8") for r in runs]), pa.array([_packed(two[r], False, "<u8") for r in runs]),
                     pa.array([_packed(n[r]) for r in runs])], names)]
    if not last:
        new = np.empty(len(by), np.int32)
        new[by] = np.arange(len(by), dtype=np.int32) + _FIRST
        longer = np.zeros(len(ids), np.int32)
        longer[:-1][both] = new[np.searchsorted(keys, pairs)]
        longer = longer[(longer != _END) | np.concatenate([[True], longer[:-1] != _END])]
        out.append(pa.table([pa.array([part]), pa.array([_packed(longer)]), *(pa.nulls(1, t) for t in kinds[2:])], names))
    return pa.concat_tables(out)


def _count(t: pa.Table, slices: int, least: int, last: bool) -> pa.Table:
    """One slice: groups that occur ``least`` times over all parts, and per part the numbers and names of its own among them."""
    names = ["part", "id", "g", "name", "g1", "g2", "f"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 4]
    one, two, n = _unpacked(t.column("g1"), True, "<u8"), _unpacked(t.column("g2"), False, "<u8"), _unpacked(t.column("n"))
    sizes = np.array([len(x) for x in one])
    one, two, n = np.concatenate(one), np.concatenate(two), np.concatenate(n).astype(np.int64)
    by = np.lexsort((two, one))
    first = np.concatenate([[True], (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])])
    starts = np.flatnonzero(first)
    f = np.add.reduceat(n[by], starts)
    often = f >= least
    name = np.where(often, np.cumsum(often) * slices + t.column("slice")[0].as_py(), -1)
    head = by[starts[often]]
    rows = [[None], [None], [None], [name[often]], [one[head].astype(np.int64)], [two[head].astype(np.int64)], [f[often]]]
    if not last:
        g = np.empty(len(by), np.int64)
        g[by] = name[np.cumsum(first) - 1]
        ends = np.cumsum(sizes)
        for part, start, a, z in zip(t.column("part").to_pylist(), t.column("start").to_pylist(), ends - sizes, ends, strict=True):
            at = np.flatnonzero(g[a:z] >= 0)
            if len(at):
                for column, value in zip(rows, (part, _packed(start + at, True), _packed(g[a:z][at], False, "<u8"), None, None, None, None), strict=True):
                    column.append(value)
    return pa.table([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)


def _of_one(step: Callable[..., pa.Table]) -> Callable[[pa.Table], pa.Table]:
    return lambda t: step(t)  # Spark looks at the number of parameters


def _of_two(step: Callable[..., pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda left, right: step(left, right)


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT, max_words: int = MAX_WORDS,
         part_bytes: int = PART_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language and, level by level, all frequent phrases.

    First frame: lang, n (all word occurrences). Others, one per number of words from 1: lang, words array, f, ``prefixes`` and ``suffixes``
    (the counts of its first and last 1, 2, ... words), g (its name), g1 and g2 (names of the phrases without the last and without the first word).
    """
    d = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                    F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    buckets = bucket_count(d)
    slices = 1 << min(16, max(6, (2 * d.rdd.getNumPartitions()).bit_length()))
    level = bucketed(d.mapInArrow(partial(_relation, part_bytes=part_bytes, slices=slices),
                                  "part long, ids binary, lang string, slice int, start int, words binary, n binary, total long"), "part", "relation", buckets)
    by_slice = level.where("slice is not null")
    total = by_slice.groupBy("lang").agg(F.sum("total").alias("n"))
    words = stored(by_slice.drop("ids", "total").groupBy("slice").applyInArrow(
        _of_one(partial(_count_words, slices=slices, least=least)),
        "part long, id binary, g binary, lang string, word array<string>, f array<long>, name array<long>"), "words")
    none = F.array().cast("array<long>")
    own = words.where("part is null").select("lang", F.inline(F.arrays_zip("word", "f", F.col("name").alias("g"))))
    found = [stored(own.select("lang", F.array("word").alias("words"), "f", none.alias("prefixes"), none.alias("suffixes"), "g"), "phrases")]
    back = words.where("part is not null").select("part", "id", "g")
    for size in range(2, max_words + 1):
        last = size == max_words
        rel = level.where("ids is not null").select("part", "ids")
        longer = rel.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(
            _of_two(partial(_extend, slices=slices, last=last)), "part long, ids binary, slice int, start int, g1 binary, g2 binary, n binary")
        level = bucketed(longer, "part", "relation", buckets)
        groups = level.where("slice is not null").drop("ids").groupBy("slice").applyInArrow(
            _of_one(partial(_count, slices=slices, least=least, last=last)), "part long, id binary, g binary, name array<long>, g1 array<long>, g2 array<long>, f array<long>")
        groups = stored(groups, "groups")
        back = groups.where("part is not null").select("part", "id", "g")
        own = groups.where("part is null").select(F.inline(F.arrays_zip(F.col("name").alias("g"), "g1", "g2", "f")))
        a = found[-1].select(F.col("g").alias("g1"), "lang", "words", "prefixes", F.col("f").alias("f1"))
        b = found[-1].select(F.col("g").alias("g2"), F.element_at("words", -1).alias("tail"), "suffixes", F.col("f").alias("f2"))
        own = own.join(a, "g1").join(b, "g2").select(
            "lang", F.concat("words", F.array("tail")).alias("words"), "f", F.concat("prefixes", F.array("f1")).alias("prefixes"),
            F.concat("suffixes", F.array("f2")).alias("suffixes"), "g", "g1", "g2")
        found.append(stored(own, "phrases"))
    return total, found


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, least: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``max_words`` words: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is that of its lowest cut, floor(1,000,000 a a / (l r)) in exact decimals, ties to the shortest first part. Phrases that stand inside a
    frequent longer one with at least half their count are left out; as counts fall with length, those one word longer decide.
    Null texts are empty and give nothing; a null language is ``und``. Repeated rows count as often as they come; ids are not
    looked at, other columns are ignored. A table without a phrase of ``least`` occurrences gives no rows. The largest ``a`` for exact decimals is 10^15.
    """
    total, found = mine(docs, text_col, lang_col, least, max_words, part_bytes)
    scored = []
    for size, p in enumerate(found[1:], 2):
        cut = lambda j: f"struct(cast({SCALE} as decimal(38,0)) * f * f div (cast(prefixes[{j - 1}] as decimal(38,0)) * suffixes[{size - j - 1}]) as score, {j} as j, prefixes[{j - 1}] as l, suffixes[{size - j - 1}] as r)"
        best = F.expr(cut(1) if size == 2 else f"least({', '.join(cut(j) for j in range(1, size))})")
        if size < max_words:
            inner = found[size].select(F.explode(F.array("g1", "g2")).alias("g"), F.col("f").alias("longest")).groupBy("g").agg(F.max("longest").alias("longest"))
            p = p.join(inner, "g", "left").where(~F.coalesce(100 * F.col("longest") >= ABSORBED_PERCENT * F.col("f"), F.lit(False)))
        scored.append(p.withColumn("best", best).select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "best.l", "best.r", "best.score"))
    ordered = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    every = reduce(DataFrame.union, scored).withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)
    return every.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
