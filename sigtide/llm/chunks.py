"""One table of distinct chunks: token ids of whole texts from the ids of their distinct chunks.

Where no token can cross a chunk's edge, a text's ids are its chunks' ids in order. A part (a bounded run of documents of one task) numbers its
distinct chunks and keeps its documents as those numbers, in buckets by part. Only the distinct chunks of each part are shuffled, by slice of
a hash; a slice encodes each of its distinct chunks once, for all parts, and sends every part the ids of its own list, in the list's
order. The ids then join the documents by position.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, partial
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtide.llm.common import bucketed

#: Bytes of text of a part: what one task numbers and holds in memory at a time, with some ten times that for its numbers.
PART_BYTES = 16_000_000
#: Ids of documents that are worked on together.
GROUP_IDS = 250_000
#: White space as Unicode has it, in a class of a pattern.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEP = "\x00"


class Scheme(NamedTuple):
    """How a model's texts fall into chunks. Texts without ``odd`` split before every ``space`` and around line feeds; ``cut`` splits any text."""

    prepare: Callable[[str], str] | None
    odd: str
    space: str
    cut: Callable[[str], list[str]]
    encode: Callable[[list[str]], Sequence[Sequence[int]]]


def _chunks(texts: pa.Array, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(order of the texts, number of chunks of each in that order, all chunks)."""
    odd = pc.match_substring_regex(texts, scheme.odd).to_numpy(zero_copy_only=False)
    order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
    plain = pc.replace_substring(texts.filter(pa.array(~odd)), scheme.space, _SEP + scheme.space)
    plain = pc.split_pattern(pc.replace_substring(plain, "\n", f"{_SEP}\n{_SEP}"), _SEP)
    cut = [scheme.cut(t.as_py()) for t in texts.filter(pa.array(odd))]
    sizes = np.concatenate([plain.value_lengths().to_numpy(zero_copy_only=False), np.array([len(c) for c in cut], np.int32)])
    return order, sizes, pa.concat_arrays([plain.flatten(), pa.array([x for c in cut for x in c], pa.string())])


def _part(at: int, rows: pa.Table, scheme: Scheme, slices: int) -> Iterator[pa.RecordBatch]:
    """Documents as numbers of their chunks, and per slice the chunks in it; chunks are numbered slice by slice."""
    names = ["part", "doc_id", "at", "slice", "start", "chunks"]
    key, list_of, chunks_of = rows.schema.field(0).type, pa.list_(pa.int32()), pa.list_(pa.binary())
    texts = rows.column(1).combine_chunks()
    if scheme.prepare:
        texts = pa.array([scheme.prepare(t) for t in texts.to_pylist()], pa.string())
    order, sizes, values = _chunks(texts, scheme)
    got = values.dictionary_encode()
    distinct = got.dictionary.cast(pa.binary())
    of = np.array([zlib.crc32(c) % slices for c in distinct.to_pylist()], np.int32)
    by = np.argsort(of, kind="stable")
    new = np.empty(len(by), np.int32)
    new[by] = np.arange(len(by), dtype=np.int32)
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    docs = pa.ListArray.from_arrays(ends, pa.array(new[got.indices.to_numpy()], pa.int32()))
    n = len(docs)
    me = lambda m: pa.array(np.full(m, at))
    cols = [me(n), rows.column(0).take(pa.array(order)), docs, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, chunks_of)]
    yield from pa.table(cols, names).to_batches(max_chunksize=500)
    some, starts = np.unique(of, return_index=False), np.searchsorted(of[by], np.arange(slices + 1))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([starts[some], starts[-1:]]), pa.int32()), distinct.take(pa.array(by)))
    n = len(some)
    cols = [me(n), pa.nulls(n, key), pa.nulls(n, list_of), pa.array(some, pa.int32()), pa.array(starts[some], pa.int32()), lists]
    yield from pa.table(cols, names).to_batches(max_chunksize=64)


def _numbered(batches: Iterator[pa.RecordBatch], scheme: Callable[[], Scheme], slices: int, part_bytes: int) -> Iterator[pa.RecordBatch]:
    number = count(TaskContext.get().partitionId() << 24)
    size, rows = 0, []
    for b in batches:
        a = 0
        for i, n in enumerate(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).tolist()):
            size += n
            if size >= part_bytes:
                yield from _part(next(number), pa.Table.from_batches([*rows, b.slice(a, i + 1 - a)]), scheme(), slices)
                size, rows, a = 0, [], i + 1
        if a < b.num_rows:
            rows.append(b.slice(a))
    if rows:
        yield from _part(next(number), pa.Table.from_batches(rows), scheme(), slices)


def _gather(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs that begin at ``first`` and are ``n`` long, one after the other, and where each ends."""
    ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    return np.repeat(first - ends[:-1], n) + np.arange(ends[-1]), ends


def _encoded(t: pa.Table, scheme: Callable[[], Scheme]) -> pa.Table:
    """One slice: each distinct chunk encoded once; per part how many ids each chunk of its list has, and the ids."""
    lists = t.column("chunks").combine_chunks()
    got = lists.flatten().dictionary_encode()
    distinct, at = got.dictionary.cast(pa.string()).to_pylist(), got.indices.to_numpy()
    ids: list[Sequence[int]] = []
    for a in range(0, len(distinct), 20_000):
        ids += scheme().encode(distinct[a:a + 20_000])
    n = np.array([len(i) for i in ids], np.int32)
    flat = np.concatenate([np.zeros(0, np.int32), *(np.asarray(i, np.int32) for i in ids)])
    places, ends = _gather((np.cumsum(n, dtype=np.int64) - n)[at], n[at])
    edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    as_list = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))
    return pa.table([t.column("part"), t.column("start"), as_list(edges, n[at]), as_list(ends[edges], flat[places])], ["part", "start", "counts", "ids"])


def _joined(docs: pa.Table, lists: pa.Table) -> Iterator[tuple[pa.ChunkedArray, np.ndarray, np.ndarray]]:
    """One part: (doc_ids, ends, ids) of some documents at a time; document k has the ids from ends[k] up to ends[k + 1]."""
    lists = lists.sort_by("start")
    counts, ids = (np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy() for c in lists.column(name).chunks)]) for name in ("counts", "ids"))
    first = np.cumsum(counts, dtype=np.int64) - counts
    for batch in docs.select(["doc_id", "at"]).to_batches(max_chunksize=256):
        whole = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))])
        at = batch.column(1).flatten().to_numpy()
        a = 0
        while a < batch.num_rows:
            z = max(a + 1, int(np.searchsorted(whole, whole[a] + GROUP_IDS)))
            z = min(z, batch.num_rows)
            here = at[whole[a]:whole[z]]
            places, ends = _gather(first[here], counts[here])
            yield batch.column(0)[a:z], ends[whole[a:z + 1] - whole[a]], ids[places]
            a = z


def token_ids(docs: DataFrame, scheme: Callable[[], Scheme], finish: Callable[[int, Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]], pa.Table], schema: str,
              part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, text) to what ``finish`` makes of each part's number and of its documents' ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    slices = 1 << min(16, max(6, (2 * docs.rdd.getNumPartitions()).bit_length()))
    t = bucketed(docs.mapInArrow(partial(_numbered, scheme=scheme, slices=slices, part_bytes=part_bytes),
                                 f"part long, doc_id {kind}, at array<int>, slice int, start int, chunks array<binary>"), "part", "chunks")
    lists = t.where(F.col("chunks").isNotNull()).select("part", "slice", "start", "chunks").groupBy("slice").applyInArrow(
        lambda x: _encoded(x, scheme), "part long, start int, counts array<int>, ids array<int>")
    rows = t.where(F.col("at").isNotNull()).select("part", "doc_id", "at")
    return rows.groupBy("part").cogroup(lists.groupBy("part")).applyInArrow(lambda d, x: finish(d.column("part")[0].as_py() if d.num_rows else -1, _joined(d, x)), schema)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> Scheme:
    """Ids of a byte-level BPE of the tokenizers library, special tokens not added.

    Its first cut goes before a single space or at a run of white space, so a chunk is a word with one space before it, or
    white space. A text that holds an added token's string is encoded whole, as that cuts the text before anything else.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    added = re.compile("|".join(re.escape(a.content) for a in t.get_added_tokens_decoder().values()) or "(?!)")
    cut = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
    feed = t.encode("\n", add_special_tokens=False).ids

    def ids(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(part: list[str]) -> list[Sequence[int]]:
        # Words stand in lines of one text, as a call for each costs more than its encoding; a word has no line feed in it.
        alone = [c for c in part if not c or c[-1:].isspace() or "\n" in c or added.search(c)]
        out: dict[str, Sequence[int]] = dict(zip(alone, ids(alone), strict=True))
        words = [c for c in part if c not in out]
        for at in range(0, len(words), 2000):
            lines = words[at:at + 2000]
            got = np.array(ids(["\n".join(["", *lines, ""])])[0])
            ends = np.flatnonzero(got == feed[0])
            out.update((w, got[i + 1:j]) for w, i, j in zip(lines, ends[:-1], ends[1:], strict=True))
        return [out[c] for c in part]

    if len(feed) != 1:
        encode = ids  # noqa: F811
    tokens = [re.escape(a.content) for a in t.get_added_tokens_decoder().values()]
    odd = "|".join([f"[{SPACE}][{SPACE}]", f"[{SPACE.replace(' ', '').replace(chr(9) + '-' + chr(13), chr(9) + chr(11) + chr(12) + chr(13))}]", _SEP, *tokens])
    return Scheme(None, odd, " ", lambda text: cut(text) if not added.search(text) else [text], encode)


@lru_cache(maxsize=4)
def pieces(path: str) -> Scheme:
    """Ids of a sentencepiece model. A chunk is a run of markers with the word after it, or a line feed.

    The vocabulary is read to see that no piece has a marker after another character, nor a line feed in it; a model
    that has one, or that joins words otherwise, is used on whole texts.
    """
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    own = [n for i, n in enumerate(names) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    if any(re.search("[^▁]▁|\n", n) for n in own) or list(sp.encode("\n", out_type=str)) != ["▁", "<0x0A>"]:
        return Scheme(None, "", " ", lambda text: [text] if text else [], lambda part: sp.encode(part, num_threads=1))

    def encode(part: list[str]) -> list[list[int]]:
        # The library puts one marker before a text. A chunk with a marker lends its own; others stand behind a line feed.
        marked = [len(c) > 1 and c[0] == "▁" for c in part]
        got = sp.encode([c[1:] if m else "\n" + c for c, m in zip(part, marked, strict=True)], num_threads=1)
        return [i if m else i[2:] for i, m in zip(got, marked, strict=True)]

    cut = re.compile("\n|▁*[^▁\n]+|▁+").findall
    return Scheme(lambda text: sp.normalize(text) if text else "", "▁▁|" + _SEP, "▁", cut, encode)
