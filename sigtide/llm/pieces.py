"""SentencePiece encoding and decoding of whole texts with a distinct-chunk table in every task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sigtide.llm import chunks
from sigtide.llm.common import whole_text


#: Chunks of a worker's table before it is emptied, and characters of texts that are worked on together.
TABLE_ROWS, GROUP_CHARS = 600_000, 1_000_000


class ChunkTable:
    """Ids of distinct chunks, kept in a Python worker over batches and tasks; later texts find the chunks of earlier ones."""

    def __init__(self, scheme: chunks.Scheme, rows: int = TABLE_ROWS):
        self.scheme, self.rows, self.table = scheme, rows, {}

    def ids(self, texts: Sequence[str]) -> Iterator[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit numbers."""
        prepare = self.scheme.prepare or str
        cut = [self.scheme.cut(prepare(t)) if t else [] for t in texts]
        if len(self.table) > self.rows:
            self.table.clear()
        new = list(set().union(*cut).difference(self.table))
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            self.table.update((c, np.array(i, "<u4").tobytes()) for c, i in zip(part, self.scheme.encode(part), strict=True))
        get = self.table.__getitem__
        return (b"".join(map(get, own)) for own in cut)


@lru_cache(maxsize=4)
def worker_table(model: str, rows: int = TABLE_ROWS) -> ChunkTable:
    return ChunkTable(chunks.pieces(model), rows)


def groups(texts: Sequence[str], chars: int = GROUP_CHARS) -> Iterator[slice]:
    """Slices of consecutive texts of about so many characters, one text at least."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > chars:
            yield slice(start, i)
            start, n = i, 0
        n += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


@lru_cache(maxsize=4)
def _decoder(path: str):
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=path).decode


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): all ids of each text, no begin or end ids, no sampling.

    Null and empty texts have no ids. Every input row gives one row, repeated rows and null ids included; other columns are
    ignored. Texts of any length stay whole. ``model``: a path that every executor has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = worker_table(model).ids
        for b in batches:
            texts = b.column(1).to_pylist()
            for part in groups(texts):
                raw = list(ids_of(texts[part]))
                ends = np.cumsum([0, *(len(x) // 4 for x in raw)])
                flat = pa.array(np.frombuffer(b"".join(raw), "<i4"))
                yield pa.RecordBatch.from_arrays([b.column(0)[part.start:part.stop], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "ids"])

    d = whole_text(docs, id_col, text_col)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """The frame with a column ``decoded``: the library's text of the ids. Null ids decode to an empty text."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = _decoder(model)
        for b in batches:
            at = b.schema.get_field_index(ids_col)
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                text = [text_of(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{kinds}, decoded string")
