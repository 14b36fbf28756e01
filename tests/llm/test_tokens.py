"""Encoding, decoding and packing against the libraries themselves."""

import hashlib
import random
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sigtide.llm import chunks, packing, pieces
from sigtide.llm.queries import BYTE_BPE, PIECE_BPE, op2_best_fit_packing, op4_sentencepiece

from .helpers import ROWS, awkward, empty

ALPHABET = "ab'sé1 \n\t\x1c\x85▁<|endoftext|>　ß😀’.\r\x00"


@pytest.fixture(scope="module")
def fuzz():
    rng = random.Random(4)
    words = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    return [*words, "  <|endoftext|>  a", "", " ", "\n\n", "▁", "▁▁ ▁a", *(t or "" for _, t in ROWS if len(t or "") < 100)]


@pytest.mark.parametrize("part_bytes", [16_000_000, 200])
def test_chunk_tables_equal_the_libraries(spark, fuzz, part_bytes):
    t, sp = Tokenizer.from_file(BYTE_BPE), SentencePieceProcessor(model_file=PIECE_BPE)
    d = spark.createDataFrame(list(enumerate(fuzz)), "doc_id long, text string").repartition(3)

    def finish(part, documents):
        rows = [(k.as_py(), ids[a:z].tolist()) for keys, ends, ids in documents for k, a, z in zip(keys, ends[:-1], ends[1:], strict=True)]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["doc_id", "ids"])

    for scheme, want in ((partial(chunks.byte_bpe, BYTE_BPE), [e.ids for e in t.encode_batch(fuzz, add_special_tokens=False)]), (partial(chunks.pieces, PIECE_BPE), sp.encode(fuzz))):
        got = chunks.token_ids(d, scheme, finish, "doc_id long, ids array<int>", part_bytes).orderBy("doc_id").collect()
        assert [list(r.ids) for r in got] == want


@pytest.mark.parametrize("rows", [600_000, 50])
def test_worker_table_equals_the_library(fuzz, rows):
    table, sp = pieces.ChunkTable(chunks.pieces(PIECE_BPE), rows), SentencePieceProcessor(model_file=PIECE_BPE)
    assert [np.frombuffer(b, "<u4").tolist() for part in pieces.groups(fuzz, 2000) for b in table.ids(fuzz[part])] == sp.encode(fuzz)


def test_a_chunk_is_encoded_once(spark):
    """Words that all parts share reach the encoder once for each slice of the hash, not once a part."""
    d = spark.createDataFrame([(i, f"shared words here {i}") for i in range(400)], "doc_id long, text string").repartition(8)
    calls = spark.sparkContext.accumulator(0)

    def scheme():
        own = chunks.byte_bpe(BYTE_BPE)

        def counted(part):
            calls.add(len([c for c in part if c]))
            return own.encode(part)

        return own._replace(encode=counted)

    def finish(part, documents):
        return pa.table([pa.array([len(ids) for _, _, ids in documents], pa.int64())], ["n"])

    assert chunks.token_ids(d, scheme, finish, "n long", 700).agg(F.sum("n")).first()[0] > 1200
    assert calls.value == 403


def test_sentencepiece_query(spark, sf):
    sp = SentencePieceProcessor(model_file=PIECE_BPE)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = op4_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_awkward_rows_round_trip(spark):
    d = awkward(spark)
    got = pieces.decode(pieces.encode(d, PIECE_BPE), PIECE_BPE).collect()
    assert Counter((r.doc_id, r.decoded) for r in got) == Counter((i, t or "") for i, t in ROWS)
    assert pieces.decode(pieces.encode(empty(spark), PIECE_BPE), PIECE_BPE).count() == 0
    assert packing.pack(empty(spark), BYTE_BPE).count() == 0


def check_packing(rows, texts, capacity=2048):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for i, x in texts)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    want = Counter()
    for (i, ids), many in left.items():
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += many
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for a, n in sorted(s):
            assert a == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_packing_query(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op2_best_fit_packing(spark, sf).collect()
    used = check_packing(rows, texts)
    assert used <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_awkward_rows(spark):
    check_packing(packing.pack(awkward(spark).repartition(3), BYTE_BPE).collect(), ROWS)


def test_reduction_loses_no_sequence():
    """Fixed sets are part of some best packing: no more sequences than the best that a search over all packings finds."""
    def fewest(items, capacity):
        best = len(items)

        def place(k, room):
            nonlocal best
            if len(room) >= best:
                return
            if k == len(items):
                best = len(room)
                return
            for i in {r: i for i, r in enumerate(room)}.values():
                if room[i] >= items[k]:
                    place(k + 1, [*room[:i], room[i] - items[k], *room[i + 1:]])
            place(k + 1, [*room, capacity - items[k]])
        place(0, [])
        return best

    rng = random.Random(2)
    for _ in range(150):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        fixed, left = packing.reduce_dominated(Counter(items), 20)
        rest = sorted((s for s, c in left.items() for _ in range(c)), reverse=True)
        assert sum(t for _, t in fixed) + fewest(rest, 20) == fewest(items, 20)
        used = Counter()
        for p, t in [*fixed, *packing.best_fit(left, 20)]:
            assert sum(s * n for s, n in p) <= 20
            for s, n in p:
                used[s] += n * t
        assert used == Counter(items)


def test_ranks_of_a_hot_length(spark):
    texts = [(i, "same words here") for i in range(500)] + [(i, f"word {i} " * (i % 7)) for i in range(500, 700)]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    check_packing(packing.pack(d, BYTE_BPE, capacity=16).collect(), texts, 16)
