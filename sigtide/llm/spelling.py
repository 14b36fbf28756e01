"""Spelling variants by permuterm rotations.

A word is marked with a terminator and rotated to every place. Two words differ in one replaced letter if their rotations behind that letter agree but
for the last character, and in one inserted letter if the shorter word's whole rotation is the longer one's without its last character. So each rotation goes out
whole and without its last character, and equal strings meet. A group holds one character each beside the whole rotation, so it is bounded by the
alphabet; neighbours are counted and the best is taken by ranks, without pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigtide.llm.common import stored

MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: A letter of a word is deleted where this divides the checksum of the document's id and the word.
DELETE_EVERY = 97
#: Distinct words of a task's table before it is emptied.
TABLE_ROWS = 1_000_000
#: A to Z in lower case, letters as they are (one byte each in Latin-1), all else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch], delete_every: int, min_length: int) -> Iterator[pa.RecordBatch]:
    """(id as text, text) to (word, n), summed in the task."""
    table: Counter[bytes] = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        words = list(table)
        for at in range(0, len(words), 100_000):
            some = words[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in some]), pa.array([table[w] for w in some], pa.int64())], ["word", "n"])

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
            start = crc32(f"{doc_id}:".encode())
            for word, n in own.items():
                if len(word) < min_length:
                    continue
                h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                if h % delete_every == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1:]
                    if len(word) < min_length:
                        continue
                table[word] += n
        if len(table) > TABLE_ROWS:
            yield from rows()
            table.clear()
    yield from rows()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_COUNT, min_length: int = MIN_LENGTH,
                delete_every: int = DELETE_EVERY) -> DataFrame:
    """(word, n): the distinct runs of letters, made by the spelling rule, of ``min_length`` code points and ``least`` occurrences."""
    d = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    d = d.mapInArrow(partial(_counted, delete_every=delete_every, min_length=min_length), "word string, n long")
    return d.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, near): how many words are one edit away, and the one of them with the largest count (ties: the smallest). Words without any are left out."""
    size = F.length("word")
    r = words.select("word", "n", F.posexplode(F.sequence(F.lit(0), size)).alias("at", "i"))
    rest, head = F.expr("substring(word, i + 1)"), F.expr("substring(word, 1, i)")
    whole = r.select("word", "n", F.concat(rest, F.lit("$"), head).alias("key"), F.lit(True).alias("whole"), F.lit(False).alias("first"))
    # Of a run of one letter the first is the one that is left out, so that a pair counts once.
    first = F.expr("i = 0 or substring(word, i, 1) <> substring(word, i + 1, 1)")
    short = r.where(F.col("i") < size).select("word", "n", F.concat(F.expr("substring(word, i + 2)"), F.lit("$"), head).alias("key"), F.lit(False).alias("whole"), first.alias("first"))
    same = Window.partitionBy("key")
    best = same.orderBy(F.desc("n"), "word")
    g = whole.union(short).select("*", F.count("*").over(same).alias("size"), F.count_if("whole").over(same).alias("wholes"), F.count_if("first").over(same).alias("firsts"),
                                  F.row_number().over(best).alias("rank"), F.struct(-F.col("n"), "word").alias("own"))
    g = g.where("size > 1").withColumn("top", F.first("own").over(best)).withColumn("next", F.lead("own").over(best))
    near = F.when(F.col("whole"), F.col("firsts")).otherwise(F.col("size") - F.col("wholes") - 1 + F.when(F.col("first"), F.col("wholes")).otherwise(0))
    g = g.select("word", near.alias("near"), F.when(F.col("rank") == 1, F.col("next")).otherwise(F.col("top")).alias("other"))
    g = g.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("other").alias("other"))
    return g.select("word", "n_near", (-F.col("other").getField("col1")).alias("form_n"), F.col("other.word").alias("near"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n) to word, form, root, n, n_near, form_n."""
    w = words.join(neighbours(words), "word", "left")
    is_form = F.col("form_n") >= ratio * F.col("n")
    w = w.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    w = stored(w, "variants")
    # Counts at least double from word to form, so chains end and are short; each round doubles the way that is followed.
    steps = stored(w.where("form is not null").select("word", F.col("form").alias("root")), "steps")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stored(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "steps")
        steps = longer.select("word", "root")
        if not longer.where("moved").limit(1).count():
            break
    return w.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_COUNT, min_length: int = MIN_LENGTH) -> DataFrame:
    """Per word of the corpus: word, form (its near word of largest count, if that is at least twice its own), root (the last form), n, n_near, form_n.

    Words are runs of letters of A-Z and U+00C0 to U+00FF, A-Z in lower case; where 97 divides the checksum of ``id:word``, one letter is left out. Null texts have no
    words; a null id is empty in the checksum. Repeated rows count as often as they come; other columns are ignored; a table without
    such words gives no rows.
    """
    return variants(stored(word_counts(docs, id_col, text_col, least, min_length), "words"))
