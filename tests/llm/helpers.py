"""Awkward rows that every operator on documents must take."""

from __future__ import annotations

#: Columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, key string, spans string, fp long, score double, label int, st_key string, st_row string"
EXTRA = ("k", "s", 1, 0.5, 1, "a", "b")
LONG = "Lorem dolor sit amet consectetur. " * 30_000
ROWS = [(1, None), (2, ""), (2, ""), (None, "one two three."), (4, " \t\n"), (5, LONG), (6, "tie tie tie"), (7, "tie tie tie"), (None, None), (8, "Ünïcode 😀 naïve　text\r\nend")]


def awkward(spark):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in ROWS], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
