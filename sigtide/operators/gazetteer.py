"""A dictionary of plain substrings, aliases of areas and patterns of named sites, as a table of any length.

A message is searched once, with an automaton of all patterns. What it holds of them becomes a small array column, and every detector
on its sentences and segments looks into that column alone. So neither the plan nor the work on a sentence grows with the dictionary, there
is no shuffle, and a stream stays stateless.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtide.functions import text as tx
from sigtide.rules import RulePack

#: Patterns of a file. A worker holds the automaton of one file at a time, however long the dictionary is.
FILE_ROWS = 200_000
#: Texts whose hits are Python objects at a time; the rest of a batch waits as references or is Arrow already.
PART_ROWS = 100
_AREA, _SITE = pa.struct([("pattern", pa.string()), ("label", pa.string())]), pa.struct(
    [("pattern", pa.string()), ("label", pa.string()), ("type", pa.string()), ("named", pa.bool_())])
_KNOWN = pa.struct([("areas", pa.list_(_AREA)), ("sites", pa.list_(_SITE))])
_KNOWN_SQL = ("struct<areas: array<struct<pattern: string, label: string>>, "
              "sites: array<struct<pattern: string, label: string, type: string, named: boolean>>>")


@dataclass(frozen=True)
class Dictionary:
    """Patterns stored in a folder that all executors can read, by ``write_dictionary``."""

    folder: str


def write_dictionary(folder: str, aliases: DataFrame, sites: DataFrame | None = None, file_rows: int = FILE_ROWS) -> Dictionary:
    """Store aliases (alias, area, prio) and sites (label, type, pattern, prio).

    Null and empty patterns are left out, repeated rows count once. A label that comes with several types keeps that of its lowest
    (prio, type); patterns of the others only tell that a text names a target. Patterns with regex characters are taken as they are written.
    """
    a = aliases.select(F.lit(True).alias("is_area"), F.col("alias").alias("pattern"), F.col("area").alias("label"),
                       F.lit(None).cast("string").alias("type"), F.lit(True).alias("named"), F.col("prio").cast("long").alias("prio"))
    rows = a
    if sites is not None:
        first = sites.groupBy("label").agg(F.min(F.struct("prio", "type")).alias("_first"))
        rows = a.union(sites.join(first, "label").select(
            F.lit(False), "pattern", "label", "type", F.col("type") == F.col("_first.type"), F.col("_first.prio").cast("long")))
    kept = rows.filter(F.length("pattern") > 0).distinct()
    kept.write.option("maxRecordsPerFile", file_rows).parquet(folder)
    return Dictionary(folder)


def split_rules(folder: str, rules: DataFrame, gazetteer: DataFrame, areas: DataFrame, **extra) -> tuple[RulePack, Dictionary]:
    """``RulePack.from_tables`` without its aliases and sites, which become a dictionary, as many as there are.

    Patterns of sites are then plain substrings; one with regex characters is an error. Macro areas are joined (``areas.with_macro_area``), so
    the pack holds none.
    """
    of_site = F.col("rule_group").startswith("site:")
    sites = rules.filter(of_site).select("label", F.expr("substring(rule_group, 6)").alias("type"), "pattern", "prio")
    if not sites.filter(F.col("pattern").rlike(r"[.^$*+?{}\[\]|()\\]")).isEmpty():
        raise ValueError("patterns of sites in a dictionary are plain substrings")
    pack = RulePack.from_tables(rules.filter(~of_site), gazetteer.limit(0), areas.limit(0), **extra)
    return pack, write_dictionary(folder, gazetteer, sites)


class _Shard:
    """The automaton of one file."""

    def __init__(self, path: str, files: pyarrow.fs.FileSystem):
        import ahocorasick

        self.rows: dict[str, list[tuple]] = {}
        for r in pq.ParquetFile(files.open_input_file(path)).read().to_pylist():
            hit = r["pattern"], (r["is_area"], r["prio"] or 0, r["label"], r["type"], r["named"])
            self.rows.setdefault(r["pattern"], []).append(hit)
        self.search = ahocorasick.Automaton()
        for p in self.rows:
            self.search.add_word(p, p)
        self.search.make_automaton()

    def found(self, text: str) -> set[str]:
        return {p for _, p in self.search.iter(text)} if self.rows else set()


def _shards(folder: str) -> Iterator[_Shard]:
    files, path = pyarrow.fs.FileSystem.from_uri(folder) if ":" in folder else (pyarrow.fs.LocalFileSystem(), folder)
    for f in sorted(files.get_file_info(pyarrow.fs.FileSelector(path)), key=lambda f: f.path):
        if f.base_name.endswith(".parquet") and f.base_name[0] not in "._":
            yield _Shard(f.path, files)


def _ordered(hits: list[tuple]) -> dict:
    areas = sorted((-len(p), prio, p, label or "", label) for p, (is_area, prio, label, _, _) in hits if is_area)
    sites = sorted((prio, label or "", kind or "", p, named, label, kind) for p, (is_area, prio, label, kind, named) in hits if not is_area)
    return {"areas": [{"pattern": p, "label": label} for _, _, p, _, label in areas],
            "sites": [{"pattern": p, "label": label, "type": kind, "named": named} for _, _, _, p, named, label, kind in sites]}


def _to_arrow(hits: list[list[tuple]]) -> pa.Array:
    """The ordered hits of texts, PART_ROWS of them as Python objects at a time."""
    parts = [pa.array([_ordered(h) for h in hits[k:k + PART_ROWS]], _KNOWN) for k in range(0, max(len(hits), 1), PART_ROWS)]
    return pa.concat_arrays(parts)


def known(dictionary: Dictionary, text: Column) -> Column:
    """What a text holds of a dictionary: struct of ``areas`` (longest first, then by prio) and ``sites`` (by prio). Null: nothing."""
    folder = dictionary.folder

    @F.arrow_udf(_KNOWN_SQL)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = None
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            hits: list[list[tuple]] = [[] for _ in texts]
            n = 0
            for n, shard in enumerate([one] if one else _shards(folder), 1):
                for own, t in zip(hits, texts, strict=True):
                    own += [hit for p in shard.found(t) for hit in shard.rows[p]]  # the shard's own tuples, no copies
                last = shard
            one = last if n == 1 else None
            yield _to_arrow(hits)

    return search(text)


def search_text(sentences: Column, low: Column) -> Column:
    """A lower-cased message, then its joined sentences, as segments have them, where they differ from it. Null sentences: null."""
    joined = tx.bind(F.array_join(sentences, " "), tx.relower)
    both = tx.bind(joined, lambda j: F.when((F.size(sentences) > 1) & (j != low), F.concat(low, F.lit("\n\n"), j)).otherwise(low))
    return F.when(sentences.isNotNull(), both)
