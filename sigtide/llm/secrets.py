"""Incremental secret scans over a blob ledger.

Every historical version of a path is addressed by the digest of its content. A ledger table holds which blob was scanned
under which rule version, a findings table what was found. A scan takes the (blob, rule version) pairs that the ledger lacks,
elects one carrier row for each unseen blob, scans the carriers' texts alone, appends to both tables and joins the findings back to
every path. Copies, however many, are scanned once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sigtide.llm.common import row_key, stored, work_dir

Span = tuple[str, int, int]


@dataclass(frozen=True)
class Rule:
    """One kind of secret. ``ready`` says cheaply whether a text (in small letters) can hold it; change ``version`` with the pattern."""

    kind: str
    version: int
    pattern: re.Pattern
    keep: Callable[[re.Match], bool]
    ready: Callable[[str], bool]


RULES = (
    Rule("assign", 1, re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
         lambda m: len(m[2]) >= 8, lambda low: any(w in low for w in ("passw", "secret", "token", "api"))),
    Rule("access", 1, re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16, lambda low: "akia" in low),
    # A run of fewer digits has no match inside it either, so the length may stand in the pattern.
    Rule("hex", 1, re.compile(r"[0-9a-f]{32,}"), lambda m: True, lambda low: True),
    Rule("pem", 1, re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
         lambda m: True, lambda low: "private key-----" in low),
    Rule("jwt", 1, re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), lambda m: True, lambda low: "eyj" in low),
)
BASE = ("assign", "access", "hex")
FINDING = "blob string, kind string, version int, start int, stop int"


def find(text: str, kinds: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """(kind, version, start, stop) of every secret of the given kinds, in code points."""
    low = text.lower()
    return [(r.kind, r.version, m.start(), m.end()) for r in RULES if kinds.get(r.kind) == r.version and r.ready(low)
            for m in r.pattern.finditer(text) if r.keep(m)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blob, text, kinds to scan) to findings, and one row without a kind for each scanned (blob, rule)."""
    for b in batches:
        rows = []
        for blob, text, todo in zip(*(c for c in b.columns), strict=True):
            kinds = {x["kind"]: x["version"] for x in todo.as_py()}
            rows += [(blob.as_py(), *f) for f in find(text.as_py(), kinds)]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["blob", "kind", "version", "start", "stop"])


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger table, empty where nothing was written yet; every other error is an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def blobs(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """path, text (null: empty), blob (SHA-256 of the content) and a key of the row."""
    v = versions.select(F.col(f"`{path_col}`").alias("path"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    v = v.withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    return v.withColumn("key", row_key("path", F.col("blob")))


def scan(versions: DataFrame, ledger: str, path_col: str = "path", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger folder has not; return (paths, findings): every (path, blob) row, and all findings of its rules' versions.

    ``versions``: one row per path and historical version; more columns are ignored. Null texts are empty blobs, null paths and
    repeated rows are rows like others, equal contents share one scan. An empty table scans nothing. A run that dies before its
    ledger entries are written is repeated by the next one; findings then count once, as they are read distinct.
    """
    spark = versions.sparkSession
    v = blobs(versions, path_col, text_col)
    paths = stored(v.select("path", "blob", "key"), "paths")
    wanted = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    known = _read(spark, f"{ledger}/scanned", "blob string, rules array<struct<kind:string,version:int>>")
    known = known.select("blob", F.explode("rules").alias("r")).groupBy("blob").agg(F.collect_set("r").alias("had"))  # a few rules a blob
    todo = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    one = paths.groupBy("blob").agg(F.min("key").alias("key")).join(known, "blob", "left")
    none = F.array().cast("array<struct<kind:string,version:int>>")
    one = one.withColumn("rules", F.array_except(todo, F.coalesce("had", none))).where(F.size("rules") > 0).select("blob", "key", "rules")
    one = stored(one, "unseen")
    carriers = v.select("key", "text").join(one, "key")
    carriers.select("blob", "text", "rules").mapInArrow(_scan, FINDING).write.mode("append").parquet(f"{ledger}/findings")
    one.select("blob", "rules").write.mode("append").parquet(f"{ledger}/scanned")
    # Rows that repeat a path and its content carry it more than once.
    found = spark.read.schema(FINDING).parquet(f"{ledger}/findings").distinct().join(F.broadcast(wanted), ["kind", "version"])
    return paths.select("path", "blob"), found


def spans_by_path(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """path, and its findings as an array of (start, rank of the kind, kind, stop) in order; empty where nothing was found."""
    rank = F.element_at(F.create_map(*[x for i, r in enumerate(RULES) for x in (F.lit(r.kind), F.lit(i))]), F.col("kind"))
    by_blob = findings.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "stop"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>")
    return paths.join(by_blob, "blob", "left").select("path", F.coalesce("spans", none).alias("spans"))


def new_ledger(spark: SparkSession) -> str:
    return work_dir(spark, "blob-ledger")
