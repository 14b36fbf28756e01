"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide.session import work_dir

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator works on, under fixed names; a null text is empty."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame has not, for columns an operator adds for its own use."""
    taken = {c.lower() for c in df.columns}
    return [n if n not in taken else f"{n}_{uuid.uuid4().hex[:8]}" for n in (f"st_{n}" for n in names)]


def row_key(doc_id: str | Column, text: str | Column) -> Column:
    """128 bits that identify a document's id and text; equal rows share it."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    seen = F.coalesce(a.cast("string"), F.lit("\x00none"))
    return F.concat(F.lpad(F.hex(F.xxhash64(seen, b)), 16, "0"), F.lpad(F.hex(F.xxhash64(b, F.lit(7), seen)), 16, "0"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, outlives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions())


def bucketed(df: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
    """Write to the shared folder in buckets of ``key`` and read back: later groupings and cogroupings by ``key`` need no shuffle of it.

    Give ``buckets`` for a plan with shuffles: asking such a plan for its partitions runs them, and the write would run them again.

    The table's name lives in the session's catalogue only while it is looked up; the files stay, as those of ``stored``.
    """
    spark = df.sparkSession
    buckets = buckets or bucket_count(df)
    label = f"{name}_{uuid.uuid4().hex}"
    (df.write.bucketBy(min(buckets, 100_000), key).option("path", work_dir(spark, name)).option("compression", "zstd").saveAsTable(label))
    out = spark.table(label)
    spark.sql(f"DROP TABLE {label}")
    return out


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components: columns ``node`` and ``root`` (its component's smallest node), nodes with an edge only.

    Alternates large-star and small-star rounds until no edge changes; each round is a grouped minimum and an
    equi-join, so a hub is split by adaptive execution and never gathered. Every round is a table in the shared folder.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    e = stored(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.union(low.select("a", F.col("m").alias("b"))).distinct()
        e = stored(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())


def sample_ids(labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """A bounded, repeatable training sample: of each class the ``per_class`` ids with the smallest hash.

    Works on (id, label) alone. Ids without a label drop out; an id labelled both ways counts as positive.
    """
    one = (labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
           .where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")))
    pick: Sequence[DataFrame] = [one.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(per_class)
                                 for k in (0, 1)]
    return pick[0].union(pick[1])


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; 1 marks the held-out rows. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3, F.lit(0))
