"""Table sinks. Paths belong on storage every executor can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sigtide.operators.merge import upsert


def write_csv(df: DataFrame, path: str) -> None:
    """Full overwrite; one file per task, each with its header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str, partition: str = "run_date") -> None:
    df.write.mode("append").partitionBy(partition).parquet(path)


def save_bank(models: DataFrame, path: str, version: str) -> None:
    """One folder per version, so an earlier bank stays readable; rows carry the time of saving."""
    models.withColumns({"version": F.lit(version), "saved_at": F.current_timestamp()}).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load_bank(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """A saved bank, by default the version saved last, whatever its name. Version names are text, never numbers or dates."""
    bank = spark.read.parquet(path)
    bank = bank.withColumn("version", F.col("version").cast("string"))
    wanted = bank.agg(F.max_by("version", "saved_at")).scalar() if version is None else F.lit(version)
    return bank.filter(F.col("version") == wanted).drop("version", "saved_at")


def upsert_signals(spark: SparkSession, path: str, updates: DataFrame, keys: list[str] = ("date", "channel")) -> None:
    """Upsert into a table partitioned by date: only the dates of the update are read and rewritten."""
    from pyspark.errors import AnalysisException
    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # a table that is there but cannot be read must not be overwritten
            raise
        table = None
    out = updates
    if table is not None:
        old = table.join(updates.select("date").distinct(), "date", "left_semi").select(*updates.columns)
        out = upsert(old, updates, list(keys))
    (out.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date").parquet(path))
