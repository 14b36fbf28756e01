"""One forecast run: a bank's scores to tiers, bands, a document per series and the logs, written once per run.

A log is a Parquet table partitioned by run. Rows of a run that are there are not written again, so a run that is repeated, or that
was broken off, adds what is missing; a ledger row, written last, makes the run visible to readers.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide.operators import summary
from sigtide.session import materialise

LOGS = {
    "predictions": ["band", "dimension", "outcome", "lookback", "horizon"],
    "models": ["outcome", "lookback", "horizon"],
    "documents": [],
}


def append_run(df: DataFrame, path: str, run_id: str, keys: list[str]) -> None:
    """Add the rows of one run that its partition of the log lacks; rows are known by ``keys``. Repeated keys in ``df`` count once.

    A partitioned write of no rows leaves no file, so the columns of a log without rows are kept beside it.
    """
    spark, fresh = df.sparkSession, df.dropDuplicates(keys).withColumn("run_id", F.lit(run_id))
    try:
        landed = spark.read.option("mergeSchema", False).parquet(path).where(F.col("run_id").cast("string") == run_id)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        fresh.limit(0).write.mode("overwrite").parquet(f"{path}_schema")
    else:
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
        fresh = fresh.alias("n").join(landed.select(*keys).alias("o"), same, "left_anti")
    fresh.write.mode("append").partitionBy("run_id").parquet(path)


def run_forecast(scores: DataFrame, bank: DataFrame, dimensions: DataFrame, folder: str, run_id: str, keys: list[str], mode: str = "medium") -> None:
    """Write one run: ``scores`` of the models in ``bank`` as passing signals, a document per series and a row per trained model.

    Scores without a probability give no signal; a series without a passing signal has a document of level NONE. An empty bank gives empty logs
    and a run of no rows. Numbers in the logs are rounded to four places.
    """
    signals = materialise(summary.forecast_signals(scores, dimensions, mode), "signals")
    document = materialise(summary.forecast_document(signals, keys), "document")
    logs = {"predictions": summary.prediction_log(document, keys), "models": summary.auc_log(bank, keys),
            "documents": document.select(*keys, "warning", "n_passing", "n_high", "n_medium", "json")}
    for name, own in LOGS.items():
        append_run(logs[name], f"{folder}/{name}", run_id, [*keys, *own])
    done = document.agg(F.count("*").alias("n_series"), F.coalesce(F.sum("n_passing"), F.lit(0)).alias("n_passing"))
    append_run(done.withColumn("finished_at", F.current_timestamp()), f"{folder}/runs", run_id, ["n_series"])


def finished_runs(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, finished_at: the first time that a run was finished."""
    runs = spark.read.parquet(f"{folder}/runs").withColumn("run_id", F.col("run_id").cast("string"))
    return runs.groupBy("run_id").agg(F.min("finished_at").alias("finished_at"))


def read_log(spark: SparkSession, folder: str, name: str, run_id: str | None = None) -> DataFrame:
    """A log's rows of finished runs, or of one of them."""
    try:
        log = spark.read.parquet(f"{folder}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        log = spark.read.parquet(f"{folder}/{name}_schema")  # no run has had rows
    log = log.withColumn("run_id", F.col("run_id").cast("string"))
    if run_id is not None:
        log = log.where(F.col("run_id") == run_id)
    return log.join(finished_runs(spark, folder).select("run_id"), "run_id", "left_semi")


def bank_age(spark: SparkSession, folder: str, analysed: DataFrame, keys: list[str]) -> DataFrame:
    """Freshness of each series from the runs that hold its models. ``analysed``: keys, at."""
    trained = read_log(spark, folder, "models").join(finished_runs(spark, folder), "run_id").select(*keys, F.col("finished_at").alias("at"))
    return summary.freshness(analysed, trained, keys)
