"""Nearest historical analogues: which past windows look like the current one, and what followed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions import scoring
from sigtide.operators import features as ft


def nearest_vectors(vectors: DataFrame, query: Column, vector: str, k: int) -> DataFrame:
    """The k rows nearest to one query vector: a narrow distance and a top-k per task, no shuffle of the table."""
    return (vectors.withColumn("_q", query).withColumn("dist", scoring.euclidean(F.col(vector), F.col("_q"))).drop("_q")
            .orderBy("dist", vectors.columns[0]).limit(k))


def window_distances(daily: DataFrame, keys: list[str], lookback: int, few_series: bool = False) -> DataFrame:
    """Distance of every past window to the current one of its series, in scaled feature space.

    The means cancel in a difference, so the deviation of each feature over the past windows and the
    current vector are all it takes. Both come from windows over the series the features are already
    partitioned by: one pass and no join, and no further shuffle unless ``few_series`` spreads the rows.
    """
    feats = ft.feature_names()
    rows = ft.build_features(ft.with_next_day(daily, keys), keys, [lookback], few_series=few_series)
    is_query = F.col("row_no") == F.col("n_rows")
    series = Window.partitionBy(*keys)
    vector = F.array(*[F.col(f) for f in feats])
    current = F.max(F.when(is_query, F.struct(vector.alias("v")))).over(series)["v"]
    spread = F.array(*[F.stddev_pop(F.when(~is_query, F.col(f))).over(series) for f in feats])
    triples = F.arrays_zip("_x", "_q", "_s")
    parts = F.transform(triples, lambda t: (t["_x"] - t["_q"]) / F.when(t["_s"] > 1e-9, t["_s"]).otherwise(1.0))
    return (
        rows.withColumns({"_x": vector, "_q": current, "_s": spread})
        .select(*keys, "date", "row_no", (F.col("n_rows") - 1).alias("n_days"), is_query.alias("is_query"), parts.alias("_d"))
        .withColumn("dist", F.sqrt(F.aggregate("_d", F.lit(0.0), lambda acc, v: acc + v * v)))
        .filter(~F.col("is_query")).drop("is_query", "_d")
    )


def find_analogs(daily: DataFrame, keys: list[str], lookback: int = K.ANALOG_LOOKBACK, k: int = K.ANALOG_K,
                 horizon: int = K.ANALOG_HORIZON, few_series: bool = False) -> DataFrame:
    """The k past windows of each series nearest to its current one, with similarity.

    Windows without a full horizon behind them are left out. Similarity is 1 - d / (largest of the k).
    """
    past = window_distances(daily, keys, lookback, few_series).filter(F.col("row_no") <= F.col("n_days") - horizon)
    w = Window.partitionBy(*keys).orderBy("dist", "date")
    top = past.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    largest = F.max("dist").over(Window.partitionBy(*keys)) + 1e-9
    return top.select(*keys, "date", "rank", "dist", (1 - F.col("dist") / largest).alias("similarity"))


def following_days(analogs: DataFrame, horizon: int = K.ANALOG_HORIZON) -> DataFrame:
    """The days 1..horizon after each anchor, ready for an equi-join on the date."""
    rest = [c for c in analogs.columns if c != "date"]
    return analogs.select(
        *rest, F.col("date").alias("anchor"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("offset")
    ).withColumn("date", F.date_add("anchor", F.col("offset")))


def what_followed(analogs: DataFrame, daily: DataFrame, keys: list[str], horizon: int = K.ANALOG_HORIZON) -> DataFrame:
    """Per anchor: days to the next incident, fire and hit flags, the farthest reach."""
    days = daily.select(*keys, "date", "inc_count", "fire_count", "hit_count", "reach_score")
    after = following_days(analogs, horizon).join(days, [*keys, "date"], "left")
    rest = [c for c in analogs.columns if c != "date"]
    return after.groupBy(*rest, "anchor").agg(
        F.min(F.when(F.col("inc_count") > 0, F.col("offset"))).alias("days_to_next"),
        F.coalesce(F.max("fire_count") > 0, F.lit(False)).alias("fire"),
        F.coalesce(F.max("hit_count") > 0, F.lit(False)).alias("hit"),
        F.coalesce(F.max("reach_score"), F.lit(0)).alias("max_reach")).withColumnRenamed("anchor", "date")


def analog_summary(followed: DataFrame, keys: list[str]) -> DataFrame:
    """Median and quartiles of the days to the next incident, and the shares of what followed."""
    days = F.col("days_to_next")
    quartile = lambda q: F.when(F.count(days) >= 2, F.percentile(days, F.lit(q)))
    share = lambda c: F.avg(c.cast("double"))
    return followed.groupBy(*keys).agg(
        F.percentile(days, F.lit(0.5)).alias("days_estimate"), quartile(0.25).alias("days_p25"), quartile(0.75).alias("days_p75"),
        share(F.col("fire")).alias("fire_rate"), share(F.col("hit")).alias("hit_rate"),
        share(F.col("max_reach") >= 3).alias("far_rate"), F.count(days).alias("n_with_incidents"), F.count("*").alias("k"))


def following_distribution(analogs: DataFrame, occurrences: DataFrame, keys: list[str], value: str, top: int = 5,
                           horizon: int = K.ANALOG_HORIZON) -> DataFrame:
    """Share of each value (macro area, site type) among what followed, the ``top`` most frequent.

    Occurrences shrink to one count per (series, date, value) before the join.
    """
    counts = occurrences.groupBy(*keys, "date", value).agg(F.count("*").alias("_n"))
    hits = following_days(analogs, horizon).join(counts, [*keys, "date"])
    return top_shares(hits.groupBy(*keys, value).agg(F.sum("_n").alias("n")), keys, value, top)


def top_shares(counts: DataFrame, keys: list[str], value: str, top: int = 5) -> DataFrame:
    """Counts to shares of their key total, the ``top`` largest; equal counts go by name."""
    w = Window.partitionBy(*keys)
    return (
        counts.filter(F.col(value).isNotNull())
        .withColumn("share", F.col("n") / F.sum("n").over(w))
        .withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), value)))
        .filter(F.col("rank") <= top)
    )
