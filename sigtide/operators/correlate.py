"""Correlations between signals, features and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.session import fan_out


def pair_corr(df: DataFrame, keys: list[str], xs: list[str], ys: list[str], x_name: str, y_name: str) -> DataFrame:
    """Pearson r of every x column with every y column, per key: (keys, x_name, y_name, n, r).

    Both sides turn into rows, so the aggregation stays narrow however many pairs there are, and the
    partial moments merge on the map side. Null when either column of a pair is constant.
    """
    def entries(cols: list[str]) -> Column:
        return F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("v")) for c in cols])

    pairs = (fan_out(df.select(*keys, *xs, *[F.col(f"`{y}`") for y in ys])).select(*keys, entries(ys).alias("_ys"), F.explode(entries(xs)).alias("_x"))
             .select(*keys, "_x", F.explode("_ys").alias("_y"))
             .select(*keys, F.col("_x.name").alias(x_name), F.col("_y.name").alias(y_name), F.col("_x.v").alias("x"), F.col("_y.v").alias("y"))
             .filter(F.col("x").isNotNull() & F.col("y").isNotNull()))
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    r = F.when((F.stddev_pop("x") > 1e-12) & (F.stddev_pop("y") > 1e-12), F.try_divide(F.covar_pop("x", "y"), spread))
    return pairs.groupBy(*keys, x_name, y_name).agg(F.count("*").alias("n"), r.alias("r"))


def feature_outcome_corr(dataset: DataFrame, keys: list[str], features: list[str], outcomes: list[str]) -> DataFrame:
    """Pearson r of every feature with every outcome: long form (keys, feature, outcome, r)."""
    return pair_corr(dataset, keys, features, outcomes, "feature", "outcome").drop("n")


def lagged_corr(daily: DataFrame, keys: list[str], signals: list[str] = K.SIGNALS, target: str = "inc_count",
                max_lag: int = K.MAX_LAG) -> DataFrame:
    """Pearson r of each signal on day D with the target on day D+lag, lag -max..max.

    Null below ten pairs or for a constant series. The frame has no gaps, so a lag is a row offset.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    lags = range(-max_lag, max_lag + 1)
    shifted = daily.select(*keys, *signals, *[F.lead(target, lag).over(w).alias(str(lag)) for lag in lags])
    r = pair_corr(shifted, keys, signals, [str(lag) for lag in lags], "feature", "lag")
    return r.select(*keys, "feature", F.col("lag").cast("int").alias("lag"), F.col("n").alias("n_pairs"),
                    F.when(F.col("n") >= K.MIN_LAG_PAIRS, F.col("r")).alias("pearson_r"))


def best_positive_lag(ccf: DataFrame, keys: list[str]) -> DataFrame:
    """Strongest absolute correlation over lags > 0 per feature; the shorter lag wins ties."""
    rank = F.struct(F.abs("pearson_r"), -F.col("lag"))
    usable = (F.col("lag") > 0) & F.col("pearson_r").isNotNull()
    best = F.max_by(F.when(usable, F.struct("lag", "pearson_r")), F.when(usable, rank))
    return ccf.groupBy(*keys, "feature").agg(best.alias("b")).select(
        *keys, "feature", F.col("b.lag").alias("best_lag"), F.col("b.pearson_r").alias("pearson_r"))
