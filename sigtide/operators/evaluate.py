"""Evaluation: time-ordered folds, ROC-AUC, classification metrics, quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions import scoring

_CUTS = 64


def time_folds(df: DataFrame, keys: list[str], order: str = "date", splits: int = K.CV_SPLITS) -> DataFrame:
    """Rows with ``fold``: 0 before the first test block, k inside test block k.

    Test blocks have n // (splits + 1) rows at the end of the series. Fold k trains on all rows
    with a smaller fold number.
    """
    w = Window.partitionBy(*keys)
    n, rn = F.count("*").over(w), F.row_number().over(w.orderBy(order))
    size = F.floor(n / (splits + 1))
    into = rn - 1 - (n - size * splits)
    return df.withColumn("fold", F.when(into < 0, 0).otherwise(F.floor(into / size) + 1).cast("int"))


def fold_sizes(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Train and test rows of each fold."""
    per = folds.groupBy(*keys, "fold").agg(F.count("*").alias("n_test"))
    before = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("n_train", F.sum("n_test").over(before)).filter(F.col("fold") > 0)


def roc_auc(df: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    """Exact ROC-AUC per key: probability that a positive outranks a negative, ties half.

    Equal scores collapse first. The distinct scores then rank inside up to 65 score ranges per key,
    each its own window partition, and the ranges combine through running totals of at most 65 rows.
    A single global AUC thus spreads over the cluster as well. Null when one class is missing.
    """
    counts = (df.filter(F.col(score).isNotNull()).groupBy(*keys, score)
              .agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_q")))
    marks = [i / _CUTS for i in range(1, _CUTS)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(score, marks, 1000).alias("_cuts"))
    bucket = F.size(F.filter("_cuts", lambda c: c < F.col(score)))
    if keys:
        ranged = counts.join(cuts, keys)
    else:
        ranged = counts.withColumn("_cuts", cuts.scalar())
    ranged = ranged.select(*keys, F.col(score), "_p", "_q", bucket.alias("_b"))
    inside = Window.partitionBy(*keys, "_b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_q").over(inside), F.lit(0))
    per_range = (
        ranged.withColumn("_wins", F.col("_p") * (below + F.col("_q") / 2))
        .groupBy(*keys, "_b").agg(F.sum("_wins").alias("_wins"), F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    )
    lower = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_q").over(lower), F.lit(0))
    totals = per_range.withColumn("_wins", F.col("_wins") + F.col("_p") * base).groupBy(*keys).agg(
        F.sum("_wins").alias("_wins"), F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_wins") / (F.col("n_pos") * F.col("n_neg")))
    return totals.select(*keys, auc.alias("auc"), "n_pos", "n_neg")


def class_metrics(df: DataFrame, predicted: Column, label: Column, keys: list[str]) -> DataFrame:
    """F1 (0 when undefined), positive rate and accuracy."""
    hit = F.count_if(predicted & (label == 1))
    called, positive = F.count_if(predicted), F.count_if(label == 1)
    f1 = F.when(called + positive > 0, 2 * hit / (called + positive)).otherwise(0.0)
    return df.groupBy(*keys).agg(
        f1.alias("f1"), (positive / F.count("*")).alias("pos_rate"),
        (F.count_if(predicted == (label == 1)) / F.count("*")).alias("accuracy"), F.count("*").alias("n"))


def fold_summary(folds: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Fold metrics to mean and population deviation."""
    return folds.groupBy(*keys).agg(
        F.avg(metric).alias(metric), F.stddev_pop(metric).alias(f"{metric}_std"), F.count(metric).alias("n_folds"))


# ── quality gates over grid results ───────────────────────────────────────────

def with_rejection(grid: DataFrame) -> DataFrame:
    return grid.withColumn("rejected", scoring.rejection(
        F.col("auc"), F.col("pos_rate"), F.col("auc_std"), F.col("lift")))


def _number(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def select_configs(grid: DataFrame, keys: list[str], n: int = K.TOP_COMBOS) -> DataFrame:
    """Up to n configurations per key through three tiers of gates.

    1: all gates, by AUC. 2: without the deviation gate, restricted to the smallest horizon bound that
    has any. 3: by AUC minus deviation. A key uses the first tier that yields something.
    """
    g = with_rejection(grid)
    auc, lift = _number("auc"), _number("lift")
    tier1 = F.col("rejected").isNull()
    tier2 = ((F.coalesce("pos_rate", F.lit(1.0)) <= K.MAX_POS_RATE) & (F.coalesce(auc, F.lit(0.0)) >= K.MIN_AUC)
             & (F.coalesce(lift, F.lit(K.MIN_LIFT)) >= K.MIN_LIFT))
    conservative = auc - _number("auc_std")
    w = Window.partitionBy(*keys)
    has1 = F.max(tier1.cast("int")).over(w) == 1
    least_h = F.min(F.when(tier2, F.col("horizon"))).over(w)
    tier = (F.when(has1, F.when(tier1, 1))
             .when(least_h.isNotNull(), F.when(tier2 & (F.col("horizon") <= least_h), 2))
             .otherwise(F.when(conservative.isNotNull(), 3)))
    ranked = (g.withColumn("tier", tier).filter(F.col("tier").isNotNull())
              .withColumn("_score", F.when(F.col("tier") == 3, conservative).otherwise(auc)))
    order = w.orderBy(F.desc("_score"), "lookback", "horizon")
    return (ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
            .drop("_score", "rejected"))


def best_params(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Best (lookback, horizon) per key by four tiers; ties go to the smaller lookback, then horizon."""
    auc, std = _number("auc"), _number("auc_std")
    ok = auc >= K.MIN_AUC
    learnable = ok & (F.col("pos_rate") <= K.MAX_POS_RATE)
    tier = (F.when(learnable & (std <= K.MAX_AUC_STD), 1).when(learnable, 2).when(ok, 3).otherwise(4))
    usable = grid.filter(auc.isNotNull() & (F.col("n_folds") >= 2)).withColumn("tier", tier)
    rank = F.struct(-F.col("tier"), F.col("auc"), -F.col("lookback"), -F.col("horizon"))
    best = F.max_by(F.struct("lookback", "horizon", "auc", "auc_std", "tier"), rank)
    return usable.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def bank_configs(grid: DataFrame, keys: list[str], horizons: list[int] = K.FORECAST_HORIZONS, fixed: list[dict] = K.PREDICTOR_CONFIGS) -> DataFrame:
    """Distinct (keys, outcome, lookback, horizon) that a bank is trained on, as the grid finds them for each series.

    Per outcome and forecast horizon the lookback with the highest AUC (all folds before some, some before none; ties go to the smaller, so that
    an outcome nobody could score has its row as well), per outcome the best parameters, and the fixed configurations.
    """
    auc = F.coalesce(_number("auc"), F.lit(-1.0))
    rank = F.struct((F.col("n_folds") >= K.CV_SPLITS).cast("int"), auc, -F.col("lookback"))
    per_horizon = grid.filter(F.col("horizon").isin(horizons)).groupBy(*keys, "outcome", "horizon").agg(F.max_by("lookback", rank).alias("lookback"))
    parts = [per_horizon, best_params(grid, [*keys, "outcome"])]
    if fixed:
        each = F.explode(F.array(*[F.struct(*[F.lit(c[k]).alias(k) for k in ("outcome", "lookback", "horizon")]) for c in fixed]))
        parts.append(grid.select(*keys).distinct().withColumn("_c", each).select(*keys, "_c.*"))
    cols = [*keys, "outcome", "lookback", "horizon"]
    out = parts[0].select(*cols)
    for part in parts[1:]:
        out = out.union(part.select(*cols))
    return out.distinct()


def best_by(grid: DataFrame, keys: list[str], min_folds: int = 3) -> DataFrame:
    """Row with the highest AUC per key among those with enough folds."""
    rank = F.struct(F.col("auc"), -F.col("lookback"), -F.col("horizon"))
    rest = [c for c in grid.columns if c not in keys]
    return (grid.filter(_number("auc").isNotNull() & (F.col("n_folds") >= min_folds))
            .groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("b")).select(*keys, "b.*"))


def best_under_gate(grid: DataFrame, keys: list[str], max_pos: float = K.MAX_POS_RATE) -> DataFrame:
    """Best AUC per key with at least two folds under the positive-rate gate, else the best without it."""
    gated = F.col("pos_rate") <= max_pos
    rank = F.struct(gated.cast("int"), F.col("auc"), -F.col("lookback"), -F.col("horizon"))
    rest = [c for c in grid.columns if c not in keys]
    return (grid.filter(_number("auc").isNotNull() & (F.col("n_folds") >= 2))
            .groupBy(*keys).agg(F.max_by(F.struct(*rest, (~gated).alias("saturated")), rank).alias("b"))
            .select(*keys, "b.*"))


def top_by_auc(grid: DataFrame, keys: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("auc"), "lookback", "horizon")
    return (grid.filter(_number("auc").isNotNull()).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= n))


def stable_configs(grid: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """Configurations in the top n of both periods, with both AUCs and their difference."""
    top = top_by_auc(grid, [*keys, "period"], n)
    side = [*keys, "lookback", "horizon"]
    early = top.filter(F.col("period") == "early").select(*side, F.col("auc").alias("early_auc"))
    late = top.filter(F.col("period") == "late").select(*side, F.col("auc").alias("late_auc"))
    return early.join(late, side).withColumn("delta", F.col("late_auc") - F.col("early_auc"))
