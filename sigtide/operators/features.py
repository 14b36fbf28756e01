"""Lookback features and forward-horizon labels over the gap-free daily frame.

Row i describes the days before it: its features use rows i-lookback .. i-1, its labels rows
i .. i+horizon-1. The history of a row is gathered once, in one window over the series; the lookback
is then plain data, so a whole grid of lookbacks is one pass and no further shuffle. Histories are
bounded by the largest lookback and a series by its calendar days.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.session import fan_out

SIGNAL_PARTS = ["sum", "ewm", "lag1", "lag3", "lag7", "slope", "zscore", "alert_days"]
CONTEXT = ["s_mention_x_s_report", "sin_month", "cos_month", "is_heating_season",
           "recent_incident_rate", "days_since_last_incident", "incident_momentum"]


def feature_names(signals: list[str] = K.SIGNALS_EXT) -> list[str]:
    return [f"{s}_{p}" for s in signals for p in SIGNAL_PARTS] + CONTEXT


def series_window(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("date")


def baseline(column: str, w) -> tuple[Column, Column]:
    """Mean and sample deviation of the 30 rows before a row; 0 and 1 below five rows, never 0 deviation."""
    frame = w.rowsBetween(-K.BASELINE_WINDOW, -1)
    enough = F.count(column).over(frame) >= K.BASELINE_MIN_ROWS
    mean = F.when(enough, F.avg(column).over(frame)).otherwise(0.0)
    std = F.when(enough, F.stddev_samp(column).over(frame))
    return mean, F.when(std > 1e-9, std).otherwise(1.0)


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def ewm(arr: Column, lookback: Column) -> Column:
    """Recency-weighted mean, weights decay^age scaled to 1."""
    weighted = F.transform(arr, lambda v, i: v * F.pow(F.lit(K.DECAY), lookback - 1 - i))
    return total(weighted) * (1 - K.DECAY) / (1 - F.pow(F.lit(K.DECAY), lookback))


def slope(arr: Column, lookback: Column) -> Column:
    """Least-squares slope over the window; 0 below three rows."""
    centred = F.transform(arr, lambda v, i: v * (i - (lookback - 1) / 2))
    spread = lookback * (lookback * lookback - 1) / F.lit(12.0)
    return F.when(lookback >= 3, total(centred) / spread).otherwise(0.0)


def lag_of(arr: Column, lookback: Column, k: int) -> Column:
    return F.when(lookback >= k, F.get(arr, lookback - k)).otherwise(0.0)


def alert_days(arr: Column, mean: Column, std: Column) -> Column:
    """Days of the window more than one deviation above the baseline of the current row."""
    return F.size(F.filter(arr, lambda v: (v - mean) / std > 1.0)).cast("double")


def with_history(daily: DataFrame, keys: list[str], signals: list[str], longest: int) -> DataFrame:
    """Daily rows with their history array, baselines, position and series length."""
    w = series_window(keys)
    frame = w.rowsBetween(-max(longest, 1), -1)
    values = F.struct(*[F.col(s).cast("double").alias(s) for s in signals], F.col("inc_count").cast("double").alias("inc_count"))
    cols = {
        "_hist": F.collect_list(values).over(frame),
        "_rn": F.row_number().over(w),
        "_n": F.count("*").over(Window.partitionBy(*keys)),
    }
    for s in signals:
        cols[f"_m_{s}"], cols[f"_s_{s}"] = baseline(s, w)
    return daily.withColumns(cols)


def build_features(daily: DataFrame, keys: list[str], lookbacks: list[int],
                   signals: list[str] = K.SIGNALS_EXT, carry: list[str] = (), few_series: bool = False) -> DataFrame:
    """One row per (series, date, lookback) with the 87 features.

    With ``few_series`` the rows spread over all cores once their history is attached; with many
    series the window already does that and the histories stay where they are.

    Columns: keys, date, lookback, row_no, n_rows, ``carry`` columns, features. Rows with a shorter
    history than the lookback are left out.
    """
    lb = F.col("lookback")
    hist = with_history(daily, keys, signals, max(lookbacks))
    wide = (
        (fan_out(hist) if few_series else hist).withColumn("lookback", F.explode(F.array(*[F.lit(x) for x in lookbacks])))
        .filter(F.col("_rn") > lb)
        .withColumn("_w", F.slice("_hist", F.size("_hist") - lb + 1, lb))
        .withColumn("_day", F.date_sub("date", 1))
    )
    feats: dict[str, Column] = {}
    for s in signals:
        arr, mean, std = F.col(f"_w.{s}"), F.col(f"_m_{s}"), F.col(f"_s_{s}")
        feats[f"{s}_sum"] = total(arr)
        feats[f"{s}_ewm"] = ewm(arr, lb)
        for k in (1, 3, 7):
            feats[f"{s}_lag{k}"] = lag_of(arr, lb, k)
        feats[f"{s}_slope"] = slope(arr, lb)
        feats[f"{s}_zscore"] = (F.get(arr, lb - 1) - mean) / std
        feats[f"{s}_alert_days"] = alert_days(arr, mean, std)
    month, incidents = F.month("_day"), F.col("_w.inc_count")
    if {"s_mention", "s_report"} <= set(signals):
        feats["s_mention_x_s_report"] = F.get(F.col("_w.s_mention"), lb - 1) * F.get(F.col("_w.s_report"), lb - 1)
    feats["sin_month"] = F.sin(month * (2 * math.pi / 12))
    feats["cos_month"] = F.cos(month * (2 * math.pi / 12))
    feats["is_heating_season"] = month.isin(10, 11, 12, 1, 2, 3).cast("double")
    feats["recent_incident_rate"] = F.size(F.filter(incidents, lambda v: v > 0)) / lb
    last = F.array_max(F.transform(incidents, lambda v, i: F.when(v > 0, i)))
    feats["days_since_last_incident"] = F.coalesce(lb - 1 - last, lb).cast("double")
    feats["incident_momentum"] = ewm(incidents, lb)
    return wide.select(*keys, "date", "lookback", F.col("_rn").alias("row_no"), F.col("_n").alias("n_rows"),
                       *carry, *[c.alias(n) for n, c in feats.items()])


# ── labels ────────────────────────────────────────────────────────────────────

def outcome(spec: dict, columns: list[str], w, horizon: int) -> Column:
    """Outcome over rows 0 .. horizon-1; a missing column counts as 0."""
    if spec["col"] not in columns:
        return F.lit(0.0)
    frame = w.rowsBetween(0, horizon - 1)
    s, m = F.sum(spec["col"]).over(frame), F.max(spec["col"]).over(frame)
    ops = {
        "sum_ge": s >= spec.get("threshold", 1), "max_ge": m >= spec.get("threshold", 1),
        "sum": s, "max": m,
    }
    if spec["op"] not in ops:
        raise ValueError(f"unknown outcome operation: {spec['op']!r}")
    return ops[spec["op"]].cast("double")


def build_labels(daily: DataFrame, keys: list[str], horizons: list[int], specs: list[dict]) -> DataFrame:
    """Daily rows plus ``labels``: one struct (horizon, outcome values) per horizon."""
    w = series_window(keys)
    per_h = [F.struct(F.lit(h).alias("horizon"), *[outcome(s, daily.columns, w, h).alias(s["name"]) for s in specs])
             for h in horizons]
    return daily.withColumn("labels", F.array(*per_h))


def next_types(daily: DataFrame, outcomes: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """Daily rows plus ``ahead_outcome`` and ``ahead_wait``: the type outcomes of rows 0 .. longest-1 and the rows until the first of each.

    An outcome is positive at horizon h where its wait is less than h. The plan is the same for any number of types.
    """
    per_day = outcomes.groupBy(*keys, "date").agg(F.collect_set("outcome").alias("_types"))
    w = series_window(keys)
    rows = daily.join(per_day, [*keys, "date"], "left").withColumn("_at", F.row_number().over(w))
    here = F.transform(F.coalesce("_types", F.array().cast("array<string>")), lambda t: F.struct(t.alias("outcome"), F.col("_at").alias("at")))
    rows = rows.withColumn("_here", here).withColumn("_next", F.flatten(F.collect_list("_here").over(w.rowsBetween(0, longest - 1))))
    rows = rows.withColumn("ahead_outcome", F.array_sort(F.array_distinct(F.col("_next.outcome"))))
    first = F.transform("ahead_outcome", lambda n: F.array_min(F.transform(
        F.filter("_next", lambda x: x["outcome"] == n), lambda x: x["at"])) - F.col("_at"))
    return rows.withColumn("ahead_wait", first).drop("_types", "_at", "_here", "_next")


def valid_rows() -> Column:
    """Rows with a full lookback behind and a full horizon ahead."""
    return (F.col("row_no") > F.col("lookback")) & (F.col("row_no") <= F.col("n_rows") - F.col("horizon") + 1)


def build_dataset(daily: DataFrame, keys: list[str], lookbacks: list[int], horizons: list[int], specs: list[dict],
                  signals: list[str] = K.SIGNALS_EXT, carry: list[str] = (), few_series: bool = False) -> DataFrame:
    """Features and labels per (series, date, lookback, horizon): the training table."""
    labelled = build_labels(daily, keys, horizons, specs)
    feats = build_features(labelled, keys, lookbacks, signals, ["labels", *carry], few_series)
    out = feats.withColumn("_l", F.explode("labels")).drop("labels")
    head = [*keys, "date", "lookback", "row_no", "n_rows", *carry]
    return (out.select(*head, "_l.*", *feature_names(signals)).filter(valid_rows()))


def with_next_day(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Daily rows plus one empty row after the last day of each series: the day to predict."""
    counters = [c for c in daily.columns if c not in (*keys, "date")]
    last = F.lead("date").over(series_window(keys)).isNull()
    step = F.when(F.col("_last"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return daily.withColumn("_last", last).withColumn("_k", F.explode(step)).select(
        *keys, F.date_add("date", F.col("_k")).alias("date"),
        *[F.when(F.col("_k") == 0, F.col(c)).otherwise(0).alias(c) for c in counters])


def latest_window(daily: DataFrame, keys: list[str], lookbacks: list[int], signals: list[str] = K.SIGNALS_EXT) -> DataFrame:
    """Scoring rows: the features of the day after the last one of each series."""
    feats = build_features(with_next_day(daily, keys), keys, lookbacks, signals)
    return feats.filter(F.col("row_no") == F.col("n_rows")).withColumn("data_through", F.date_sub("date", 1))
