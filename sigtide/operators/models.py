"""Many small fits as one Spark job: grids, banks, forecasts, importance, backtests.

A group is one (series, lookback) of the training table: at most the calendar days of a series, so its
size is bounded. Spark spreads the groups; inside a task numpy fits each configuration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.operators import features as ft


# ── numpy helpers used inside tasks ───────────────────────────────────────────

def scale_fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    std = x.std(axis=0)
    return x.mean(axis=0), np.where(std < 1e-12, 1.0, std)


def logit_fit(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Class-balanced logistic regression with unit L2 penalty, Newton steps; intercept last."""
    n, pos = len(y), y.sum()
    weight = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    z = np.column_stack([x, np.ones(n)])
    ridge = np.append(np.ones(x.shape[1]), 0.0)
    beta = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -35, 35)))
        grad = z.T @ (weight * (p - y)) + ridge * beta
        hess = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(ridge + 1e-9)
        move = np.linalg.solve(hess, grad)
        beta -= move
        if np.abs(move).max() < 1e-8:
            break
    return beta


def logit_prob(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -35, 35)))


def ridge_fit(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    xm, ym = x.mean(axis=0), y.mean()
    coef = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return np.append(coef, ym - xm @ coef)


def auc_of(y: np.ndarray, score: np.ndarray) -> float:
    ranks = pd.Series(score).rank().to_numpy()
    pos = int(y.sum())
    return float((ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))


def f1_of(y: np.ndarray, called: np.ndarray) -> float:
    total = called.sum() + y.sum()
    return float(2 * (called & (y == 1)).sum() / total) if total else 0.0


def folds_of(n: int, splits: int = K.CV_SPLITS) -> Iterator[tuple[int, int]]:
    """(train end, test end) of the expanding time folds; none when the series is too short."""
    size = n // (splits + 1)
    for k in range(splits if size else 0):
        start = n - size * (splits - k)
        yield start, start + size


def cross_validate(x: np.ndarray, y: np.ndarray, splits: int = K.CV_SPLITS, with_baseline: bool = True) -> dict:
    """AUC and F1 over the time folds (single-class folds skipped) with a random stratified baseline."""
    aucs, f1s, base = [], [], []
    for tr, te in folds_of(len(y), splits):
        ytr, yte = y[:tr], y[tr:te]
        if len(np.unique(ytr)) < 2 or len(np.unique(yte)) < 2:
            continue
        mean, std = scale_fit(x[:tr])
        beta = logit_fit((x[:tr] - mean) / std, ytr)
        prob = logit_prob((x[tr:te] - mean) / std, beta)
        aucs.append(auc_of(yte, prob))
        f1s.append(f1_of(yte, prob > 0.5))
        if with_baseline:
            rate = ytr.mean()
            draw = np.random.RandomState(0).multinomial(1, [1 - rate, rate], size=te - tr)[:, 1]
            base.append(auc_of(yte, draw))
    stat = lambda v, f: float(f(v)) if v else None
    return {
        "auc": stat(aucs, np.mean), "auc_std": stat(aucs, np.std), "f1": stat(f1s, np.mean), "f1_std": stat(f1s, np.std),
        "baseline_auc": stat(base, np.mean), "n_folds": len(aucs),
    }


# ── grid search ───────────────────────────────────────────────────────────────

GRID_SCHEMA = ("outcome string, lookback int, horizon int, auc double, auc_std double, f1 double, f1_std double, "
               "baseline_auc double, n_folds int, n bigint, pos_rate double, lift double, note string")


def label_column(name: str, horizon: int) -> str:
    return f"y_{name}_{horizon}"


AHEAD = ["ahead_outcome", "ahead_wait"]


def training_table(daily: DataFrame, keys: list[str], lookbacks: list[int], specs: list[dict], horizons: list[int],
                   types: DataFrame | None = None) -> DataFrame:
    """Features per lookback with one label column per (outcome, horizon).

    ``types``: outcomes found in the data, as (keys, date, outcome) rows. They come as two array columns, so that the plan does not grow with them.
    """
    w = ft.series_window(keys)
    labels = {label_column(s["name"], h): ft.outcome(s, daily.columns, w, h) for s in specs for h in horizons}
    labelled, carry = daily.withColumns(labels), list(labels)
    if types is not None:
        labelled, carry = ft.next_types(labelled, types, keys, max(horizons)), [*carry, *AHEAD]
    return ft.build_features(labelled, keys, lookbacks, carry=carry, few_series=True)


def with_type_labels(g: pd.DataFrame, horizons: list[int]) -> tuple[pd.DataFrame, list[str]]:
    """The rows of one (series, lookback) with a label column per type outcome and horizon, and the outcomes that occur among them."""
    if AHEAD[0] not in g or not len(g):
        return g, []
    row = np.repeat(np.arange(len(g)), g[AHEAD[0]].map(len).to_numpy())
    outcome, wait = (np.concatenate(g[c].to_numpy()) for c in AHEAD)
    found, labels = [], {}
    for name in sorted(set(outcome.tolist())):
        until, own = np.full(len(g), np.inf), outcome == name
        until[row[own]] = wait[own].astype(float)
        if (until == 0).any():
            found.append(name)
            labels |= {label_column(name, h): (until < h).astype(float) for h in horizons}
    return pd.concat([g, pd.DataFrame(labels, index=g.index)], axis=1), found


def _cell(g: pd.DataFrame, feats: list[str], h: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix and labels of one configuration; ``g`` is sorted by row number."""
    keep = (g["row_no"] <= g["n_rows"] - h + 1).to_numpy()
    return g[feats].to_numpy(float)[keep], g[label_column(name, h)].to_numpy(float)[keep]


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    """Result rows as a frame; what a row lacks stays None, also in array columns."""
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})


def _columns(schema: str) -> list[str]:
    return [part.strip().split()[0] for part in schema.split(", ")]


def keyed_schema(df: DataFrame, keys: list[str], rest: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([f"`{k}` {types[k]}" for k in keys] + [rest])


def grid_search(daily: DataFrame, keys: list[str], specs: list[dict] = K.GRID_TARGETS, lookbacks: list[int] = K.LOOKBACKS,
                horizons: list[int] = K.HORIZONS, with_baseline: bool = True, types: DataFrame | None = None) -> DataFrame:
    """Cross-validated score of every (outcome, lookback, horizon) of every series: one row each.

    ``types`` adds the outcomes that its rows name, in each series and lookback whose feature rows hold a day of theirs.
    """
    table = training_table(daily, keys, lookbacks, specs, horizons, types)
    feats, names = ft.feature_names(), [s["name"] for s in specs]

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g, found = with_type_labels(g.sort_values("row_no"), horizons)
        lb, rows = int(key[-1]), []
        for h in horizons:
            for name in [*names, *found]:
                x, y = _cell(g, feats, h, name)
                row = dict(zip(keys, key)) | {"outcome": name, "lookback": lb, "horizon": h, "n": len(y),
                                             "pos_rate": float(y.mean()) if len(y) else None}
                if len(np.unique(y)) < 2:
                    row |= {"n_folds": 0, "note": "one_class"}
                else:
                    row |= cross_validate(x, y, with_baseline=with_baseline)
                    row["note"] = "scored" if row["n_folds"] == K.CV_SPLITS else "folds_missing"
                    if row["auc"] is not None and row["baseline_auc"] is not None:
                        row["lift"] = row["auc"] - row["baseline_auc"]
                rows.append(row)
        return _frame(rows, [*keys, *_columns(GRID_SCHEMA)])

    return table.groupBy(*keys, "lookback").applyInPandas(fit, keyed_schema(daily, keys, GRID_SCHEMA))


def stability_grid(daily: DataFrame, keys: list[str], **kw) -> DataFrame:
    """The grid on the early and the late half of each series, in one job: the half is one more key."""
    w = Window.partitionBy(*keys)
    rn, n = F.row_number().over(w.orderBy("date")), F.count("*").over(w)
    halves = daily.withColumn("period", F.when(rn <= F.floor(n / 2), "early").otherwise("late"))
    return grid_search(halves, [*keys, "period"], with_baseline=False, **kw)


# ── model bank ────────────────────────────────────────────────────────────────

MODEL_SCHEMA = ("outcome string, lookback int, horizon int, status string, n bigint, pos_rate double, cv_auc double, "
                "cv_std double, n_folds int, features array<string>, mean array<double>, scale array<double>, "
                "coef array<double>, intercept double, importance array<double>")


def train_bank(daily: DataFrame, keys: list[str], configs: list[dict], specs: list[dict], feats: list[str] | None = None,
               recent: list[int | None] | None = None) -> DataFrame:
    """One model row per series and configuration {outcome, lookback, horizon}.

    Cross-validation and the final fit use separate scalers. Models are table rows, so saving a bank is
    writing a table and scoring it is a join. With ``recent``, training windows (latest rows, None: all) are
    part of a configuration: each is a model row with ``recent_rows``, for ``choose_window`` to pick from.
    """
    feats = feats or ft.feature_names()
    lookbacks = sorted({c["lookback"] for c in configs})
    horizons = sorted({c["horizon"] for c in configs})
    table = training_table(daily, keys, lookbacks, specs, horizons)
    extra = ", recent_rows int" if recent else ""

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g, lb, rows = g.sort_values("row_no"), int(key[-1]), []
        for c in (c for c in configs if c["lookback"] == lb):
            x, y = _cell(g, feats, c["horizon"], c["outcome"])
            row = dict(zip(keys, key)) | {"outcome": c["outcome"], "lookback": lb, "horizon": c["horizon"]}
            rows += [row | {"recent_rows": r} | _fit_row(x[-(r or len(x)):], y[-(r or len(y)):], feats) for r in recent or [None]]
        return _frame(rows, [*keys, *_columns(MODEL_SCHEMA + extra)])

    return table.groupBy(*keys, "lookback").applyInPandas(fit, keyed_schema(daily, keys, MODEL_SCHEMA + extra))


def train_chosen(daily: DataFrame, keys: list[str], chosen: DataFrame, specs: list[dict], lookbacks: list[int] = K.LOOKBACKS,
                 horizons: list[int] = K.HORIZONS, types: DataFrame | None = None) -> DataFrame:
    """One model row per row of ``chosen`` (keys, outcome, lookback, horizon), which may differ from series to series.

    The lookbacks and horizons must cover those of ``chosen``, ``specs`` and ``types`` its outcomes. A configuration without a row of features is one class.
    """
    feats = ft.feature_names()
    table = training_table(daily, keys, lookbacks, specs, horizons, types)

    def fit(key: tuple, g: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        g, rows = with_type_labels(g.sort_values("row_no"), horizons)[0], []
        for c in own.sort_values(["outcome", "horizon"]).itertuples():
            x, y = _cell(g, feats, int(c.horizon), c.outcome)
            rows.append(dict(zip(keys, key)) | {"outcome": c.outcome, "lookback": int(key[-1]), "horizon": int(c.horizon)} | _fit_row(x, y, feats))
        return _frame(rows, [*keys, *_columns(MODEL_SCHEMA)])

    by = [*keys, "lookback"]
    return table.groupBy(*by).cogroup(chosen.groupBy(*by)).applyInPandas(fit, keyed_schema(daily, keys, MODEL_SCHEMA))


def choose_window(bank: DataFrame, keys: list[str], fallback: int | None = K.RECENT_FALLBACK) -> DataFrame:
    """Of each configuration's training windows the one with the highest mean less deviation of its fold AUCs, the earlier
    of two as good; only windows with all folds compete, and the fallback stands in where none has them."""
    full = F.col("n_folds") >= K.CV_SPLITS
    size = F.coalesce("recent_rows", F.lit(2**31 - 1))
    rank = F.when(full, F.struct(F.lit(1), F.col("cv_auc") - F.col("cv_std"), -size)).otherwise(
        F.struct(F.lit(0), F.col("recent_rows").eqNullSafe(F.lit(fallback)).cast("double"), -size))
    whole = F.struct(*bank.columns)
    return bank.groupBy(*keys, "outcome", "lookback", "horizon").agg(F.max_by(whole, rank).alias("_b")).select("_b.*")


def _fit_row(x: np.ndarray, y: np.ndarray, feats: list[str], splits: int = K.CV_SPLITS) -> dict:
    if len(np.unique(y)) < 2:
        return {"status": "one_class", "n": len(y), "n_folds": 0}
    cv = cross_validate(x, y, splits, with_baseline=False)
    mean, std = scale_fit(x)
    beta = logit_fit((x - mean) / std, y)
    size = np.abs(beta[:-1])
    return {"status": "trained", "n": len(y), "pos_rate": float(y.mean()), "cv_auc": cv["auc"], "cv_std": cv["auc_std"],
            "n_folds": cv["n_folds"], "features": feats, "mean": mean.tolist(), "scale": std.tolist(),
            "coef": beta[:-1].tolist(), "intercept": float(beta[-1]), "importance": (size / max(size.sum(), 1e-12)).tolist()}


def ridge_scores(daily: DataFrame, keys: list[str], spec: dict, lookback: int, horizon: int) -> DataFrame:
    """Regression path: cross-validated R squared of a ridge fit per series; flat folds are skipped."""
    table, feats = training_table(daily, keys, [lookback], [spec], [horizon]), ft.feature_names()

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x, y = _cell(g.sort_values("row_no"), feats, horizon, spec["name"])
        scores = []
        for tr, te in folds_of(len(y)):
            ytr, yte = y[:tr], y[tr:te]
            if ytr.std() < 1e-9 or yte.std() < 1e-9:
                continue
            mean, std = scale_fit(x[:tr])
            beta = ridge_fit((x[:tr] - mean) / std, ytr)
            left = yte - (x[tr:te] - mean) / std @ beta[:-1] - beta[-1]
            scores.append(1 - (left**2).sum() / ((yte - yte.mean()) ** 2).sum())
        return pd.DataFrame([[*key[:-1], spec["name"], float(np.mean(scores)) if scores else None, len(scores)]],
                            columns=[*keys, "outcome", "r2", "n_folds"])

    return table.groupBy(*keys, "lookback").applyInPandas(
        fit, keyed_schema(daily, keys, "outcome string, r2 double, n_folds int"))


# ── scoring with model rows (column expressions) ──────────────────────────────

def score(rows: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """Probability, label and top-4 contributions for feature rows joined with their model rows.

    Model rows without a fit keep a null probability and their status; series without a feature row
    for the lookback report insufficient data.
    """
    feats = ft.feature_names()
    values = F.map_from_arrays(F.array(*[F.lit(f) for f in feats]), F.array(*[F.col(f) for f in feats]))
    slim = rows.select(*keys, "lookback", "date", *[c for c in ("data_through",) if c in rows.columns], values.alias("_v"))
    j = models.join(slim, [*keys, "lookback"], "left")
    x = F.transform("features", lambda f: F.try_element_at("_v", f))
    scaled = F.transform(F.arrays_zip(x.alias("x"), F.col("mean"), F.col("scale")), lambda t: (t["x"] - t["mean"]) / t["scale"])
    parts = F.zip_with("coef", "_x", lambda a, b: a * b)
    margin = F.aggregate("_c", F.lit(0.0), lambda acc, v: acc + v) + F.col("intercept")
    top = F.slice(F.sort_array(F.transform(
        F.arrays_zip("features", "_c"), lambda t: F.struct(F.abs(t["_c"]).alias("size"), t["features"].alias("feature"),
                                                          t["_c"].alias("contribution"))), asc=False), 1, 4)
    status = (F.when(F.col("status") != "trained", F.col("status"))
               .when(F.col("_v").isNull(), F.lit("history_too_short"))
               .when(F.exists("_x", lambda v: v.isNull()), "features_differ").otherwise("ok"))
    return (
        j.withColumn("_x", scaled).withColumn("_c", parts)
        .withColumn("prob", 1 / (1 + F.exp(-margin)))
        .withColumn("predicted", F.col("prob") > 0.5)
        .withColumn("top_features", top).withColumn("status", status)
        .drop("_v", "_x", "_c")
    )


def backtest(daily: DataFrame, keys: list[str], models: DataFrame, spec: dict, lookback: int, horizon: int,
             n_days: int = 30) -> DataFrame:
    """Model applied to the latest labelled rows of each series: prob, predicted, actual, correct."""
    data = ft.build_dataset(daily, keys, [lookback], [horizon], [spec])
    w = Window.partitionBy(*keys).orderBy(F.desc("date"))
    rows = data.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n_days)
    one = models.filter((F.col("outcome") == spec["name"]) & (F.col("lookback") == lookback) & (F.col("horizon") == horizon))
    actual = rows.select(*keys, "date", (F.col(spec["name"]) == 1).alias("actual"))
    scored = score(rows, one, keys).select(*keys, "date", "prob", "predicted")
    return scored.join(actual, [*keys, "date"]).withColumn("correct", F.col("predicted") == F.col("actual"))


def permutation_importance(daily: DataFrame, keys: list[str], models: DataFrame, spec: dict, lookback: int, horizon: int,
                           repeats: int = 30) -> DataFrame:
    """Mean and deviation of the AUC drop when one feature is shuffled, per series and feature.

    The work fans out over features: a group holds the rows of one series and permutes one feature,
    so a wide table is spread instead of one task doing all of them.
    """
    feats = ft.feature_names()
    data = ft.build_dataset(daily, keys, [lookback], [horizon], [spec])
    one = models.filter((F.col("outcome") == spec["name"]) & (F.col("lookback") == lookback)
                        & (F.col("horizon") == horizon) & (F.col("status") == "trained"))
    x = F.array(*[F.col(f) for f in feats])
    scaled = F.transform(F.arrays_zip(x.alias("x"), F.col("mean"), F.col("scale")), lambda t: (t["x"] - t["mean"]) / t["scale"])
    rows = (
        data.join(one.select(*keys, "mean", "scale", "coef", "intercept"), keys)
        .withColumn("_c", F.zip_with("coef", scaled, lambda a, b: a * b))
        .withColumn("margin", F.aggregate("_c", F.lit(0.0), lambda acc, v: acc + v) + F.col("intercept"))
        .select(*keys, "row_no", F.col(spec["name"]).alias("y"), "margin", F.posexplode("_c").alias("f", "part"))
    )

    def drop(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("row_no")
        y, margin, part = g["y"].to_numpy(), g["margin"].to_numpy(), g["part"].to_numpy()
        f, rng = int(key[-1]), np.random.RandomState(int(key[-1]))
        mean, std = None, None
        if len(np.unique(y)) > 1:
            base = auc_of(y, margin)
            drops = [base - auc_of(y, margin - part + rng.permutation(part)) for _ in range(repeats)]
            mean, std = float(np.mean(drops)), float(np.std(drops))
        return pd.DataFrame([[*key[:-1], spec["name"], lookback, horizon, feats[f], mean, std]],
                            columns=[*keys, "outcome", "lookback", "horizon", "feature", "importance_mean", "importance_std"])

    schema = "outcome string, lookback int, horizon int, feature string, importance_mean double, importance_std double"
    return rows.groupBy(*keys, "f").applyInPandas(drop, keyed_schema(daily, keys, schema))


# ── pooled boosted trees ──────────────────────────────────────────────────────

def boosted_model(dataset: DataFrame, label: str, feats: list[str] | None = None, rounds: int = 100):
    """Boosted trees over the pooled panel of all series with the class weight neg/pos.

    Spark ML distributes the histogram building, so the panel may be any size.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    feats = feats or ft.feature_names()
    ratio = dataset.agg((F.count_if(F.col(label) == 0) / F.greatest(F.count_if(F.col(label) == 1), F.lit(1))).alias("r"))
    weighted = dataset.withColumn("_w", F.when(F.col(label) == 1, ratio.scalar()).otherwise(1.0))
    gbt = GBTClassifier(featuresCol="_f", labelCol=label, weightCol="_w", maxIter=rounds, maxDepth=4, stepSize=0.05,
                        subsamplingRate=0.8, featureSubsetStrategy="0.6", minInstancesPerNode=5, seed=42)
    return Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="_f"), gbt]).fit(weighted)
