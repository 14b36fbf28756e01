"""Boosted trees per configuration: histogram boosting over binned features, one (series, outcome, lookback, horizon) per group.

A group is bounded by the days of a series. Trees are arrays of a model row, so a bank of them is a table and scoring is a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.operators import features as ft
from sigtide.operators.models import AHEAD, auc_of, folds_of, keyed_schema, label_column, training_table
from sigtide.session import fan_out, materialise


@dataclass(frozen=True)
class Boosting:
    """Parameters of a fit. Positives weigh as many times more as there are more negatives."""

    rounds: int = 100
    depth: int = 4
    rate: float = 0.05
    bins: int = 32
    row_share: float = 0.8
    column_share: float = 0.6
    min_weight: float = 5.0
    penalty: float = 1.0
    seed: int = 42


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cuts of each feature: all distinct values where they are few, else quantiles; the largest value is no cut."""
    at = np.linspace(0, 1, bins + 1)[1:-1]
    out = []
    for column in x.T:
        values = np.unique(column)
        out.append(values[:-1] if len(values) <= bins else np.unique(np.quantile(column, at, method="lower")))
    return out


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -35, 35)))


def fit_trees(x: np.ndarray, y: np.ndarray, p: Boosting) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Split features and values (a tree in heap order), leaf values, gain per feature. A value over its split goes right; an unused split is infinite."""
    n, width = x.shape
    edges = bin_edges(x, p.bins)
    cut = np.full((width, p.bins + 1), np.inf)
    binned = np.empty((n, width), np.int64)
    for f, e in enumerate(edges):
        cut[f, : len(e)] = e
        binned[:, f] = np.searchsorted(e, x[:, f], side="left")
    rng, margin, gain_of = np.random.default_rng(p.seed), np.zeros(n), np.zeros(width)
    weight = np.where(y == 1, (y == 0).sum() / max((y == 1).sum(), 1), 1.0)
    inner, size, k = (1 << p.depth) - 1, p.bins + 1, max(1, round(width * p.column_share))
    split, value, leaf = np.zeros((p.rounds, inner), int), np.full((p.rounds, inner), np.inf), np.zeros((p.rounds, inner + 1))
    for t in range(p.rounds):
        prob = _sigmoid(margin)
        grad, hess = weight * (prob - y), weight * prob * (1 - prob)
        rows = np.flatnonzero(rng.random(n) < p.row_share)
        columns = np.sort(rng.choice(width, k, replace=False))
        at = binned[np.ix_(rows, columns)] + np.arange(k) * size
        g, h = np.repeat(grad[rows], k), np.repeat(hess[rows], k)
        node = np.zeros(n, int)
        for level in range(p.depth):
            nodes = 1 << level
            place = (at + node[rows, None] * (k * size)).ravel()
            left_g, left_h = (np.bincount(place, v, nodes * k * size).reshape(nodes, k, size).cumsum(axis=2) for v in (g, h))
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + p.penalty) + right_g**2 / (right_h + p.penalty) - all_g**2 / (all_h + p.penalty)
            gain[(left_h < p.min_weight) | (right_h < p.min_weight)] = 0
            flat = gain.reshape(nodes, -1)
            best = flat.argmax(axis=1)
            top = flat[np.arange(nodes), best]
            f, b = columns[best // size], np.where(top > 1e-9, best % size, size)
            np.add.at(gain_of, f, np.maximum(top, 0))
            first = nodes - 1
            split[t, first : first + nodes], value[t, first : first + nodes] = f, np.where(top > 1e-9, cut[f, np.minimum(b, p.bins)], np.inf)
            node = 2 * node + (binned[np.arange(n), f[node]] > b[node])
        sum_g, sum_h = (np.bincount(node[rows], v[rows], inner + 1) for v in (grad, hess))
        leaf[t] = -p.rate * sum_g / (sum_h + p.penalty)
        margin += leaf[t][node]
    return split, value, leaf, gain_of


def tree_margin(x: np.ndarray, split: np.ndarray, value: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    out, inner = np.zeros(len(x)), split.shape[1]
    for s, v, leaves in zip(split, value, leaf, strict=True):
        node = np.zeros(len(x), int)
        while (inner > node).any():
            node = 2 * node + 1 + (x[np.arange(len(x)), s[node]] > v[node])
        out += leaves[node - inner]
    return out


SCHEMA = ("outcome string, lookback int, horizon int, status string, n bigint, pos_rate double, cv_auc double, cv_std double, n_folds int, "
          "splits array<int>, values array<double>, leaves array<double>, importance array<double>")


def _fitted(x: np.ndarray, y: np.ndarray, p: Boosting, with_model: bool) -> dict:
    if len(np.unique(y)) < 2:
        return {"status": "one_class", "n": len(y), "pos_rate": float(y.mean()), "n_folds": 0}
    aucs = []
    for start, end in folds_of(len(y)):
        if len(np.unique(y[:start])) == 2 and len(np.unique(y[start:end])) == 2:
            aucs.append(auc_of(y[start:end], tree_margin(x[start:end], *fit_trees(x[:start], y[:start], p)[:3])))
    out = {"status": "trained", "n": len(y), "pos_rate": float(y.mean()), "n_folds": len(aucs),
           "cv_auc": float(np.mean(aucs)) if aucs else None, "cv_std": float(np.std(aucs)) if aucs else None}
    if with_model:
        split, value, leaf, gain = fit_trees(x, y, p)
        out |= {"splits": split.ravel(), "values": value.ravel(), "leaves": leaf.ravel(), "importance": gain / max(gain.sum(), 1e-12)}
    return out


def train_boosted(daily: DataFrame, keys: list[str], chosen: DataFrame, specs: list[dict], lookbacks: list[int] = K.LOOKBACKS,
                  horizons: list[int] = K.HORIZONS, types: DataFrame | None = None, params: Boosting = Boosting(), with_model: bool = True) -> DataFrame:  # noqa: B008
    """One model row per row of ``chosen`` (keys, outcome, lookback, horizon): AUC over the expanding time folds and, fitted on all rows, trees and gain importance.

    The lookbacks and horizons must cover those of ``chosen``, ``specs`` and ``types`` its outcomes. Without a row of features or with one class only
    there is no model (``one_class``); folds of one class are skipped. Every configuration is a group of its own, so Spark spreads them.
    """
    feats, by = ft.feature_names(), [*keys, "outcome", "lookback", "horizon"]
    table = training_table(daily, keys, lookbacks, specs, horizons, types)
    slots = F.create_map(*[F.lit(v) for i, (name, h) in enumerate((s["name"], h) for s in specs for h in horizons) for v in (f"{name}:{h}", i)])
    columns = F.array(*[F.col(label_column(s["name"], h)) for s in specs for h in horizons])
    ahead = [F.col(c) for c in AHEAD] if types is not None else []
    rows = materialise(table.select(*keys, "lookback", "row_no", "n_rows", columns.alias("_labels"), *ahead, F.array(*feats).alias("x")), "boosting")
    own = materialise(chosen.select(*by).distinct(), "configurations").withColumn("_slot", F.try_element_at(slots, F.concat_ws(":", "outcome", "horizon")))
    label = F.get("_labels", F.col("_slot"))
    if ahead:
        wait = F.try_element_at(ahead[1], F.nullif(F.array_position(ahead[0], F.col("outcome")), F.lit(0)).cast("int"))
        label = F.when(F.col("_slot").isNull(), F.coalesce((wait < F.col("horizon")).cast("double"), F.lit(0.0))).otherwise(label)
    data = (rows.join(own, [*keys, "lookback"]).filter(F.col("row_no") <= F.col("n_rows") - F.col("horizon") + 1)
            .select(*by, "row_no", label.alias("y"), "x"))
    schema = keyed_schema(daily, keys, SCHEMA)
    names = [c.strip().split()[0] for c in SCHEMA.split(", ")]
    kinds = {"splits": pa.list_(pa.int32()), "values": pa.list_(pa.float64()), "leaves": pa.list_(pa.float64()), "importance": pa.list_(pa.float64()),
             "outcome": pa.string(), "status": pa.string(), "lookback": pa.int32(), "horizon": pa.int32(), "n_folds": pa.int32(), "n": pa.int64()}

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("row_no")
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in group["x"].chunks]).reshape(-1, len(feats))
        row = _fitted(x, group["y"].to_numpy(), params, with_model)
        head = {c: group[c][0] for c in by}
        cells = [pa.array([head[c].as_py()], group[c].type) if c in head else pa.array([row.get(c)], kinds.get(c, pa.float64())) for c in [*keys, *names]]
        return pa.Table.from_arrays(cells, [*keys, *names])

    done = fan_out(data, *by).groupBy(*by).applyInArrow(fit, schema)
    none = {"status": F.coalesce("status", F.lit("one_class")), "n": F.coalesce("n", F.lit(0).cast("long")), "n_folds": F.coalesce("n_folds", F.lit(0))}
    return own.select(*by).join(done, by, "left").withColumns(none)


def boosted_margin(depth: int, x: Column, splits: Column, values: Column, leaves: Column) -> Column:
    """Sum of the leaves that a feature array reaches, as a column expression."""
    inner = (1 << depth) - 1

    def tree(total: Column, t: Column) -> Column:
        def step(node: Column, _: Column) -> Column:
            here = t * inner + node
            return 2 * node + 1 + (F.get(x, F.get(splits, here)) > F.get(values, here)).cast("int")

        end = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)
        return total + F.get(leaves, t * (inner + 1) + end - inner)

    trees = F.sequence(F.lit(0), (F.size(leaves) / (inner + 1)).cast("int") - 1)
    return F.aggregate(trees, F.lit(0.0), tree)


def score_boosted(rows: DataFrame, models: DataFrame, keys: list[str], depth: int = Boosting.depth) -> DataFrame:
    """Probability and label of feature rows (one per keys and lookback) by their model rows; without a model or a row the probability is null."""
    slim = rows.select(*keys, "lookback", "data_through", F.array(*ft.feature_names()).alias("_x"))
    margin = boosted_margin(depth, F.col("_x"), F.col("splits"), F.col("values"), F.col("leaves"))
    status = F.when(F.col("status") != "trained", F.col("status")).when(F.col("_x").isNull(), "history_too_short").otherwise("ok")
    return (models.join(slim, [*keys, "lookback"], "left").withColumn("status", status)
            .withColumn("prob", F.when(F.col("status") == "ok", 1 / (1 + F.exp(-margin)))).withColumn("predicted", F.col("prob") > 0.5)
            .drop("_x", "splits", "values", "leaves"))


def gain_importance(models: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outcome, feature, importance) of the trained models."""
    names = F.array(*[F.lit(f) for f in ft.feature_names()])
    pair = F.explode(F.arrays_zip(names.alias("feature"), F.col("importance")))
    return models.filter(F.col("status") == "trained").select(*keys, "outcome", pair.alias("_p")).select(*keys, "outcome", "_p.*")
