import datetime as dt

import numpy as np
import pandas as pd
import pytest

from sigtide import constants as K
from sigtide.operators import boosting as b
from sigtide.operators import features as ft
from sigtide.operators.models import auc_of, folds_of

KEYS = ["ch"]
D0 = dt.date(2024, 1, 1)
SMALL = b.Boosting(rounds=20)


def planted(n=160, series=("a", "b"), seed=0):
    """Incidents on the day after one with many reports, at random otherwise quiet."""
    rng, rows = np.random.RandomState(seed), []
    for s in series:
        before = 0
        for i in range(n):
            counts = {c: int(rng.poisson(2)) for c in [*K.INCIDENT_DAILY, *K.SIGNALS]}
            counts["significant"] = int(before >= 3)
            before = counts["s_report"]
            rows.append({"ch": s, "date": D0 + dt.timedelta(days=i), **counts, K.DERIVED_SIGNAL: 0})
    return pd.DataFrame(rows)


def chosen(spark, rows):
    return spark.createDataFrame(rows, "ch string, outcome string, lookback int, horizon int")


def test_first_split_is_the_best_of_all():
    """One tree of one level against every split of every feature."""
    rng = np.random.RandomState(1)
    x, y = rng.randint(0, 9, (80, 5)).astype(float), (rng.rand(80) < 0.4).astype(float)
    y[x[:, 3] > 5] = 1
    p = b.Boosting(rounds=1, depth=1, row_share=2, column_share=1, min_weight=0.1)
    split, value, leaf, gain = b.fit_trees(x, y, p)
    w = np.where(y == 1, (y == 0).sum() / y.sum(), 1)
    g, h = w * (0.5 - y), w * 0.25
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + p.penalty)
    best = max((part(x[:, f] <= v) + part(x[:, f] > v) - part(np.full(80, True)), -f, -v) for f in range(5) for v in np.unique(x[:, f])[:-1])
    assert (-best[1], -best[2]) == (split[0, 0], value[0, 0]) and gain.sum() == pytest.approx(best[0])
    right = x[:, split[0, 0]] > value[0, 0]
    assert leaf[0] == pytest.approx([-p.rate * g[m].sum() / (h[m].sum() + p.penalty) for m in (~right, right)])


def test_margin_falls_along_the_training_loss():
    rng = np.random.RandomState(2)
    x = rng.randn(300, 6)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)   # no single split tells
    trees = b.fit_trees(x, y, b.Boosting())
    assert auc_of(y, b.tree_margin(x, *trees[:3])) > 0.97 and set(np.argsort(trees[3])[-2:]) == {0, 1}


def test_planted_signal_folds_and_scores(spark):
    p = planted()
    daily = spark.createDataFrame(p)
    rows = [("a", K.SIGNIFICANT, 3, 1), ("b", K.SIGNIFICANT, 3, 1), ("b", K.ANY, 5, 2), ("a", K.SIGNIFICANT, 3, 1)]
    got = b.train_boosted(daily, KEYS, chosen(spark, rows), K.OUTCOMES, [3, 5], [1, 2], params=SMALL).cache()
    models = {(r.ch, r.outcome): r for r in got.collect()}
    assert len(models) == got.count() == 3
    for s in "ab":
        m = models[s, K.SIGNIFICANT]
        assert m.status == "trained" and m.n_folds == K.CV_SPLITS and m.cv_auc > 0.9 and m.n == 160 - 3
        assert ft.feature_names()[int(np.argmax(m.importance))].startswith("s_report") and sum(m.importance) == pytest.approx(1)
    latest = ft.latest_window(daily, KEYS, [3, 5])
    scored = {(r.ch, r.outcome): r for r in b.score_boosted(latest, got, KEYS).collect()}
    for r in latest.toPandas().to_dict("records"):
        for (s, name), m in models.items():
            if s == r["ch"] and m.lookback == r["lookback"] and m.status == "trained":
                x = np.array([[r[f] for f in ft.feature_names()]], float)
                trees = [np.array(a).reshape(SMALL.rounds, -1) for a in (m.splits, m.values)] + [np.array(m.leaves).reshape(SMALL.rounds, -1)]
                want = 1 / (1 + np.exp(-b.tree_margin(x, *trees)[0]))
                assert scored[s, name].prob == pytest.approx(want)


def test_folds_never_see_later_rows():
    rng = np.random.RandomState(5)
    x, y = rng.randn(80, 4), (rng.rand(80) < 0.5).astype(float)
    want = [auc_of(y[a:z], b.tree_margin(x[a:z], *b.fit_trees(x[:a], y[:a], SMALL)[:3])) for a, z in folds_of(80)]
    assert b._fitted(x, y, SMALL, False)["cv_auc"] == pytest.approx(np.mean(want))


def test_types_one_class_and_no_rows(spark):
    p = planted(60, ("a",))
    daily = spark.createDataFrame(p)
    seen = [("a", D0 + dt.timedelta(days=i), "type_x") for i in range(0, 60, 4)] + [("a", D0 + dt.timedelta(days=1), "type_early")]
    types = spark.createDataFrame(seen, "ch string, date date, outcome string")
    rows = [("a", "type_x", 3, 1), ("a", "type_x", 3, 2), ("a", "type_early", 3, 1), ("none", "type_x", 3, 1)]
    got = {(r.ch, r.outcome, r.horizon): r for r in b.train_boosted(daily, KEYS, chosen(spark, rows), K.OUTCOMES, [3], [1, 2], types, SMALL).collect()}
    days = {i for i in range(0, 60, 4)}
    for h in (1, 2):
        y = [any(i + k in days for k in range(h)) for i in range(3, 60 - h + 1)]
        assert got["a", "type_x", h].n == len(y) and got["a", "type_x", h].pos_rate == pytest.approx(np.mean(y))
    assert got["a", "type_early", 1].status == "one_class" and got["a", "type_early", 1].splits is None
    assert (got["none", "type_x", 1].status, got["none", "type_x", 1].n) == ("one_class", 0)
    assert b.train_boosted(daily, KEYS, chosen(spark, rows).limit(0), K.OUTCOMES, [3], [1, 2], types, SMALL).count() == 0
