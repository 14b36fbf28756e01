import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.operators import analogs, clusters, correlate, daily, evaluate, models
from sigtide.operators import features as ft

KEYS = ["ch"]
D0 = dt.date(2024, 1, 1)


def panel(n=60, series=("a", "b"), seed=0):
    rng = np.random.RandomState(seed)
    rows = []
    for s in series:
        for i in range(n):
            counts = {c: int(rng.poisson(2)) for c in [*K.INCIDENT_DAILY, *K.SIGNALS]}
            rows.append({"ch": s, "date": D0 + dt.timedelta(days=i), **counts, K.DERIVED_SIGNAL: max(counts["s_broad"] - counts["s_cross"], 0)})
    return pd.DataFrame(rows)


def brute_features(p, i, lb):
    """Feature row of position i from the definition, with numpy."""
    out, w = {}, p.iloc[i - lb:i]
    weights = 0.7 ** np.arange(lb - 1, -1, -1)
    weights /= weights.sum()
    base = p.iloc[max(0, i - 30):i]
    for s in K.SIGNALS_EXT:
        v = w[s].to_numpy(float)
        enough = len(base) >= 5
        m = base[s].mean() if enough else 0.0
        d = base[s].std() if enough else 1.0
        d = d if d > 1e-9 else 1.0
        out[f"{s}_sum"], out[f"{s}_ewm"] = v.sum(), weights @ v
        for k in (1, 3, 7):
            out[f"{s}_lag{k}"] = v[-k] if k <= lb else 0.0
        out[f"{s}_slope"] = np.polyfit(np.arange(lb), v, 1)[0] if lb >= 3 else 0.0
        out[f"{s}_zscore"] = (v[-1] - m) / d
        out[f"{s}_alert_days"] = float((((v - m) / d) > 1).sum())
    atk = w["inc_count"].to_numpy(float)
    month = w["date"].iloc[-1].month
    hits = np.where(atk > 0)[0]
    out |= {"s_mention_x_s_report": w["s_mention"].iloc[-1] * w["s_report"].iloc[-1], "sin_month": np.sin(2 * np.pi * month / 12),
            "cos_month": np.cos(2 * np.pi * month / 12), "is_heating_season": float(month in (10, 11, 12, 1, 2, 3)),
            "recent_incident_rate": (atk > 0).mean(), "days_since_last_incident": float(lb - hits[-1] - 1) if len(hits) else float(lb),
            "incident_momentum": weights @ atk}
    return out


@pytest.mark.parametrize("lb", [1, 2, 10])
def test_features_equal_definition(spark, lb):
    p = panel(40)
    got = ft.build_features(spark.createDataFrame(p), KEYS, [lb]).orderBy("ch", "date").toPandas()
    assert list(got.columns[5:]) == ft.feature_names() and len(ft.feature_names()) == 87
    for s in ("a", "b"):
        one, mine = p[p.ch == s].reset_index(drop=True), got[got.ch == s].reset_index(drop=True)
        assert len(mine) == 40 - lb
        for j in (0, 3, 17, len(mine) - 1):
            want = brute_features(one, j + lb, lb)
            np.testing.assert_allclose(mine.loc[j, list(want)].astype(float), list(want.values()), atol=1e-9)


def test_no_leak(spark):
    p = panel(40)
    later = p.copy()
    cut = D0 + dt.timedelta(days=25)
    later.loc[later.date >= cut, K.SIGNALS_EXT + ["inc_count"]] += 7
    a, b = (ft.build_features(spark.createDataFrame(x), KEYS, [10]).filter(F.col("date") <= cut).orderBy("ch", "date").toPandas() for x in (p, later))
    pd.testing.assert_frame_equal(a, b)


def test_dataset_bounds_and_labels(spark):
    p = panel(30)
    d = ft.build_dataset(spark.createDataFrame(p), KEYS, [3, 10], [1, 5], K.OUTCOMES).toPandas()
    for lb in (3, 10):
        for h in (1, 5):
            part = d[(d.ch == "a") & (d.lookback == lb) & (d.horizon == h)].sort_values("date")
            assert len(part) == 30 - lb - h + 1
            one = p[p.ch == "a"].reset_index(drop=True)
            for r in part.itertuples():
                f = one.iloc[r.row_no - 1:r.row_no - 1 + h]
                assert r.inc_count_sum3 == float(f["inc_count"].sum() >= 3) and r.reach_score_max4 == float(f["reach_score"].max() >= 4)
                assert r.fire_count_sum1 == float(f["fire_count"].sum() > 0)


def test_baseline_and_recurrence_edges(spark):
    p = panel(8, ("a",))
    p["s_mention"], p["inc_count"] = 3, 0
    got = ft.build_features(spark.createDataFrame(p), KEYS, [4]).orderBy("date").toPandas()
    assert got["s_mention_zscore"].tolist() == [3.0, 0, 0, 0]      # four rows: mean 0, deviation 1; later a constant series
    assert got["days_since_last_incident"].eq(4).all() and got["recent_incident_rate"].eq(0).all() and got["incident_momentum"].eq(0).all()
    x = pd.DataFrame({"ch": "a", "date": [D0 + dt.timedelta(days=i) for i in range(4)], **{c: 0 for c in [*K.INCIDENT_DAILY, *K.SIGNALS_EXT]}})
    x["s_mention"] = [0, 0, 1, 0]
    row = ft.build_features(spark.createDataFrame(x), KEYS, [3]).first()
    assert row["s_mention_ewm"] == pytest.approx(1 / (1 + 0.7 + 0.49))


def test_spine_has_no_gaps(spark):
    d = lambda n: D0 + dt.timedelta(days=n)
    zero = {c: 1 for c in K.INCIDENT_DAILY}
    inc = spark.createDataFrame(pd.DataFrame([{"ch": "a", "date": d(5), **zero}, {"ch": "a", "date": d(9), **zero}]))
    sig = spark.createDataFrame(pd.DataFrame([{"ch": "a", "date": d(0), **{c: 2 for c in K.SIGNALS}}, {"ch": "b", "date": d(3), **{c: 2 for c in K.SIGNALS}}]))
    got = daily.full_daily(inc, sig, KEYS).orderBy("ch", "date").toPandas()
    assert got.date.tolist() == [d(i) for i in range(10)] + [d(3)]
    assert got.inc_count.tolist() == [0] * 5 + [1, 0, 0, 0, 1] + [0] and got.s_broad.tolist() == [2] + [0] * 9 + [2]


def test_next_day_row_is_the_scoring_row(spark):
    p = panel(20)
    latest = ft.latest_window(spark.createDataFrame(p), KEYS, [5]).orderBy("ch").toPandas()
    assert latest.data_through.tolist() == [D0 + dt.timedelta(days=19)] * 2
    want = brute_features(pd.concat([p[p.ch == "a"], p[p.ch == "a"].tail(1)]).reset_index(drop=True), 20, 5)
    np.testing.assert_allclose(latest.loc[0, list(want)].astype(float), list(want.values()), atol=1e-9)


def test_auc_brute_force_with_ties_and_a_hot_score(spark):
    rng = np.random.RandomState(1)
    score = np.where(rng.rand(3000) < 0.4, 0.5, np.round(rng.rand(3000), 3))
    y = (rng.rand(3000) < score).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"k": np.where(np.arange(3000) % 10, "big", "small"), "s": score, "y": y}))
    pos, neg = score[y == 1], score[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert evaluate.roc_auc(df, "s", "y", []).first()["auc"] == pytest.approx(want)
    for r in evaluate.roc_auc(df, "s", "y", ["k"]).collect():
        m = np.where(np.arange(3000) % 10, "big", "small") == r["k"]
        assert r["auc"] == pytest.approx(models.auc_of(y[m], score[m]))


def test_auc_edges(spark):
    df = spark.createDataFrame([("eq", 0.3, 1), ("eq", 0.3, 0), ("one", 0.1, 1)], "k string, s double, y int")
    got = {r["k"]: r["auc"] for r in evaluate.roc_auc(df, "s", "y", ["k"]).collect()}
    assert got == {"eq": 0.5, "one": None}


def test_folds_of_ten(spark):
    df = spark.createDataFrame([("a", D0 + dt.timedelta(days=i)) for i in range(10)], "ch string, date date")
    got = [(r["n_train"], r["n_test"]) for r in evaluate.fold_sizes(evaluate.time_folds(df, KEYS), KEYS).orderBy("fold").collect()]
    assert got == [(4, 2), (6, 2), (8, 2)] == [(a, b - a) for a, b in models.folds_of(10)]


def test_lagged_correlation_finds_a_planted_lead(spark):
    p = panel(80, ("a",))
    p["inc_count"] = p["s_site"].shift(3).fillna(0).astype(int)
    ccf = correlate.lagged_corr(spark.createDataFrame(p), KEYS)
    best = {r["feature"]: (r["best_lag"], r["pearson_r"]) for r in correlate.best_positive_lag(ccf, KEYS).collect()}
    assert best["s_site"][0] == 3 and best["s_site"][1] == pytest.approx(1.0)
    one = ccf.filter("feature = 's_broad' and lag = -2").first()
    assert one["pearson_r"] == pytest.approx(np.corrcoef(p["s_broad"][2:], p["inc_count"][:-2])[0, 1])
    few = correlate.lagged_corr(spark.createDataFrame(p.head(12)), KEYS).toPandas()
    assert few[few.lag == 5].pearson_r.isna().all() and few[few.lag == 2].pearson_r.notna().any()


def test_logit_reaches_the_optimum():
    rng = np.random.RandomState(0)
    x = rng.randn(200, 5)
    y = (x[:, 0] + 0.5 * rng.randn(200) > 0.3).astype(float)
    beta = models.logit_fit(x, y)
    w = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    p = models.logit_prob(x, beta)
    np.testing.assert_allclose(x.T @ (w * (p - y)) + beta[:-1], 0, atol=1e-6)
    assert abs((w * (p - y)).sum()) < 1e-6 and models.auc_of(y, p) > 0.9


def planted(n=120):
    p = panel(n, ("a", "b"))
    lead = p.groupby("ch")["s_mention"].shift(1).fillna(0)
    p["inc_count"] = (lead >= 3).astype(int)
    p["significant"] = p["inc_count"]
    return p


def test_grid_beats_baseline_on_planted_signal(spark):
    g = models.grid_search(spark.createDataFrame(planted()), KEYS, lookbacks=[2, 5], horizons=[1, 3]).toPandas()
    assert len(g) == 2 * 2 * 2 * 2 and g.auc.dropna().between(0, 1).all()
    best = g[(g.horizon == 1) & (g.outcome == "inc_count_sum1")]
    assert (best.auc > 0.9).all() and (best.lift > 0.2).all()


def test_grid_reports_single_class_and_short_series(spark):
    p = panel(12, ("a",))
    p["inc_count"] = 1
    g = models.grid_search(spark.createDataFrame(p), KEYS, lookbacks=[2, 30], horizons=[1]).toPandas()
    assert set(g.lookback) == {2} and g[g.outcome == "inc_count_sum1"].note.tolist() == ["one_class"]


def test_bank_scoring_and_backtest(spark):
    p = planted()
    df = spark.createDataFrame(p).persist()
    cfgs = [{"outcome": "inc_count_sum1", "lookback": 2, "horizon": 1}, {"outcome": "reach_score_max4", "lookback": 2, "horizon": 1}]
    bank = models.train_bank(df, KEYS, cfgs, K.OUTCOMES).persist()
    rows = {(r["ch"], r["outcome"]): r for r in models.score(ft.latest_window(df, KEYS, [2]), bank, KEYS).collect()}
    for s in ("a", "b"):
        last = p[p.ch == s]["s_mention"].iloc[-1]
        r = rows[s, "inc_count_sum1"]
        assert r["status"] == "ok" and r["predicted"] == (last >= 3) and len(r["top_features"]) == 4
        m = bank.filter((F.col("ch") == s) & (F.col("outcome") == "inc_count_sum1")).first()
        x = brute_features(pd.concat([p[p.ch == s], p[p.ch == s].tail(1)]).reset_index(drop=True), 120, 2)
        z = (np.array([x[f] for f in m["features"]]) - np.array(m["mean"])) / np.array(m["scale"])
        assert r["prob"] == pytest.approx(1 / (1 + np.exp(-(z @ np.array(m["coef"]) + m["intercept"]))))
    spec = K.GRID_TARGETS[0]
    bt = models.backtest(df, KEYS, bank, spec, 2, 1, 30).toPandas()
    assert len(bt) == 60 and bt.correct.mean() > 0.9
    imp = models.permutation_importance(df, KEYS, bank, spec, 2, 1, repeats=3).toPandas()
    assert len(imp) == 2 * 87 and imp.loc[imp.importance_mean.idxmax(), "feature"].startswith("s_mention")
    missing = models.score(ft.latest_window(df, KEYS, [5]), bank, KEYS).filter("outcome = 'inc_count_sum1'").first()
    assert missing["status"] == "history_too_short" and missing["prob"] is None


def test_nearest_centroid_and_regime_serving(spark):
    df = spark.createDataFrame([("a", D0, 0.1, 0.0, False), ("a", day1(), 5.0, 0.0, False), ("a", D0, 0.0, 9.0, True)], "ch string, date date, x double, y double, cold boolean")
    got = [r["regime"] for r in clusters.assign_regimes(df, KEYS, ["x", "y"], [[0, 0], [5, 0]]).orderBy("cold", "x").collect()]
    assert got == [0, 1, -1]
    bank = spark.createDataFrame([("a", 1, "o", 2, 1, "trained"), ("a", 2, "o", 2, 1, "trained"), ("a", 0, "o", 2, 1, "skipped")],
                                 "ch string, regime int, outcome string, lookback int, horizon int, status string")
    now = spark.createDataFrame([("a", 0, False)], "ch string, regime int, ood boolean")
    r = clusters.serve_regime(bank, now, [[0, 0], [3, 0], [2, 0]], KEYS).first()
    assert (r["regime"], r["ood"]) == (2, True)
    own = clusters.serve_regime(bank, spark.createDataFrame([("a", 1, False)], "ch string, regime int, ood boolean"), [[0, 0], [3, 0], [2, 0]], KEYS).first()
    assert (own["regime"], own["ood"]) == (1, False)


def day1():
    return D0 + dt.timedelta(days=1)


def test_kmeans_profiles_separate_planted_groups(spark):
    rng = np.random.RandomState(0)
    x = np.vstack([rng.randn(40, 2) + c for c in ((0, 0), (8, 0), (0, 8))])
    df = spark.createDataFrame(pd.DataFrame({"f1": x[:, 0], "f2": x[:, 1], "o": np.repeat([0.0, 1.0, 0.0], 40)}))
    p = clusters.find_profiles(df, ["f1", "f2"], ["o"], k=3).toPandas()
    assert sorted(p.n) == [40, 40, 40] and sorted(p.o.round(3)) == [0, 0, 1] and sorted(map(list, p.dominant)) == [[], ["f1"], ["f2"]]


def test_analogs_equal_brute_force(spark):
    p = panel(70, ("a", "b"), seed=3)   # no z-score of exactly one, where float noise would decide
    df = spark.createDataFrame(p)
    got = analogs.find_analogs(df, KEYS, 10, 5, 14).orderBy("ch", "rank").toPandas()
    one = p[p.ch == "a"].reset_index(drop=True)
    grown = pd.concat([one, one.tail(1)]).reset_index(drop=True)
    x = np.array([[brute_features(grown, i, 10)[f] for f in ft.feature_names()] for i in range(10, 71)], float)
    sd = x[:-1].std(axis=0)
    sd[sd < 1e-9] = 1
    dist = np.linalg.norm((x[:-1] - x[-1]) / sd, axis=1)
    ok = [j for j in range(60) if j + 10 <= 70 - 14 - 1]
    top = sorted(ok, key=lambda j: dist[j])[:5]
    mine = got[got.ch == "a"]
    assert mine.date.tolist() == [one.date[j + 10] for j in top]
    np.testing.assert_allclose(mine.dist, dist[top], atol=1e-8)


def test_summary_rejections(spark):
    rows = [("t", 1, 1, 0.9, 0.2, 0.5, 0.1, 3), ("t", 2, 3, 0.6, 0.3, 0.5, 0.1, 3), ("u", 1, 1, 0.4, 0.1, 0.9, 0.0, 3), ("u", 1, 2, 0.45, 0.3, 0.9, 0.0, 3)]
    g = spark.createDataFrame(rows, "target string, lookback int, horizon int, auc double, auc_std double, pos_rate double, lift double, n_folds int")
    got = [(r["target"], r["horizon"], r["tier"]) for r in evaluate.select_configs(g, ["target"]).orderBy("target", "rank").collect()]
    assert got == [("t", 1, 2), ("u", 1, 3), ("u", 2, 3)]


def test_bank_takes_its_configurations_from_the_grid(spark):
    cols = "ch string, outcome string, lookback int, horizon int, auc double, auc_std double, pos_rate double, n_folds int"
    rows = [("a", "o", 1, 1, 0.6, 0.1, 0.2, 3), ("a", "o", 2, 1, 0.7, 0.1, 0.2, 3), ("a", "o", 3, 1, 0.7, 0.1, 0.2, 3), ("a", "o", 4, 1, 0.9, 0.1, 0.2, 2),
            ("a", "o", 1, 4, 0.8, 0.1, 0.2, 3), ("a", "o", 5, 2, None, None, 0.0, 0), ("a", "o", 6, 2, None, None, 0.0, 0), ("b", "o", 1, 1, 0.6, 0.1, 0.2, 3)]
    got = evaluate.bank_configs(spark.createDataFrame(rows, cols), ["ch"], [1, 2], [{"outcome": "p", "lookback": 7, "horizon": 9}])
    # Per horizon, best parameters (two folds are enough there), fixed; (b, o, 1, 1) is both and comes once.
    assert sorted(map(tuple, got.collect())) == [("a", "o", 2, 1), ("a", "o", 4, 1), ("a", "o", 5, 2), ("a", "p", 7, 9), ("b", "o", 1, 1), ("b", "p", 7, 9)]


def test_bank_of_chosen_configurations_equals_the_fixed_bank(spark):
    rng, start = np.random.RandomState(3), dt.date(2022, 1, 1)
    counters = [*K.INCIDENT_DAILY, *K.SIGNALS_EXT]
    rows = [(s, start + dt.timedelta(days=i), *[int(v) for v in rng.poisson(0.6, len(counters))]) for s in "ab" for i in range(80)]
    d = spark.createDataFrame(rows, "ch string, date date, " + ", ".join(f"{c} long" for c in counters))
    chosen = [("a", K.ANY, 2, 1), ("a", K.SIGNIFICANT, 2, 3), ("b", K.ANY, 3, 3)]
    got = models.train_chosen(d, ["ch"], spark.createDataFrame(chosen, "ch string, outcome string, lookback int, horizon int"), K.GRID_TARGETS, [2, 3], [1, 3]).collect()
    assert sorted((r.ch, r.outcome, r.lookback, r.horizon) for r in got) == sorted(chosen)
    configs = [{"outcome": o, "lookback": lb, "horizon": h} for _, o, lb, h in chosen]
    want = {(r.ch, r.outcome, r.lookback, r.horizon): r for r in models.train_bank(d, ["ch"], configs, K.GRID_TARGETS).collect()}
    for r in got:
        w = want[r.ch, r.outcome, r.lookback, r.horizon]
        assert (r.status, r.n, r.n_folds) == (w.status, w.n, w.n_folds) and np.allclose(r.coef or [], w.coef or [])


def test_regime_bank_uses_the_detected_regimes(spark, sf, monkeypatch):
    from sigtide.plans import model_plans

    monkeypatch.setattr(clusters, "choose_k", lambda *a, **k: 2)
    monkeypatch.setattr(clusters, "fit_kmeans", lambda *a, **k: [[100.0] * 4, [0.0] * 4])
    monkeypatch.setattr(clusters, "train_regime_bank", lambda daily, keys, regimes: regimes)
    monkeypatch.setattr(clusters, "regime_summary", lambda bank, regimes, keys: bank)
    assert {r.regime for r in model_plans.regime_bank(spark, sf).select("regime").distinct().collect()} == {-1, 1}


def test_recent_window_bank_has_every_predictor_configuration(spark, monkeypatch):
    from sigtide.plans import model_plans

    p = planted(80).assign(macro_area=lambda d: d["ch"]).drop(columns="ch")
    monkeypatch.setattr(model_plans, "long_daily", lambda spark, sf: spark.createDataFrame(p))
    got = model_plans.recent_window_bank(spark, "").collect()
    want = {(s, c["outcome"], c["lookback"], c["horizon"]) for s in "ab" for c in K.PREDICTOR_CONFIGS}
    assert len(got) == len(want) and {(r.macro_area, r.outcome, r.lookback, r.horizon) for r in got} == want


def linked_rows(types):
    """Six links of each type on days 3, 13, .. of series a; series b has the first type alone."""
    rows = [("a", D0 + dt.timedelta(days=3 + 10 * k + i), t) for i, t in enumerate(types) for k in range(6)]
    rows += [("b", D0 + dt.timedelta(days=k), types[0].upper() + " ") for k in range(3)]
    return rows + [("a", D0, "Rare kind"), ("a", D0, "Other"), ("b", D0, None), ("a", D0 + dt.timedelta(days=3), types[0])]


def test_types_are_what_the_rows_hold(spark):
    types = ["depot", "rail yard", "port/quay", "mill", "plant", "bridge", "seventh kind"]
    names = ["type_" + t.replace(" ", "_").replace("/", "_") for t in types]
    rows = linked_rows(types)
    got = daily.type_outcomes(spark.createDataFrame(rows, "ch string, date date, site_type string"), KEYS)
    want = {(s, d, "type_" + t.strip().lower().replace(" ", "_").replace("/", "_")) for s, d, t in rows if t not in (None, "Other", "Rare kind")}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    wide = daily.type_days(got, KEYS)
    assert wide.columns == ["ch", "date", *sorted(names)]
    assert {(r["ch"], r["date"], n) for r in wide.collect() for n in names if r[n]} == want
    with pytest.raises(ValueError, match="long form"):
        daily.type_columns(got, most=6)
    none = daily.type_outcomes(spark.createDataFrame([], "ch string, date date, site_type string"), KEYS)
    assert daily.type_days(none, KEYS).columns == KEYS + ["date"] and daily.type_days(none, KEYS).count() == 0


def test_types_become_outcomes_of_the_grid_and_the_bank(spark):
    types = ["depot", "seventh kind"]
    panel_ = panel(60, ("a", "b"))
    df, rows = spark.createDataFrame(panel_), spark.createDataFrame(linked_rows(types), "ch string, date date, site_type string")
    long = daily.type_outcomes(rows, KEYS)
    days = {(r["ch"], r["outcome"], r["date"]) for r in long.collect()}
    ahead = ft.next_types(df.select("ch", "date"), long, KEYS, 5).collect()
    assert len(ahead) == len(panel_)
    for r in ahead:
        want = {}
        for wait in range(5):
            for s, o, d in days:
                if s == r["ch"] and d == r["date"] + dt.timedelta(days=wait):
                    want.setdefault(o, wait)
        assert dict(zip(r["ahead_outcome"], r["ahead_wait"])) == want and r["ahead_outcome"] == sorted(want)
    grid = models.grid_search(df, KEYS, lookbacks=[2, 5], horizons=[1, 3], with_baseline=False, types=long)
    found = {(r["ch"], r["outcome"], r["lookback"], r["horizon"]): r for r in grid.collect()}
    assert {(k[0], k[1]) for k in found if k[1].startswith("type_")} == {("a", "type_depot"), ("a", "type_seventh_kind"), ("b", "type_depot")}
    assert ("b", "type_depot", 2, 1) in found and ("b", "type_depot", 5, 1) not in found   # its days are 0 to 2
    r, dates = found["a", "type_seventh_kind", 5, 3], sorted(panel_[panel_.ch == "a"]["date"])
    y = [any(("a", "type_seventh_kind", d + dt.timedelta(days=k)) in days for k in range(3)) for d in dates[5:-2]]
    assert r["n"] == len(y) and r["pos_rate"] == pytest.approx(np.mean(y))
    plain = models.grid_search(df, KEYS, lookbacks=[2], horizons=[1], with_baseline=False)
    key = ["ch", "outcome", "lookback", "horizon"]
    for a in plain.collect():
        assert found[tuple(a[k] for k in key)] == a
    chosen = grid.select(*KEYS, "outcome", "lookback", "horizon").where("lookback = 5 and horizon = 3 and outcome like 'type%'")
    trained = models.train_chosen(df, KEYS, chosen, K.GRID_TARGETS, [2, 5], [1, 3], types=long).collect()
    assert {(m["outcome"], m["n"], m["status"]) for m in trained} == {("type_depot", len(y), "trained"), ("type_seventh_kind", len(y), "trained")}


def test_plan_does_not_grow_with_the_types(spark):
    df = spark.createDataFrame(panel(40, ("a",)))

    def size(types):
        long = daily.type_outcomes(spark.createDataFrame(linked_rows(types), "ch string, date date, site_type string"), KEYS)
        return models.training_table(df, KEYS, [2], K.GRID_TARGETS, [1], long)._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert size(["one"]) == size([f"kind {i}" for i in range(300)])
