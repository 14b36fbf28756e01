"""Window features and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.operators import features as ft
from sigtide.plans import oracle as o
from sigtide.plans.common import LONG, SHORT, long_daily, rounded, short_daily
from sigtide.plans.registry import query


def _features(spark, sf, lookback, names, keys=LONG):
    daily = long_daily(spark, sf) if keys == LONG else short_daily(spark, sf)
    return rounded(ft.build_features(daily, keys, [lookback], few_series=True).select(*keys, "date", *names), *names)


def _names(*parts: str) -> list[str]:
    return [n for n in ft.feature_names() if any(n.endswith(f"_{p}") for p in parts)]


_SUMS = [*_names("sum", "lag1", "lag3", "lag7"), "s_mention_x_s_report"]


@query("W4 W6 W10", o.feature_query(o.LONG_DAILY, "macro_area", 10, names=_SUMS))
def features_sums_lags(spark, sf):
    return _features(spark, sf, 10, _SUMS)


_TRENDS = _names("ewm", "slope")


@query("W5 W7", o.feature_query(o.LONG_DAILY, "macro_area", 7, names=_TRENDS))
def features_trends(spark, sf):
    return _features(spark, sf, 7, _TRENDS)


_ALERTS = _names("zscore", "alert_days")


@query("W1 W8 W9", o.feature_query(o.LONG_DAILY, "macro_area", 14, names=_ALERTS))
def features_alerts(spark, sf):
    return _features(spark, sf, 14, _ALERTS)


_CONTEXT = [c for c in ft.CONTEXT if c != "s_mention_x_s_report"]


@query("W11 W12", o.feature_query(o.LONG_DAILY, "macro_area", 10, names=_CONTEXT))
def features_context(spark, sf):
    return _features(spark, sf, 10, _CONTEXT)


@query("W13 P7 D4", o.feature_query(o.SHORT_DAILY, "channel", 10, names=ft.feature_names()))
def features_all(spark, sf):
    return _features(spark, sf, 10, ft.feature_names(), SHORT)


@query("W13 W6", o.feature_query(o.SHORT_DAILY, "channel", 2, names=ft.feature_names()))
def features_short_lookback(spark, sf):
    return _features(spark, sf, 2, ft.feature_names(), SHORT)


@query("W1", o.LONG_DAILY + f""", w AS (SELECT *, count(*) OVER f AS c, {', '.join(f'avg({s}) OVER f AS m_{s}, stddev_samp({s}) OVER f AS d_{s}' for s in K.SIGNALS)}
  FROM full_daily WINDOW f AS (PARTITION BY macro_area ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT macro_area, date, {', '.join(f"round(CASE WHEN c >= 5 THEN m_{s} ELSE 0 END, 6) AS mean_{s}, round(CASE WHEN c >= 5 AND d_{s} > 1e-9 THEN d_{s} ELSE 1 END, 6) AS std_{s}" for s in K.SIGNALS)} FROM w""")
def rolling_baseline(spark, sf):
    w = ft.series_window(LONG)
    cols, names = [], []
    for s in K.SIGNALS:
        mean, std = ft.baseline(s, w)
        cols += [mean.alias(f"mean_{s}"), std.alias(f"std_{s}")]
        names += [f"mean_{s}", f"std_{s}"]
    return rounded(long_daily(spark, sf).select("macro_area", "date", *cols), *names)


_H = [1, 3, 14]
_SPECS = [*K.OUTCOMES, {"name": "total", "col": "inc_count", "op": "sum"}, {"name": "peak", "col": "inc_count", "op": "max"},
          {"name": "missing", "col": "no_such_column", "op": "sum_ge"}]


def _outcome_sql(s: dict, h: int) -> str:
    if s["name"] == "missing":
        return "0.0"
    w = f"OVER (PARTITION BY macro_area ORDER BY date ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)"
    total, top, t = f"sum({s['col']}) {w}", f"max({s['col']}) {w}", s.get("threshold", 1)
    return {"sum_ge": f"CAST({total} >= {t} AS DOUBLE)",
            "max_ge": f"CAST({top} >= {t} AS DOUBLE)", "sum": f"CAST({total} AS DOUBLE)", "max": f"CAST({top} AS DOUBLE)"}[s["op"]]


@query("W15", o.LONG_DAILY + " " + " UNION ALL ".join(
    f"SELECT macro_area, date, {h} AS horizon, {', '.join(_outcome_sql(s, h) + ' AS ' + s['name'] for s in _SPECS)} FROM full_daily" for h in _H))
def outcome_labels(spark, sf):
    labels = ft.build_labels(long_daily(spark, sf), LONG, _H, _SPECS)
    return labels.select("macro_area", "date", F.explode("labels").alias("l")).select("macro_area", "date", "l.*")


_DATA_NAMES = ["s_mention_sum", "s_broad_ewm", "s_site_alert_days", "recent_incident_rate"]


def _dataset_sql() -> str:
    parts = []
    for lb in (2, 10):
        parts.append((lb, o.feature_query("WITH", "macro_area", lb).split("WITH,", 1)[1]))
    ctes = o.LONG_DAILY
    selects = []
    for lb, body in parts:
        for name in ("numbered", "raw", "feats"):
            body = body.replace(f"{name} AS (", f"{name}{lb} AS (").replace(f"FROM {name} ", f"FROM {name}{lb} ").replace(f"FROM {name})", f"FROM {name}{lb})")
        ctes += "," + body
        for h in (1, 3):
            cols = ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in _DATA_NAMES)
            selects.append(f"SELECT macro_area, date, {lb} AS lookback, {h} AS horizon, {cols}, inc_count_sum1, significant_sum1 FROM feats{lb} "
                           f"JOIN lab{h} USING (macro_area, date) WHERE rn <= n - {h} + 1")
    for h in (1, 3):
        w = f"OVER (PARTITION BY macro_area ORDER BY date ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)"
        ctes += (f", lab{h} AS (SELECT macro_area, date, CAST(sum(inc_count) {w} > 0 AS DOUBLE) AS inc_count_sum1, "
                 f"CAST(sum(significant) {w} > 0 AS DOUBLE) AS significant_sum1 FROM full_daily)")
    return ctes + " " + " UNION ALL ".join(selects)


@query("W14 W16 J10 U2", _dataset_sql())
def training_rows(spark, sf):
    """Two lookbacks by two horizons in one plan: the configuration grid is data."""
    data = ft.build_dataset(long_daily(spark, sf), LONG, [2, 10], [1, 3], K.GRID_TARGETS)
    return rounded(data.select("macro_area", "date", "lookback", "horizon", *_DATA_NAMES, K.ANY, K.SIGNIFICANT), *_DATA_NAMES)


@query("W17", o.LONG_DAILY + """, j AS (SELECT a.macro_area, a.date, min(b.date) AS nxt FROM full_daily a JOIN full_daily b
  ON b.macro_area = a.macro_area AND b.date > a.date AND b.date <= a.date + 14 AND b.fire_count > 0 GROUP BY ALL)
SELECT macro_area, date, datediff('day', date, nxt) AS days_to_next FROM full_daily LEFT JOIN j USING (macro_area, date)""")
def days_to_next(spark, sf):
    frame = ft.series_window(LONG).rowsBetween(1, K.ANALOG_HORIZON)
    nxt = F.min(F.when(F.col("fire_count") > 0, F.col("date"))).over(frame)
    return long_daily(spark, sf).select("macro_area", "date", F.datediff(nxt, "date").alias("days_to_next"))


@query("W3", o.LONG_DAILY + f""", w AS (SELECT *, row_number() OVER (PARTITION BY macro_area ORDER BY date) AS rn FROM full_daily)
SELECT macro_area, date, {', '.join(f"round(CASE WHEN count(*) OVER f >= 10 THEN avg({s}) OVER f ELSE 0 END, 6) AS {s}" for s in K.REGIME_SIGNALS)}, rn <= 30 AS cold
FROM w WINDOW f AS (PARTITION BY macro_area ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def regime_signals(spark, sf):
    from sigtide.operators.clusters import rolling_signals
    return rounded(rolling_signals(long_daily(spark, sf), LONG), *K.REGIME_SIGNALS)
