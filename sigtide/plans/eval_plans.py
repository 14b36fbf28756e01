"""Evaluation, quality gates, clustering by given centroids, nearest vectors, analogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions import scoring
from sigtide.operators import analogs, clusters, evaluate
from sigtide.operators import features as ft
from sigtide.plans import oracle as o
from sigtide.plans.common import LONG, long_daily, rounded
from sigtide.plans.registry import query
from sigtide.sources import testdata as td

# ── scores over labelled documents ────────────────────────────────────────────

_SCORED = """scored AS (SELECT lang, quality, round((n_chars % 97) / 97.0 * 0.7 + CASE WHEN n_chars > 500 THEN 0.3 ELSE 0 END, 2) AS score
  FROM labels JOIN documents USING (doc_id))"""


def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    score = F.round((n % 97) / 97.0 * 0.7 + F.when(n > 500, 0.3).otherwise(0.0), 2)
    return td.table(spark, sf, "labels").join(td.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select(
        "lang", "quality", score.alias("score"))


def _auc_sql(src: str, key: str, score: str, label: str) -> str:
    part = f"PARTITION BY {key} " if key else ""
    head = f"{key}, " if key else ""
    group = f" GROUP BY {key}" if key else ""
    return f"""SELECT {head}round(CASE WHEN p > 0 AND q > 0 THEN (rs - p * (p + 1) / 2.0) / (p * q) END, 6) AS auc, p AS n_pos, q AS n_neg FROM (
  SELECT {head}sum(r) FILTER ({label} = 1) AS rs, count(*) FILTER ({label} = 1) AS p, count(*) FILTER ({label} <> 1) AS q FROM (
    SELECT *, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER ({part.rstrip()}{',' if part else 'PARTITION BY'} {score}) - 1) / 2.0 AS r FROM {src}){group})"""


@query("A16", f"WITH {_SCORED} {_auc_sql('scored', 'lang', 'score', 'quality')}")
def auc_by_language(spark, sf):
    return rounded(evaluate.roc_auc(scored_documents(spark, sf), "score", "quality", ["lang"]), "auc")


@query("A16", f"WITH {_SCORED} {_auc_sql('scored', '', 'score', 'quality')}")
def auc_overall(spark, sf):
    return rounded(evaluate.roc_auc(scored_documents(spark, sf), "score", "quality", []), "auc")


@query("A16", "WITH s AS (SELECT o_totalprice AS score, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders) " + _auc_sql("s", "", "score", "y"))
def auc_of_orders(spark, sf):
    """A single AUC over a large table: the ranking spreads over score ranges."""
    s = td.table(spark, sf, "orders").select(F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return rounded(evaluate.roc_auc(s, "score", "y", []), "auc")


@query("A17", f"""WITH {_SCORED}, c AS (SELECT *, score > 0.5 AS called FROM scored)
SELECT lang, round(CASE WHEN count(*) FILTER (called) + count(*) FILTER (quality = 1) > 0 THEN 2.0 * count(*) FILTER (called AND quality = 1)
  / (count(*) FILTER (called) + count(*) FILTER (quality = 1)) ELSE 0 END, 6) AS f1, round(avg(quality), 6) AS pos_rate,
  round(avg(CAST(called = (quality = 1) AS INTEGER)), 6) AS accuracy, count(*) AS n FROM c GROUP BY 1""")
def classification_metrics(spark, sf):
    m = evaluate.class_metrics(scored_documents(spark, sf), F.col("score") > 0.5, F.col("quality"), ["lang"])
    return rounded(m, "f1", "pos_rate", "accuracy")


_FOLDS = """, r AS (SELECT *, row_number() OVER (PARTITION BY macro_area ORDER BY date) AS rn, count(*) OVER (PARTITION BY macro_area) AS n FROM full_daily),
folds AS (SELECT *, CASE WHEN rn <= n - 3 * (n // 4) THEN 0 ELSE (rn - 1 - (n - 3 * (n // 4))) // (n // 4) + 1 END AS fold FROM r)"""


@query("ML2", o.LONG_DAILY + _FOLDS + """, c AS (SELECT macro_area, CAST(fold AS INTEGER) AS fold, count(*) AS n_test FROM folds GROUP BY ALL)
SELECT * FROM (SELECT *, sum(n_test) OVER (PARTITION BY macro_area ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS n_train FROM c) WHERE fold > 0""")
def time_folds(spark, sf):
    return evaluate.fold_sizes(evaluate.time_folds(long_daily(spark, sf), LONG), LONG)


@query("A15 A16 ML2", o.LONG_DAILY + _FOLDS + """, s AS (SELECT macro_area, fold, lag(s_broad) OVER (PARTITION BY macro_area ORDER BY date) AS score,
  CAST(inc_count > 0 AS INTEGER) AS y FROM folds), t AS (SELECT * FROM s WHERE fold > 0 AND score IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY macro_area, fold ORDER BY score) + (count(*) OVER (PARTITION BY macro_area, fold, score) - 1) / 2.0 AS r FROM t),
a AS (SELECT macro_area, fold, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
  / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM k GROUP BY ALL)
SELECT macro_area, round(avg(auc), 6) AS auc, round(stddev_pop(auc), 6) AS auc_std, count(auc) AS n_folds FROM a GROUP BY 1""")
def fold_auc(spark, sf):
    """AUC per time fold of yesterday's broad count as a score for incidents today, then mean and deviation."""
    w = ft.series_window(LONG)
    f = evaluate.time_folds(long_daily(spark, sf), LONG).select(
        "macro_area", "fold", F.lag("s_broad").over(w).alias("score"), (F.col("inc_count") > 0).cast("int").alias("y"))
    aucs = evaluate.roc_auc(f.filter(F.col("fold") > 0), "score", "y", ["macro_area", "fold"])
    return rounded(evaluate.fold_summary(aucs, LONG, "auc"), "auc", "auc_std")


# ── quality gates over a grid table derived from parts ────────────────────────

_GRID = """grid AS (SELECT p_brand AS target, CAST(p_partkey % 13 + 1 AS INTEGER) AS lookback, CAST(p_size % 12 + 1 AS INTEGER) AS horizon,
  round(avg(CASE WHEN p_partkey % 17 <> 0 THEN 0.44 + (p_partkey * 7 % 101) / 500.0 END), 6) AS auc, round(avg((p_partkey * 3 % 41) / 200.0), 6) AS auc_std,
  round(avg((p_partkey * 11 % 97) / 97.0), 6) AS pos_rate, round(avg(-0.03 + (p_partkey * 13 % 59) / 500.0), 6) AS lift,
  CAST(min(p_partkey % 4) AS INTEGER) AS n_folds FROM part GROUP BY ALL)"""


def grid_table(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    p = td.table(spark, sf, "part").select(
        F.col("p_brand").alias("target"), (k % 13 + 1).cast("int").alias("lookback"), (F.col("p_size") % 12 + 1).cast("int").alias("horizon"),
        F.when(k % 17 != 0, 0.44 + (k * 7 % 101) / 500.0).alias("auc"), ((k * 3 % 41) / 200.0).alias("auc_std"),
        ((k * 11 % 97) / 97.0).alias("pos_rate"), (-0.03 + (k * 13 % 59) / 500.0).alias("lift"), (k % 4).alias("n_folds"))
    mean = [F.round(F.avg(c), 6).alias(c) for c in ("auc", "auc_std", "pos_rate", "lift")]
    return p.groupBy("target", "lookback", "horizon").agg(*mean, F.min("n_folds").cast("int").alias("n_folds"))


_REJECT = """CASE WHEN auc IS NULL THEN 'no_auc' WHEN pos_rate > 0.70 THEN 'pos_rate' WHEN auc_std > 0.15 THEN 'auc_std'
  WHEN auc < 0.52 THEN 'auc' WHEN lift < 0.01 THEN 'lift' END"""


@query("ML10", f"WITH {_GRID} SELECT target, lookback, horizon, {_REJECT} AS rejected, CASE {_REJECT} WHEN 'pos_rate' THEN pos_rate WHEN 'auc_std' THEN auc_std WHEN 'auc' THEN auc WHEN 'lift' THEN lift END AS value FROM grid")
def rejection_reasons(spark, sf):
    g = evaluate.with_rejection(grid_table(spark, sf))
    return g.select("target", "lookback", "horizon", F.col("rejected.code").alias("rejected"), F.col("rejected.value").alias("value"))


_TIERS = f"""WITH {_GRID}, g AS (SELECT *, {_REJECT} IS NULL AS t1, pos_rate <= 0.70 AND coalesce(auc, 0) >= 0.52 AND coalesce(lift, 0.01) >= 0.01 AS t2 FROM grid),
b AS (SELECT *, bool_or(t1) OVER w AS any1, min(horizon) FILTER (t2) OVER w AS h2 FROM g WINDOW w AS (PARTITION BY target)),
t AS (SELECT *, CASE WHEN any1 THEN CASE WHEN t1 THEN 1 END WHEN h2 IS NOT NULL THEN CASE WHEN t2 AND horizon <= h2 THEN 2 END
  WHEN auc IS NOT NULL AND auc_std IS NOT NULL THEN 3 END AS tier FROM b)"""


@query("ML8 O3", f"""{_TIERS} SELECT target, lookback, horizon, auc, auc_std, pos_rate, lift, n_folds, tier,
  row_number() OVER (PARTITION BY target ORDER BY CASE WHEN tier = 3 THEN auc - auc_std ELSE auc END DESC, lookback, horizon) AS rank
FROM t WHERE tier IS NOT NULL QUALIFY rank <= 3""")
def selected_configs(spark, sf):
    return evaluate.select_configs(grid_table(spark, sf), ["target"])


@query("ML9", f"""WITH {_GRID}, u AS (SELECT *, CASE WHEN auc >= 0.52 AND pos_rate <= 0.70 AND auc_std <= 0.15 THEN 1
  WHEN auc >= 0.52 AND pos_rate <= 0.70 THEN 2 WHEN auc >= 0.52 THEN 3 ELSE 4 END AS tier FROM grid WHERE auc IS NOT NULL AND n_folds >= 2)
SELECT target, lookback, horizon, auc, auc_std, tier FROM u QUALIFY row_number() OVER (PARTITION BY target ORDER BY tier, auc DESC, lookback, horizon) = 1""")
def best_parameters(spark, sf):
    return evaluate.best_params(grid_table(spark, sf), ["target"])


@query("A13 R2 O5", f"""WITH {_GRID} SELECT * FROM grid WHERE auc IS NOT NULL AND n_folds >= 3
QUALIFY row_number() OVER (PARTITION BY target, horizon ORDER BY auc DESC, lookback, horizon) = 1""")
def best_per_horizon(spark, sf):
    return evaluate.best_by(grid_table(spark, sf), ["target", "horizon"])


@query("ML7 A13", f"""WITH {_GRID}, u AS (SELECT *, pos_rate > 0.70 AS saturated FROM grid WHERE auc IS NOT NULL AND n_folds >= 2)
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY target ORDER BY saturated, auc DESC, lookback, horizon) = 1""")
def best_under_gate(spark, sf):
    return evaluate.best_under_gate(grid_table(spark, sf), ["target"])


@query("U1 ML12 O3", f"""WITH {_GRID}, p AS (SELECT *, CASE WHEN substr(target, 7)::INTEGER % 2 = 0 THEN 'early' ELSE 'late' END AS period, (substr(target, 7)::INTEGER + 1) // 2 AS grp FROM grid),
m AS (SELECT grp, period, lookback, horizon, auc, row_number() OVER (PARTITION BY grp, period ORDER BY auc DESC, lookback, horizon) AS rn FROM p WHERE auc IS NOT NULL),
t AS (SELECT * FROM m WHERE rn <= 20)
SELECT CAST(grp AS BIGINT) AS grp, lookback, horizon, round(a.auc, 6) AS early_auc, round(b.auc, 6) AS late_auc, round(b.auc - a.auc, 6) AS delta
FROM (SELECT * FROM t WHERE period = 'early') a JOIN (SELECT * FROM t WHERE period = 'late') b USING (grp, lookback, horizon)""")
def stable_configs(spark, sf):
    no = F.substring("target", 7, 9).cast("bigint")
    g = grid_table(spark, sf).withColumn("period", F.when(no % 2 == 0, "early").otherwise("late")).withColumn("grp", F.floor((no + 1) / 2))
    return rounded(evaluate.stable_configs(g, ["grp"], 20), "early_auc", "late_auc", "delta")


# ── scaling, nearest vectors, regimes with given centroids ────────────────────

@query("ML1", f"""WITH {o.INC_LONG} SELECT incident_id, round((price - avg(price) OVER w) / stddev_pop(price) OVER w, 6) AS price,
  round((explosions - avg(explosions) OVER w) / stddev_pop(explosions) OVER w, 6) AS explosions FROM inc_long WINDOW w AS (PARTITION BY macro_area)""")
def standardised(spark, sf):
    i = td.incidents_long(spark, sf).select("incident_id", "macro_area", "price", "explosions")
    return rounded(clusters.standardise(i, LONG, ["price", "explosions"]), "price", "explosions").drop("macro_area")


@query("J8 D4 D5", """WITH qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id, label, sqrt(list_sum(list_transform(list_zip(embedding, q),
  lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))) AS dist FROM embeddings, qv),
k AS (SELECT * FROM d ORDER BY dist, vec_id LIMIT 50)
SELECT vec_id, label, round(dist, 5) AS dist, round(1 - dist / (max(dist) OVER () + 1e-9), 5) AS similarity FROM k""")
def nearest_vectors(spark, sf):
    e = td.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    q = e.filter(F.col("vec_id") == 0).select("v").scalar()
    near = analogs.nearest_vectors(e, q, "v", 50)
    top = near.agg(F.max("dist")).scalar() + 1e-9
    out = near.select("vec_id", "label", "dist", (1 - F.col("dist") / top).alias("similarity"))
    return rounded(out, "dist", "similarity", digits=5)


_CENTROIDS = [[-0.8, -0.6, -0.5, -0.4], [0.0, 0.2, 0.1, -0.1], [0.9, 0.8, 1.1, 0.7]]
_ROLL = f""", w AS (SELECT *, row_number() OVER (PARTITION BY macro_area ORDER BY date) AS rn FROM full_daily),
roll AS (SELECT macro_area, date, rn <= 30 AS cold, {', '.join(f"CASE WHEN count(*) OVER f >= 10 THEN avg({s}) OVER f ELSE 0 END AS {s}" for s in K.REGIME_SIGNALS)}
  FROM w WINDOW f AS (PARTITION BY macro_area ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
sc AS (SELECT macro_area, date, cold, {', '.join(f"({s} - avg({s}) OVER k) / stddev_pop({s}) OVER k AS {s}" for s in K.REGIME_SIGNALS)} FROM roll WINDOW k AS (PARTITION BY macro_area))"""


def _dist(c: list[float]) -> str:
    return "sqrt(" + " + ".join(f"pow({s} - {v}, 2)" for s, v in zip(K.REGIME_SIGNALS, c)) + ")"


_ASSIGN = _ROLL + f""", ds AS (SELECT *, [{', '.join(_dist(c) for c in _CENTROIDS)}] AS d FROM sc),
nr AS (SELECT macro_area, date, cold, list_min(d) AS dist, list_position(d, list_min(d)) - 1 AS near FROM ds)"""


def regime_rows(spark: SparkSession, sf: str) -> DataFrame:
    rolled = clusters.rolling_signals(long_daily(spark, sf), LONG)
    scaled = clusters.standardise(rolled, LONG, K.REGIME_SIGNALS)
    return clusters.assign_regimes(scaled, LONG, K.REGIME_SIGNALS, _CENTROIDS)


@query("ML15 W3 U3", o.LONG_DAILY + _ASSIGN + """ SELECT macro_area, date, CASE WHEN cold THEN -1 ELSE CAST(near AS INTEGER) END AS regime, round(dist, 6) AS dist,
  cold OR dist > 2 * quantile_cont(dist, 0.5) OVER (PARTITION BY macro_area) AS ood FROM nr""")
def regime_assignment(spark, sf):
    return rounded(regime_rows(spark, sf).select("macro_area", "date", "regime", "dist", "ood"), "dist")


def regime_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Mean scaled signals of each assigned regime per area: data-derived centroids."""
    r = regime_rows(spark, sf).filter(F.col("regime") >= 0)
    return r.groupBy("macro_area", "regime").agg(*[F.round(F.avg(s), 9).alias(s) for s in K.REGIME_SIGNALS])


_TOP2 = "list_sort([" + ", ".join(f"{{'size': -abs({s}), 'ord': {i}, 't': '{s}' || CASE WHEN {s} > 0 THEN '+' ELSE '-' END}}"
                                for i, s in enumerate(K.REGIME_SIGNALS)) + "])"


@query("ML16 W19 O4", o.LONG_DAILY + _ASSIGN + f""", cent AS (SELECT macro_area, near AS regime, {', '.join(f'round(avg({s}), 9) AS {s}' for s in K.REGIME_SIGNALS)}
  FROM nr JOIN sc USING (macro_area, date) WHERE NOT nr.cold GROUP BY ALL),
i AS (SELECT *, (s_mention + s_report + s_confirmed) / 3 AS intensity FROM cent),
r AS (SELECT *, row_number() OVER (PARTITION BY macro_area ORDER BY intensity, regime) - 1 AS rk, count(*) OVER (PARTITION BY macro_area) AS k FROM i),
t AS (SELECT *, CASE WHEN rk / greatest(k - 1, 1) >= 0.67 THEN 2 WHEN rk / greatest(k - 1, 1) >= 0.33 THEN 1 ELSE 0 END AS tier FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY macro_area, tier ORDER BY rk) AS no FROM t)
SELECT macro_area, CAST(regime AS INTEGER) AS regime, CAST(tier AS INTEGER) AS tier, CAST(no AS INTEGER) AS nth,
  ({_TOP2})[1].t || ' ' || ({_TOP2})[2].t AS leading FROM n""")
def regime_labels(spark, sf):
    out = clusters.label_regimes(regime_centroids(spark, sf), keys=LONG)
    return out.select("macro_area", "regime", "tier", "nth", F.array_join("leading", " ").alias("leading"))


@query("J11", o.LONG_DAILY + _ASSIGN + f""", cent AS (SELECT macro_area, near AS regime, {', '.join(f'round(avg({s}), 9) AS {s}' for s in K.REGIME_SIGNALS)}
  FROM nr JOIN sc USING (macro_area, date) WHERE NOT nr.cold GROUP BY ALL)
SELECT a.macro_area, CAST(a.regime AS INTEGER) AS regime, CAST(arg_min(b.regime, (sqrt({' + '.join(f'pow(a.{s} - b.{s}, 2)' for s in K.REGIME_SIGNALS)}), b.regime)) AS INTEGER) AS fallback
FROM cent a JOIN cent b ON a.macro_area = b.macro_area AND a.regime <> b.regime GROUP BY ALL""")
def nearest_regime(spark, sf):
    """For each regime the closest other one of its series: who serves when its own model is missing."""
    c = regime_centroids(spark, sf).select("macro_area", "regime", F.array(*K.REGIME_SIGNALS).alias("v"))
    other = c.select("macro_area", F.col("regime").alias("other"), F.col("v").alias("_v"))
    pairs = c.join(other, "macro_area").filter(F.col("regime") != F.col("other"))
    return pairs.groupBy("macro_area", "regime").agg(
        F.min_by("other", F.struct(scoring.euclidean(F.col("v"), F.col("_v")), "other")).alias("fallback"))


# ── analogues ─────────────────────────────────────────────────────────────────

def _analog_sql() -> str:
    names = ft.feature_names()
    base = o.feature_query(o.LONG_DAILY.replace("full_daily AS (", "full_daily0 AS ("), "macro_area", 10)
    counters = [*K.INCIDENT_DAILY, *K.SIGNALS_EXT]
    grown = (", full_daily AS (SELECT macro_area, date, " + ", ".join(counters) + " FROM full_daily0 UNION ALL SELECT macro_area, max(date) + 1, "
             + ", ".join("0" for _ in counters) + " FROM full_daily0 GROUP BY 1),\nnumbered AS (")
    base = base.replace(",\nnumbered AS (", grown, 1)
    stats = ", ".join(f"avg({f}) FILTER (rn < n) OVER k AS m{i}, stddev_pop({f}) FILTER (rn < n) OVER k AS d{i}" for i, f in enumerate(names))
    scaled = ", ".join(f"({f} - m{i}) / CASE WHEN d{i} > 1e-9 THEN d{i} ELSE 1 END" for i, f in enumerate(names))
    return f"""{base},
st AS (SELECT *, {stats} FROM feats WINDOW k AS (PARTITION BY macro_area)),
vec AS (SELECT macro_area, date, rn, n, [{scaled}] AS v FROM st),
dist AS (SELECT a.macro_area, a.date, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist
  FROM vec a JOIN vec b ON a.macro_area = b.macro_area AND b.rn = b.n WHERE a.rn <= a.n - 1 - 14),
top AS (SELECT *, row_number() OVER (PARTITION BY macro_area ORDER BY dist, date) AS rank FROM dist QUALIFY rank <= 7)"""


_ANALOGS = _analog_sql()
_FOLLOW = _ANALOGS + """, fo AS (SELECT t.macro_area, t.date, min(CASE WHEN f.inc_count > 0 THEN datediff('day', t.date, f.date) END) AS days_to_next,
  coalesce(max(f.fire_count) > 0, false) AS fire, coalesce(max(f.hit_count) > 0, false) AS hit, coalesce(max(f.reach_score), 0) AS max_reach
  FROM top t LEFT JOIN full_daily f ON f.macro_area = t.macro_area AND f.date > t.date AND f.date <= t.date + 14 GROUP BY ALL)"""


@query("ML24 J8 D5", _ANALOGS + """ SELECT macro_area, date, rank, round(dist, 6) AS dist, round(1 - dist / (max(dist) OVER (PARTITION BY macro_area) + 1e-9), 6) AS similarity FROM top""")
def analog_windows(spark, sf):
    return rounded(analogs.find_analogs(long_daily(spark, sf), LONG, few_series=True), "dist", "similarity")


@query("ML24 J7 W17", _FOLLOW + " SELECT macro_area, date, days_to_next, fire, hit, max_reach FROM fo")
def analog_outcomes(spark, sf):
    d = long_daily(spark, sf)
    f = analogs.what_followed(analogs.find_analogs(d, LONG, few_series=True), d, LONG)
    return f.select("macro_area", "date", "days_to_next", "fire", "hit", "max_reach")


@query("ML24 A9", _FOLLOW + """ SELECT macro_area, round(median(days_to_next), 6) AS days_estimate,
  CASE WHEN count(days_to_next) >= 2 THEN round(quantile_cont(days_to_next, 0.25), 6) END AS days_p25,
  CASE WHEN count(days_to_next) >= 2 THEN round(quantile_cont(days_to_next, 0.75), 6) END AS days_p75,
  round(avg(fire::INTEGER), 6) AS fire_rate, round(avg(hit::INTEGER), 6) AS hit_rate, round(avg(CAST(max_reach >= 3 AS INTEGER)), 6) AS far_rate,
  count(days_to_next) AS n_with_incidents, count(*) AS k FROM fo GROUP BY 1""")
def analog_forecast(spark, sf):
    d = long_daily(spark, sf)
    f = analogs.what_followed(analogs.find_analogs(d, LONG, few_series=True), d, LONG)
    return rounded(analogs.analog_summary(f, LONG), "days_estimate", "days_p25", "days_p75", "fire_rate", "hit_rate", "far_rate")


@query("ML24 A10 J7", _ANALOGS + """, hits AS (SELECT t.macro_area, i.area, count(*) AS n FROM top t JOIN inc_long i ON i.macro_area = t.macro_area
  AND i.date > t.date AND i.date <= t.date + 14 AND i.status = 'active' GROUP BY ALL)
SELECT macro_area, area, n, round(n / sum(n) OVER (PARTITION BY macro_area), 6) AS share, row_number() OVER (PARTITION BY macro_area ORDER BY n DESC, area) AS rank
FROM hits QUALIFY rank <= 5""")
def analog_areas(spark, sf):
    from sigtide.operators import incidents as inc
    a = analogs.find_analogs(long_daily(spark, sf), LONG, few_series=True)
    occ = inc.active(td.incidents_long(spark, sf)).select("macro_area", "date", "area")
    return rounded(analogs.following_distribution(a, occ, LONG, "area"), "share")
