"""Forecast summary, logs, insights and freshness over prediction tables derived from customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions import scoring
from sigtide.operators import summary
from sigtide.plans import oracle as o
from sigtide.plans.common import rounded
from sigtide.plans.registry import query
from sigtide.sources import testdata as td

TARGETS = [t for _, t in K.DIMENSIONS]
_N = len(TARGETS)
_DIM = "CASE " + " ".join(f"WHEN outcome = {o.q(t)} THEN {o.q(d)}" for d, t in K.DIMENSIONS) + " END"
_LABEL = "array_to_string(list_transform(string_split(replace(regexp_replace(outcome, '^type_', ''), '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"

#: Signals of a table ``preds`` of scores.
SIGNALS_SQL = f"""sig AS (SELECT *, {_DIM} AS dimension, {_LABEL} AS label,
  CASE WHEN prob >= 0.65 AND cv_auc >= 0.70 THEN 'high' WHEN prob >= 0.55 AND cv_auc >= 0.62 THEN 'medium' WHEN prob >= 0.42 AND cv_auc >= 0.55 THEN 'low' END AS tier,
  prob >= 0.55 AND cv_auc >= 0.62 AS passes, CASE WHEN horizon <= 3 THEN 'near_term' WHEN horizon <= 10 THEN 'weekly' ELSE 'extended' END AS band FROM preds)"""
_PREDS = f"""preds AS (SELECT c_nationkey AS series, [{', '.join(o.q(t) for t in TARGETS)}][CAST(c_custkey % {_N} AS INTEGER) + 1] AS outcome,
  round(avg((c_custkey * 37 % 101) / 101.0 * 0.6 + 0.38), 6) AS prob, round(avg((c_custkey * 17 % 89) / 89.0 * 0.35 + 0.5), 6) AS cv_auc,
  round(avg((c_custkey % 13) / 130.0), 6) AS cv_std, CAST(min(c_custkey % 14) + 1 AS INTEGER) AS horizon, CAST(min(c_custkey % 10) + 1 AS INTEGER) AS lookback
  FROM customer GROUP BY ALL),
{SIGNALS_SQL}"""
SERIES = ["series"]


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    outcome = F.get(F.array(*[F.lit(t) for t in TARGETS]), (k % _N).cast("int"))
    c = td.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("series"), outcome.alias("outcome"), ((k * 37 % 101) / 101.0 * 0.6 + 0.38).alias("prob"),
        ((k * 17 % 89) / 89.0 * 0.35 + 0.5).alias("cv_auc"), ((k % 13) / 130.0).alias("cv_std"), (k % 14).alias("h"), (k % 10).alias("l"))
    mean = [F.round(F.avg(x), 6).alias(x) for x in ("prob", "cv_auc", "cv_std")]
    return c.groupBy("series", "outcome").agg(
        *mean, (F.min("h") + 1).cast("int").alias("horizon"), (F.min("l") + 1).cast("int").alias("lookback"))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return summary.forecast_signals(predictions(spark, sf), summary.dimension_table(spark))


@query("P8 P9 P10 ML27", f"WITH {_PREDS} SELECT series, outcome, dimension, label, prob, tier, passes, band FROM sig")
def forecast_signals(spark, sf):
    return signals(spark, sf).select("series", "outcome", "dimension", "label", "prob", "tier", "passes", "band")


@query("A20 ML27", f"""WITH {_PREDS}, c AS (SELECT series, count(*) FILTER (passes AND band = 'near_term') AS n_passing,
  count(*) FILTER (passes AND band = 'near_term' AND tier = 'high') AS n_high, count(*) FILTER (passes AND band = 'near_term' AND tier = 'medium') AS n_medium FROM sig GROUP BY 1)
SELECT *, CASE WHEN n_passing = 0 THEN 'NONE' WHEN n_high >= 2 THEN 'CRITICAL' WHEN n_high >= 1 THEN 'HIGH' WHEN n_medium >= 1 THEN 'ELEVATED' ELSE 'LOW' END AS warning FROM c""")
def warning_levels(spark, sf):
    return summary.warning(signals(spark, sf), SERIES)


@query("ML27", f"WITH {_PREDS} SELECT series, band, count(*) FILTER (passes) AS total_passing, count(*) AS n_signals FROM sig GROUP BY ALL")
def band_totals(spark, sf):
    return summary.band_totals(signals(spark, sf), SERIES)


@query("O6 ML27 U4", f"""WITH {_PREDS} SELECT series, band, dimension, string_agg(outcome, ', ' ORDER BY prob DESC, outcome) AS outcomes, count(*) AS n
FROM sig WHERE passes GROUP BY ALL""")
def band_signals(spark, sf):
    b = summary.band_lists(signals(spark, sf), SERIES)
    return b.select("series", "band", "dimension", F.array_join(F.transform("signals", lambda s: s["outcome"]), ", ").alias("outcomes"),
                    F.size("signals").alias("n"))


@query("S11 U4 D6", f"""WITH {_PREDS} SELECT series, band, dimension, outcome, label, round(prob, 4) AS prob, round(cv_auc, 4) AS cv_auc, round(cv_std, 4) AS cv_std,
  horizon, lookback, coalesce(tier, '') AS tier FROM sig WHERE passes""")
def prediction_log(spark, sf):
    return summary.prediction_log(summary.forecast_document(signals(spark, sf), SERIES), SERIES)


@query("P12 ML27", f"""WITH {_PREDS}, q AS (SELECT series, count(*) AS n_models, avg(cv_auc) AS a FROM preds WHERE lookback > 1 GROUP BY 1)
SELECT series, n_models, round(a, 6) AS avg_auc, CASE WHEN a >= 0.75 THEN 'Strong' WHEN a >= 0.65 THEN 'Good' WHEN a >= 0.55 THEN 'Moderate' ELSE 'Limited' END AS reliability FROM q""")
def model_quality(spark, sf):
    bank = predictions(spark, sf).withColumn("status", F.when(F.col("lookback") > 1, "trained").otherwise("skipped"))
    return rounded(summary.model_quality(bank, SERIES), "avg_auc")


@query("S12", f"""WITH {_PREDS} SELECT series, outcome, lookback, horizon, round(cv_auc, 4) AS cv_auc, round(cv_std, 4) AS cv_std, round(prob, 4) AS pos_rate, 100 AS n
FROM preds WHERE lookback > 1""")
def auc_log(spark, sf):
    bank = predictions(spark, sf).withColumns({
        "status": F.when(F.col("lookback") > 1, F.lit("trained")).otherwise("skipped"), "pos_rate": F.col("prob"), "n": F.lit(100)})
    return summary.auc_log(bank, SERIES)


@query("R3", """WITH a AS (SELECT o_custkey % 40 AS series, max(o_orderdate) AS analysed_at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
t AS (SELECT o_custkey % 40 AS series, max(o_orderdate) AS trained_at FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 40 <> 7 GROUP BY 1)
SELECT series, CAST(analysed_at AS DATE) AS analysed_on, CASE WHEN trained_at IS NULL THEN 'not trained' WHEN trained_at < analysed_at THEN 'outdated' ELSE 'current' END AS state
FROM a LEFT JOIN t USING (series)""")
def bank_freshness(spark, sf):
    runs = td.table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("series"), F.col("o_orderdate").alias("at"), "o_orderstatus")
    done = runs.filter((F.col("o_orderstatus") == "O") & (F.col("series") != 7))
    f = summary.freshness(runs.filter("o_orderstatus = 'F'"), done, SERIES)
    return f.select("series", F.to_date("analysed_at").alias("analysed_on"), "state")


# ── insights: importance and correlation tables derived from parts ────────────

_FEATS = ["s_mention_x_s_report", "s_mention_lag3", "s_site_lag7", "is_heating_season", "s_defence_sum", "s_broad_ewm", "s_report_slope"]
_INFO = f"""{_PREDS}, info AS (SELECT [{', '.join(o.q(t) for t in TARGETS)}][CAST(p_partkey % {_N} AS INTEGER) + 1] AS outcome,
  [{', '.join(o.q(f) for f in _FEATS)}][CAST(p_partkey // {_N} % {len(_FEATS)} AS INTEGER) + 1] AS feature,
  round(avg((p_partkey * 29 % 83) / 83.0), 6) AS importance, round(avg((p_partkey * 31 % 103) / 103.0 - 0.5) * 2, 6) AS r FROM part GROUP BY ALL)"""


def insight_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(series, outcome, feature, importance) and (series, feature, outcome, r) for every series."""
    k = F.col("p_partkey")
    p = td.table(spark, sf, "part").select(
        F.get(F.array(*[F.lit(t) for t in TARGETS]), (k % _N).cast("int")).alias("outcome"),
        F.get(F.array(*[F.lit(f) for f in _FEATS]), (F.floor(k / _N) % len(_FEATS)).cast("int")).alias("feature"),
        ((k * 29 % 83) / 83.0).alias("importance"), ((k * 31 % 103) / 103.0 - 0.5).alias("r"))
    info = p.groupBy("outcome", "feature").agg(
        F.round(F.avg("importance"), 6).alias("importance"), F.round(F.avg("r") * 2, 6).alias("r"))
    both = predictions(spark, sf).select("series", "outcome").join(info, "outcome")
    return both.select("series", "outcome", "feature", "importance"), both.select("series", "feature", "outcome", "r")


@query("ML28 J12 T14", f"""WITH {_INFO}, s AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY prob DESC, outcome) AS signal_rank FROM sig WHERE passes QUALIFY signal_rank <= 5),
f AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY importance DESC, feature) AS feature_rank FROM info QUALIFY feature_rank <= 4)
SELECT series, outcome, signal_rank, feature, feature_rank, importance, r, CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM s JOIN f USING (outcome)""")
def signal_features(spark, sf):
    imp, corr = insight_inputs(spark, sf)
    out = summary.signal_features(signals(spark, sf), imp, corr, SERIES)
    return out.select("series", "outcome", "signal_rank", "feature", "feature_rank", "importance", "r", "direction")


@query("A19 ML28 J12", f"""WITH {_INFO}, m AS (SELECT series, feature, avg(importance * prob) AS importance, avg(r) AS r FROM sig JOIN info USING (outcome) WHERE passes GROUP BY ALL)
SELECT series, feature, round(importance, 5) AS importance, round(r, 5) AS r, row_number() OVER (PARTITION BY series ORDER BY importance DESC, feature) AS rank,
  CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM m QUALIFY rank <= 8""")
def feature_influence(spark, sf):
    imp, corr = insight_inputs(spark, sf)
    return rounded(summary.feature_influence(signals(spark, sf), imp, corr, SERIES), "importance", "r", digits=5).drop("readable")


_PATTERNS = [
    ("combination", "feature = 's_mention_x_s_report' AND abs(r) > 0.07"), ("lead_3d", "feature LIKE '%\\_lag3' ESCAPE '\\' AND abs(r) > 0.06"),
    ("lead_7d", "feature LIKE '%\\_lag7' ESCAPE '\\' AND abs(r) > 0.06"), ("season", f"feature = 'is_heating_season' AND dimension = {o.q(K.TYPE_DIMENSION)}"),
    ("defence", f"contains(feature, 'defence') AND dimension = {o.q(K.TYPE_DIMENSION)} AND abs(r) > 0.05")]


@query("ML28", f"""WITH {_INFO}, c AS (SELECT series, outcome, dimension, feature, r FROM sig JOIN info USING (outcome) WHERE passes),
u AS ({' UNION ALL '.join(f"SELECT *, '{n}' AS pattern FROM c WHERE {w}" for n, w in _PATTERNS)}),
b AS (SELECT *, row_number() OVER (PARTITION BY series, pattern ORDER BY abs(r) DESC, feature DESC, outcome DESC) AS rn,
  avg(r) OVER (PARTITION BY series, pattern) AS mean_r, max(abs(r)) OVER (PARTITION BY series, pattern) AS top FROM u),
d AS (SELECT series, pattern, feature, outcome, CASE WHEN pattern = 'season' THEN mean_r ELSE r END AS r FROM b WHERE rn = 1 AND (pattern <> 'season' OR top > 0.05))
SELECT series, pattern, feature, outcome, round(r, 6) AS r, CASE WHEN pattern = 'combination' THEN 'notable' WHEN pattern = 'season' THEN 'seasonal'
  WHEN abs(r) >= CASE WHEN pattern = 'defence' THEN 0.08 ELSE 0.10 END THEN 'notable' ELSE 'moderate' END AS strength FROM d""")
def notable_combinations(spark, sf):
    _, corr = insight_inputs(spark, sf)
    return rounded(summary.notable_combinations(signals(spark, sf), corr, SERIES), "r")
