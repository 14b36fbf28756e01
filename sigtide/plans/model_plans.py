"""Model plans: grids, banks, forecasts, regimes. Their fits have no SQL form; deterministic parts do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.operators import boosting, clusters, correlate, evaluate, forecast, models, summary
from sigtide.operators import features as ft
from sigtide.plans import oracle as o
from sigtide.plans.common import LONG, long_daily, rounded
from sigtide.plans.daily_plans import TYPE_DAYS, type_outcomes
from sigtide.plans.registry import query
from sigtide.session import materialise, work_dir

#: Positives of a run of rows are differences of running totals; a fold counts where its training and its test rows hold both classes.
_GRID_COUNTS = o.LONG_DAILY + f""", {TYPE_DAYS.removeprefix(o.INC_LONG + ", ")},
num AS (SELECT *, row_number() OVER (PARTITION BY macro_area ORDER BY date) AS r, count(*) OVER (PARTITION BY macro_area) AS n_rows FROM full_daily),
long AS (UNPIVOT (SELECT macro_area, r, n_rows, {', '.join(f'{c}::BIGINT AS {c}' for c in sorted({s["col"] for s in K.OUTCOMES}))} FROM num)
  ON {', '.join(sorted({s["col"] for s in K.OUTCOMES}))} INTO NAME col VALUE v),
outs(outcome, col, op, bound) AS (VALUES {', '.join(f"('{s['name']}', '{s['col']}', '{s['op']}', {s['threshold']})" for s in K.OUTCOMES)}),
vals AS (SELECT macro_area, r, n_rows, outcome, op, bound, v, n_rows AS last_seen FROM long JOIN outs USING (col)
  UNION ALL SELECT n.macro_area, n.r, n.n_rows, s.outcome, 'sum_ge', 1, (t.date IS NOT NULL)::BIGINT,
    max(CASE WHEN t.date IS NOT NULL THEN n.r END) OVER (PARTITION BY n.macro_area, s.outcome)
  FROM num n JOIN (SELECT DISTINCT macro_area, outcome FROM tdays) s USING (macro_area)
  LEFT JOIN tdays t ON t.macro_area = n.macro_area AND t.date = n.date AND t.outcome = s.outcome),
lab AS ({' UNION ALL '.join(f"""SELECT macro_area, outcome, n_rows, last_seen, {h} AS horizon, r, (CASE op WHEN 'sum_ge' THEN sum(v) OVER w ELSE max(v) OVER w END >= bound)::INT AS y
  FROM vals WINDOW w AS (PARTITION BY macro_area, outcome ORDER BY r ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)""" for h in K.HORIZONS)}),
upto AS (SELECT macro_area, outcome, horizon, r, sum(y) OVER (PARTITION BY macro_area, outcome, horizon ORDER BY r) AS c FROM lab
  UNION ALL SELECT DISTINCT macro_area, outcome, horizon, 0, 0 FROM lab),
cfg AS (SELECT *, greatest(n_rows - horizon + 1 - lookback, 0) AS n, n // {K.CV_SPLITS + 1} AS size FROM (SELECT DISTINCT macro_area, outcome, horizon, n_rows, last_seen FROM lab),
  (SELECT unnest({K.LOOKBACKS}) AS lookback) WHERE n_rows > lookback AND last_seen > lookback),
whole AS (SELECT cfg.*, b.c - a.c AS pos FROM cfg JOIN upto a USING (macro_area, outcome, horizon) JOIN upto b USING (macro_area, outcome, horizon)
  WHERE a.r = lookback AND b.r = lookback + n),
fold AS (SELECT macro_area, outcome, horizon, lookback, count(*) AS ok FROM
  (SELECT *, n - size * ({K.CV_SPLITS} - k) AS s FROM cfg, (SELECT unnest(range({K.CV_SPLITS})) AS k) WHERE size > 0) f
  JOIN upto a USING (macro_area, outcome, horizon) JOIN upto b USING (macro_area, outcome, horizon) JOIN upto e USING (macro_area, outcome, horizon)
  WHERE a.r = lookback AND b.r = lookback + s AND e.r = lookback + s + size AND b.c - a.c > 0 AND b.c - a.c < s AND e.c - b.c > 0 AND e.c - b.c < size GROUP BY ALL)
SELECT macro_area, outcome, lookback::INTEGER AS lookback, horizon, n::BIGINT AS n, round(CASE WHEN n > 0 THEN pos / n END, 6) AS pos_rate,
  CASE WHEN pos IN (0, n) THEN 0 ELSE coalesce(ok, 0) END::INTEGER AS n_folds,
  CASE WHEN pos IN (0, n) THEN 'one_class' WHEN ok = {K.CV_SPLITS} THEN 'scored' ELSE 'folds_missing' END AS note
FROM whole LEFT JOIN fold USING (macro_area, outcome, horizon, lookback)"""


#: Folders that hold what several queries of a session share, by session and input.
_SHARED: dict[tuple[str, str, str], str] = {}


def shared(spark: SparkSession, sf: str, name: str, make) -> str:  # noqa: ANN001
    """The folder that ``make(folder)`` has filled for this session and input; filled once."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _SHARED:
        folder = work_dir(spark, name)
        make(folder)
        _SHARED[key] = folder
    return _SHARED[key]


def once(spark: SparkSession, sf: str, name: str, make) -> DataFrame:  # noqa: ANN001
    """The frame ``make(spark, sf)``, written once a session and input."""
    return spark.read.parquet(shared(spark, sf, name, lambda folder: make(spark, sf).write.parquet(folder)))


def days(spark: SparkSession, sf: str) -> DataFrame:
    """The session's daily frame: bounded by the calendar, while the incidents behind it are as large as the input, so they are read once for all passes."""
    return once(spark, sf, "days", long_daily)


def types(spark: SparkSession, sf: str) -> DataFrame:
    """The session's outcomes from types, at most one row per series, day and type; the links behind them are read once."""
    return once(spark, sf, "types", type_outcomes)


@query("ML3 ML6 J10 U2")
def grid_results(spark, sf):
    """Every lookback by every horizon for both targets of every series, with lift over the random baseline."""
    return models.grid_search(days(spark, sf), LONG)


@query("ML8 O3 R2")
def grid_selected(spark, sf):
    grid = models.grid_search(days(spark, sf), LONG)
    return evaluate.select_configs(grid, [*LONG, "outcome"])


@query("ML12 U1")
def stability(spark, sf):
    grid = models.stability_grid(days(spark, sf), LONG)
    return evaluate.stable_configs(grid, [*LONG, "outcome"])


def outcome_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The session's whole grid of this input: the outcomes of counters, and one per frequent site type."""
    def make(folder: str) -> None:
        models.grid_search(days(spark, sf), LONG, specs=K.OUTCOMES, with_baseline=False, types=types(spark, sf)).write.parquet(f"{folder}/grid")

    return spark.read.parquet(f"{shared(spark, sf, 'outcome_grid', make)}/grid")


@query("ML7 A13")
def outcome_grid_best(spark, sf):
    """All outcomes over the whole grid, best configuration per outcome under the positive-rate gate."""
    return evaluate.best_under_gate(outcome_grid(spark, sf), [*LONG, "outcome"])


@query("ML2 ML7 W15 A17", _GRID_COUNTS)
def outcome_grid_counts(spark, sf):
    """What the grid worked on: rows, positive rate, folds with both classes and outcome of the fit, per configuration."""
    return rounded(outcome_grid(spark, sf).select(*LONG, "outcome", "lookback", "horizon", "n", "pos_rate", "n_folds", "note"), "pos_rate")


def bank(spark: SparkSession, sf: str) -> DataFrame:
    """The session's bank of this input, trained once."""
    return once(spark, sf, "bank", trained_bank)


def trained_bank(spark: SparkSession, sf: str) -> DataFrame:
    """Every outcome at every forecast horizon with the lookback that the grid finds, at its best parameters, and the predictor configurations."""
    chosen = materialise(evaluate.bank_configs(outcome_grid(spark, sf), LONG), "bank_configs")
    return models.train_chosen(days(spark, sf), LONG, chosen, K.OUTCOMES, types=types(spark, sf))


@query("ML20 ML22 ML25")
def model_bank(spark, sf):
    return bank(spark, sf).select(*LONG, "outcome", "lookback", "horizon", "status", "n", "pos_rate", "cv_auc", "cv_std", "n_folds", "intercept")


@query("ML19")
def recent_window_bank(spark, sf):
    """Every predictor configuration with the training window chosen for it."""
    feats = clusters.model_columns(ft.feature_names())
    b = models.train_bank(days(spark, sf), LONG, K.PREDICTOR_CONFIGS, K.GRID_TARGETS, feats, K.RECENT_WINDOWS)
    return models.choose_window(b, LONG).select(*LONG, "outcome", "lookback", "horizon", "status", "n", "cv_auc", "cv_std", "recent_rows")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Latest window of each series scored by every model of its bank."""
    return models.score(ft.latest_window(days(spark, sf), LONG, K.LOOKBACKS), bank(spark, sf), LONG)


def forecast_folder(spark: SparkSession, sf: str) -> str:
    """The logs of one forecast run of the session's bank. The run is repeated, as after a failure, which adds nothing."""
    def make(folder: str) -> None:
        scored, dims = scores(spark, sf), summary.dimension_table(spark)
        for _ in range(2):
            forecast.run_forecast(scored, bank(spark, sf), dims, folder, RUN_ID, LONG)

    return shared(spark, sf, "forecast", make)


RUN_ID = "fixture"


@query("ML26 ML27 S11 P8 P9 P10 U4")
def bank_prediction_log(spark, sf):
    """The bank's own scores as logged signals."""
    log = forecast.read_log(spark, forecast_folder(spark, sf), "predictions", RUN_ID)
    return log.select(*LONG, "band", "dimension", "outcome", "label", "lookback", "horizon", "prob", "cv_auc", "cv_std", "tier")


@query("ML25 ML26 S12")
def bank_auc_log(spark, sf):
    return forecast.read_log(spark, forecast_folder(spark, sf), "models", RUN_ID).drop("run_id")


@query("ML27 A20 O6 D6")
def bank_documents(spark, sf):
    """Each series' forecast document with its warning level."""
    return forecast.read_log(spark, forecast_folder(spark, sf), "documents", RUN_ID).drop("run_id")


@query("R3 S13 ML25")
def bank_age(spark, sf):
    """Freshness of the logged bank: each series' latest day of data against the run that holds its models."""
    seen = days(spark, sf).select(*LONG, F.col("date").cast("timestamp").alias("at"))
    return forecast.bank_age(spark, forecast_folder(spark, sf), seen, LONG).select(*LONG, F.to_date("analysed_at").alias("analysed_on"), "state")


@query("ML20 ML23 ML26 S6 O4 O5 P13")
def forecast_scores(spark, sf):
    """Latest window of each series scored by every model of its bank."""
    scored = scores(spark, sf)
    top = F.array_join(F.transform("top_features", lambda t: t["feature"]), ", ")
    return scored.select(*LONG, "outcome", "lookback", "horizon", "status", "prob", "predicted", "cv_auc", "data_through",
                         top.alias("top_features")).orderBy(*LONG, F.desc("prob"))


def each_predictor(spark: SparkSession, sf: str, run) -> DataFrame:  # noqa: ANN001
    """One trained bank of the predictor configurations, and what ``run`` makes of each, in one frame."""
    d = days(spark, sf)
    trained = materialise(models.train_bank(d, LONG, K.PREDICTOR_CONFIGS, K.GRID_TARGETS), "predictors")
    spec = {s["name"]: s for s in K.GRID_TARGETS}
    parts = [run(d, LONG, trained, spec[c["outcome"]], c["lookback"], c["horizon"], cfg=c) for c in K.PREDICTOR_CONFIGS]
    return reduce(DataFrame.unionByName, parts)


@query("ML21 A17")
def backtest(spark, sf):
    """Every predictor configuration over the latest labelled days."""
    return each_predictor(spark, sf, lambda *a, cfg: models.backtest(*a).withColumns({k: F.lit(v) for k, v in cfg.items()}))


@query("ML11")
def permutation_importance(spark, sf):
    """Every predictor configuration, every feature."""
    return each_predictor(spark, sf, lambda *a, cfg: models.permutation_importance(*a))


@query("ML5")
def ridge_totals(spark, sf):
    return models.ridge_scores(days(spark, sf), LONG, {"name": "total", "col": "inc_count", "op": "sum"}, 10, 3)


@query("ML4")
def boosted_scores(spark, sf):
    """Boosted trees on the pooled panel, all rounds, scored on it."""
    spec = [s for s in K.OUTCOMES if s["name"] == K.SIGNIFICANT]
    data = ft.build_dataset(days(spark, sf), LONG, [10], [1], spec)
    data = materialise(data, "boosted")
    model = models.boosted_model(data, K.SIGNIFICANT)
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(data).select(*LONG, "date", K.SIGNIFICANT, vector_to_array("probability")[1].alias("prob"))
    return evaluate.roc_auc(scored, "prob", K.SIGNIFICANT, LONG)


#: Lookback and horizons at which every outcome is boosted, whatever the grid finds.
BOOSTED_LOOKBACK, BOOSTED_HORIZONS = 10, [1, 7]


def boosted_fits(spark: SparkSession, sf: str) -> DataFrame:
    """The session's time-fold fits of boosted trees, one per series, outcome (of counters and of frequent types) and horizon."""
    def make(folder: str) -> None:
        daily, found = days(spark, sf), types(spark, sf)
        counters = daily.select(*LONG).distinct().withColumn("outcome", F.explode(F.array(*[F.lit(s["name"]) for s in K.OUTCOMES])))
        every = counters.union(found.select(*LONG, "outcome").distinct())
        chosen = every.withColumn("lookback", F.lit(BOOSTED_LOOKBACK)).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in BOOSTED_HORIZONS])))
        fits = boosting.train_boosted(daily, LONG, chosen, K.OUTCOMES, [BOOSTED_LOOKBACK], BOOSTED_HORIZONS, found, with_model=False)
        fits.drop("splits", "values", "leaves", "importance").write.parquet(folder)

    return spark.read.parquet(shared(spark, sf, "boosted_fits", make))


@query("ML2 ML4 ML7 W15", f"SELECT * FROM ({_GRID_COUNTS}) WHERE lookback = {BOOSTED_LOOKBACK} AND horizon IN ({', '.join(map(str, BOOSTED_HORIZONS))})")
def boosted_counts(spark, sf):
    """What the boosted fits worked on: rows, positive rate, folds with both classes and outcome of the fit."""
    note = F.when(F.col("status") == "one_class", "one_class").when(F.col("n_folds") == K.CV_SPLITS, "scored").otherwise("folds_missing")
    return rounded(boosted_fits(spark, sf).select(*LONG, "outcome", "lookback", "horizon", "n", "pos_rate", "n_folds", note.alias("note")), "pos_rate")


@query("ML4 ML7")
def boosted_folds(spark, sf):
    """AUC of boosted trees over the expanding time folds, every outcome of every series."""
    return boosted_fits(spark, sf)


def boosted_models(spark: SparkSession, sf: str) -> DataFrame:
    """The session's boosted bank: per series and outcome the trees at the best parameters that the grid finds."""
    def make(folder: str) -> None:
        chosen = materialise(evaluate.best_params(outcome_grid(spark, sf), [*LONG, "outcome"]), "boosted_configs")
        boosting.train_boosted(days(spark, sf), LONG, chosen, K.OUTCOMES, types=types(spark, sf)).write.parquet(folder)

    return spark.read.parquet(shared(spark, sf, "boosted_bank", make))


def boosted_latest(spark: SparkSession, sf: str) -> DataFrame:
    return boosting.score_boosted(ft.latest_window(days(spark, sf), LONG, K.LOOKBACKS), boosted_models(spark, sf), LONG)


@query("ML4 ML9 ML25 ML26")
def boosted_bank(spark, sf):
    """Boosted trees at each outcome's best parameters, with the probability of the latest window."""
    return boosted_latest(spark, sf).select(*LONG, "outcome", "lookback", "horizon", "status", "n", "pos_rate", "cv_auc", "cv_std", "n_folds", "prob", "predicted")


@query("ML4 ML27 A19 J12")
def boosted_influence(spark, sf):
    """Features by gain importance over the passing signals of the boosted bank."""
    found = summary.forecast_signals(boosted_latest(spark, sf), summary.dimension_table(spark), "low")
    data = ft.build_dataset(days(spark, sf), LONG, [10], [3], K.OUTCOMES)
    corr = correlate.feature_outcome_corr(data, LONG, ft.feature_names(), [s["name"] for s in K.OUTCOMES])
    return summary.feature_influence(found, boosting.gain_importance(boosted_models(spark, sf), LONG), corr, LONG)


@query("ML13 A18")
def signal_profiles(spark, sf):
    data = materialise(ft.build_dataset(days(spark, sf), LONG, [10], [3], K.OUTCOMES), "profiles")
    p = clusters.find_profiles(data, ft.feature_names(), [s["name"] for s in K.OUTCOMES])
    return p.withColumn("dominant", F.array_join("dominant", ", ")).withColumn("suppressed", F.array_join("suppressed", ", "))


def detected(spark: SparkSession, sf: str) -> tuple[DataFrame, list[list[float]]]:
    """Every day with its regime, and the centroids that K-means found, k by silhouette; found once a session and input."""
    def make(folder: str) -> None:
        rolled = clusters.rolling_signals(days(spark, sf), LONG)
        clusters.standardise(rolled, LONG, K.REGIME_SIGNALS).write.parquet(f"{folder}/days")
        scaled = spark.read.parquet(f"{folder}/days")
        k = clusters.choose_k(scaled, K.REGIME_SIGNALS, scaled.count())
        centroids = clusters.fit_kmeans(scaled, K.REGIME_SIGNALS, k, seed=0)
        found = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]  # nine at most
        spark.createDataFrame(found, "regime int, centre array<double>").coalesce(1).write.parquet(f"{folder}/centroids")

    folder = shared(spark, sf, "regimes", make)
    centroids = [r.centre for r in spark.read.parquet(f"{folder}/centroids").orderBy("regime").collect()]
    return clusters.assign_regimes(spark.read.parquet(f"{folder}/days"), LONG, K.REGIME_SIGNALS, centroids), centroids


@query("ML14 ML15")
def detected_regimes(spark, sf):
    """Regimes found by K-means, k by silhouette, then assigned to every day."""
    return detected(spark, sf)[0].select(*LONG, "date", "regime", "dist", "ood")


@query("ML17 R4")
def regime_bank(spark, sf):
    regimes, _ = detected(spark, sf)
    return clusters.regime_summary(clusters.train_regime_bank(days(spark, sf), LONG, regimes), regimes, LONG)


@query("ML18 J11")
def regime_predictions(spark, sf):
    d, (regimes, centroids) = days(spark, sf), detected(spark, sf)
    trained = clusters.train_regime_bank(d, LONG, regimes)
    current = regimes.groupBy(*LONG).agg(F.max_by(F.struct("regime", "ood"), "date").alias("c")).select(*LONG, "c.*")
    serving = clusters.serve_regime(trained, current, centroids, LONG)
    scored = models.score(ft.latest_window(d, LONG, [2, 10]), serving, LONG)
    return scored.select(*LONG, "outcome", "lookback", "horizon", "regime", "ood", "status", "prob", "predicted", "cv_auc", "n")
