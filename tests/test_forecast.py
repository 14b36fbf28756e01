"""A forecast run from scores to logs, against SQL over the stored scores."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.operators import forecast, summary
from sigtide.plans import oracle as o
from sigtide.plans.summary_plans import SERIES, SIGNALS_SQL

RUN = "2024-03-01"


@pytest.fixture(scope="module")
def scores(spark, tmp_path_factory):
    """Scores of every outcome of 40 series at seven horizons, some of them missing."""
    path = str(tmp_path_factory.mktemp("scores") / "scores")
    outcomes = F.get(F.array(*[F.lit(t) for _, t in K.DIMENSIONS]), (F.col("id") % len(K.DIMENSIONS)).cast("int"))
    rows = spark.range(40 * len(K.DIMENSIONS) * 7).select(
        (F.floor(F.col("id") / (len(K.DIMENSIONS) * 7))).alias("series"), outcomes.alias("outcome"),
        (F.floor(F.col("id") / len(K.DIMENSIONS)) % 7 * 2 + 1).cast("int").alias("horizon"), F.lit(10).alias("lookback"),
        F.when(F.col("id") % 11 > 0, F.round(F.col("id") * 37 % 101 / 101 * 0.6 + 0.38, 6)).alias("prob"),
        F.round(F.col("id") * 17 % 89 / 89 * 0.35 + 0.5, 6).alias("cv_auc"), F.round(F.col("id") % 13 / 130, 6).alias("cv_std"),
        F.lit(100).alias("n"), F.lit(0.25).alias("pos_rate"), F.when(F.col("id") % 11 > 0, "trained").otherwise("one_class").alias("status"))
    rows.write.parquet(path)
    return path


def sql(path, query):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW scores AS SELECT * FROM '{path}/*.parquet'")
    return con.execute(f"WITH preds AS (SELECT * FROM scores WHERE prob IS NOT NULL), {SIGNALS_SQL} {query}").fetchall()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def check(spark, path, folder):
    log = forecast.read_log(spark, folder, "predictions", RUN)
    assert rows(log, "series", "band", "dimension", "outcome", "horizon", "prob", "tier") == sorted(sql(
        path, "SELECT series, band, dimension, outcome, horizon, round(prob, 4), coalesce(tier, '') FROM sig WHERE passes"))
    assert rows(forecast.read_log(spark, folder, "models", RUN), "series", "outcome", "horizon", "cv_auc") == sorted(sql(
        path, "SELECT series, outcome, horizon, round(cv_auc, 4) FROM scores WHERE status = 'trained'"))
    assert rows(forecast.read_log(spark, folder, "documents", RUN), "series", "warning") == sorted(sql(path, """,
c AS (SELECT series, count(*) FILTER (passes AND band = 'near_term') AS p, count(*) FILTER (passes AND band = 'near_term' AND tier = 'high') AS h,
  count(*) FILTER (passes AND band = 'near_term' AND tier = 'medium') AS m FROM sig GROUP BY 1)
SELECT series, CASE WHEN p = 0 THEN 'NONE' WHEN h >= 2 THEN 'CRITICAL' WHEN h >= 1 THEN 'HIGH' WHEN m >= 1 THEN 'ELEVATED' ELSE 'LOW' END FROM c"""))


def test_run_equals_sql_and_repeats_add_nothing(spark, scores, tmp_path):
    s, folder = spark.read.parquet(scores), str(tmp_path / "run")
    for _ in range(2):
        forecast.run_forecast(s, s, summary.dimension_table(spark), folder, RUN, SERIES)
        check(spark, scores, folder)
    forecast.run_forecast(s.where("series < 3"), s.where("series < 3"), summary.dimension_table(spark), folder, "later", SERIES)
    check(spark, scores, folder)
    assert forecast.read_log(spark, folder, "documents").where("run_id = 'later'").count() == 3


def test_broken_run_is_not_read_and_is_completed(spark, scores, tmp_path):
    s, folder = spark.read.parquet(scores), str(tmp_path / "run")
    document = summary.forecast_document(summary.forecast_signals(s, summary.dimension_table(spark)), SERIES)
    half = summary.prediction_log(document, SERIES).where("series % 2 = 0")
    forecast.append_run(half, f"{folder}/predictions", RUN, [*SERIES, *forecast.LOGS["predictions"]])
    forecast.run_forecast(s.limit(0), s.limit(0), summary.dimension_table(spark), folder, "other", SERIES)
    assert forecast.read_log(spark, folder, "predictions", RUN).count() == 0
    forecast.run_forecast(s, s, summary.dimension_table(spark), folder, RUN, SERIES)
    check(spark, scores, folder)


def test_run_without_rows_has_empty_logs(spark, scores, tmp_path):
    """A bank without a trained model, and one without a passing signal, leave logs that can be read, and a later run adds its rows."""
    s, dims, folder = spark.read.parquet(scores), summary.dimension_table(spark), str(tmp_path / "run")
    none = s.where("prob IS NULL")
    for _ in range(2):
        forecast.run_forecast(none, none, dims, folder, "none", SERIES)
    for name in forecast.LOGS:
        assert forecast.read_log(spark, folder, name, "none").count() == 0
    at = spark.createDataFrame([(0, dt.datetime(2000, 1, 1))], "series long, at timestamp")
    assert rows(forecast.bank_age(spark, folder, at, SERIES), "series", "state") == [(0, "not trained")]
    empty = {name: set(forecast.read_log(spark, folder, name).columns) for name in forecast.LOGS}
    forecast.run_forecast(s, s, dims, folder, RUN, SERIES)
    assert {name: set(forecast.read_log(spark, folder, name).columns) for name in forecast.LOGS} == empty
    check(spark, scores, folder)


def test_freshness_from_the_runs(spark, scores, tmp_path):
    s, folder = spark.read.parquet(scores).where("series < 5"), str(tmp_path / "run")
    forecast.run_forecast(s, s, summary.dimension_table(spark), folder, RUN, SERIES)
    at = [(0, dt.datetime(2000, 1, 1)), (1, dt.datetime(2999, 1, 1)), (7, dt.datetime(2000, 1, 1))]
    got = forecast.bank_age(spark, folder, spark.createDataFrame(at, "series long, at timestamp"), SERIES)
    assert rows(got, "series", "state") == [(0, "current"), (1, "outdated"), (7, "not trained")]


def test_every_pattern_fires(spark):
    """Combination and leads for any outcome, season and defence for site types."""
    signals = spark.createDataFrame([(1, "type_small", K.TYPE_DIMENSION, True), (1, K.ANY, "volume", True)], "series long, outcome string, dimension string, passes boolean")
    feats = ["s_mention_x_s_report", "s_mention_lag3", "s_site_lag7", "is_heating_season", "s_defence_sum"]
    corr = spark.createDataFrame([(1, f, t, 0.2) for f in feats for t in ("type_small", K.ANY)], "series long, feature string, outcome string, r double")
    got = summary.notable_combinations(signals, corr, SERIES).collect()
    assert {r.pattern for r in got} == {"combination", "lead_3d", "lead_7d", "season", "defence"}
    assert {r.outcome for r in got if r.pattern in ("season", "defence")} == {"type_small"}


def test_patterns_fire_on_the_fixture(spark):
    from sigtide.plans import summary_plans

    got = summary_plans.notable_combinations(spark, "/root/testdata/sf0.01").select("pattern").distinct().collect()
    assert {r.pattern for r in got} == {"combination", "lead_3d", "lead_7d", "season", "defence"}


def test_dimension_names_are_quoted():
    assert o.q(K.TYPE_DIMENSION) in SIGNALS_SQL
