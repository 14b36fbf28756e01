"""Tiered forecast summary, logs and model insights over scored predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions import scoring
from sigtide.functions import text as tx


def dimension_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.DIMENSIONS, "dimension string, outcome string")


def outcome_label(c: Column) -> Column:
    return F.initcap(F.replace(F.regexp_replace(c, "^type_", ""), F.lit("_"), F.lit(" ")))


def forecast_signals(predictions: DataFrame, dimensions: DataFrame, mode: str = "medium") -> DataFrame:
    """Predictions (outcome, prob, cv_auc, cv_std, horizon, lookback) with dimension, tier, band and pass mark."""
    ok = predictions.filter(F.col("prob").isNotNull())
    return (
        ok.join(dimensions, "outcome")
        .withColumn("label", outcome_label(F.col("outcome")))
        .withColumn("tier", scoring.tier(F.col("prob"), F.col("cv_auc")))
        .withColumn("passes", scoring.passes(F.col("prob"), F.col("cv_auc"), mode))
        .withColumn("band", scoring.band(F.col("horizon")))
    )


def band_lists(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Passing signals per band and dimension, sorted by probability, as one array each."""
    entry = F.struct((-F.col("prob")).alias("_neg"), "outcome", "label", "prob", "cv_auc", "cv_std", "horizon", "lookback", "tier")
    lists = signals.filter("passes").groupBy(*keys, "band", "dimension").agg(F.array_sort(F.collect_list(entry)).alias("signals"))
    return lists.withColumn("signals", F.transform("signals", lambda s: s.dropFields("_neg")))


def warning(signals: DataFrame, keys: list[str], band: str = "near_term") -> DataFrame:
    """Warning level from the passing signals of one band; NONE without any."""
    here = F.col("passes") & (F.col("band") == band)
    counts = signals.groupBy(*keys).agg(
        F.count_if(here).alias("n_passing"), F.count_if(here & (F.col("tier") == "high")).alias("n_high"),
        F.count_if(here & (F.col("tier") == "medium")).alias("n_medium"))
    return counts.withColumn("warning", scoring.warning_level(F.col("n_passing"), F.col("n_high"), F.col("n_medium")))


def band_totals(signals: DataFrame, keys: list[str]) -> DataFrame:
    return signals.groupBy(*keys, "band").agg(F.count_if("passes").alias("total_passing"), F.count("*").alias("n_signals"))


def model_quality(bank: DataFrame, keys: list[str]) -> DataFrame:
    trained = bank.filter(F.col("status") == "trained")
    auc = F.avg(F.when(~F.isnan("cv_auc"), F.col("cv_auc")))
    return trained.groupBy(*keys).agg(F.count("*").alias("n_models"), auc.alias("avg_auc")).withColumn(
        "reliability", scoring.reliability_level(F.col("avg_auc")))


def forecast_document(signals: DataFrame, keys: list[str]) -> DataFrame:
    """The nested forecast of each series: band -> dimension -> signals, with its warning level, and as JSON."""
    per_band = band_lists(signals, keys).groupBy(*keys, "band").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "signals")))).alias("dims"))
    by_name = lambda a, b: F.when(a["band"] < b["band"], -1).when(a["band"] > b["band"], 1).otherwise(0)
    doc = per_band.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("band", "dims")), by_name)).alias("bands"))
    empty = F.create_map().cast(dict(doc.dtypes)["bands"])
    return (warning(signals, keys).join(doc, keys, "left").withColumn("bands", F.coalesce("bands", empty))
            .withColumn("json", F.to_json(F.struct("warning", "bands"))))


def flatten_bands(document: DataFrame, keys: list[str]) -> DataFrame:
    """Nested forecast back to rows: one per signal."""
    band = document.select(*keys, F.explode("bands").alias("band", "dims"))
    dim = band.select(*keys, "band", F.explode("dims").alias("dimension", "signals"))
    return dim.select(*keys, "band", "dimension", F.explode("signals").alias("s")).select(*keys, "band", "dimension", "s.*")


def prediction_log(document: DataFrame, keys: list[str]) -> DataFrame:
    """Log rows of a forecast, numbers rounded to four places."""
    flat = flatten_bands(document, keys)
    return flat.withColumns({c: F.round(c, 4) for c in ("prob", "cv_auc", "cv_std")}).withColumn("tier", F.coalesce("tier", F.lit("")))


def auc_log(bank: DataFrame, keys: list[str]) -> DataFrame:
    """One row per trained model, numbers rounded to four places."""
    return bank.filter(F.col("status") == "trained").select(
        *keys, "outcome", "lookback", "horizon", *[F.round(c, 4).alias(c) for c in ("cv_auc", "cv_std", "pos_rate")], "n")


def freshness(analysis: DataFrame, training: DataFrame, keys: list[str]) -> DataFrame:
    """Is a trained bank older than the latest analysis? Inputs: keys, at."""
    a = analysis.groupBy(*keys).agg(F.max("at").alias("analysed_at"))
    t = training.groupBy(*keys).agg(F.max("at").alias("trained_at"))
    state = (F.when(F.col("trained_at").isNull(), "not trained").when(F.col("trained_at") < F.col("analysed_at"), "outdated")
              .otherwise("current"))
    return a.join(t, keys, "left").withColumn("state", state)


# ── insights ──────────────────────────────────────────────────────────────────

def signal_features(signals: DataFrame, importance: DataFrame, corr: DataFrame, keys: list[str], n_signals: int = 5,
                    n_features: int = 4) -> DataFrame:
    """Top features of the most probable passing signals, with the sign of their correlation.

    ``importance``: keys, outcome, feature, importance; ``corr``: keys, feature, outcome, r.
    """
    w = Window.partitionBy(*keys)
    top = (signals.filter("passes").withColumn("signal_rank", F.row_number().over(w.orderBy(F.desc("prob"), "outcome")))
           .filter(F.col("signal_rank") <= n_signals).select(*keys, "outcome", "label", "prob", "tier", "signal_rank"))
    per = Window.partitionBy(*keys, "outcome").orderBy(F.desc("importance"), "feature")
    ranked = importance.withColumn("feature_rank", F.row_number().over(per)).filter(F.col("feature_rank") <= n_features)
    return with_direction(top.join(ranked, [*keys, "outcome"]), corr, keys)


def with_direction(df: DataFrame, corr: DataFrame, keys: list[str]) -> DataFrame:
    r = F.coalesce("r", F.lit(0.0))
    return (df.join(corr, [*keys, "feature", "outcome"], "left").withColumn("r", r)
            .withColumn("direction", F.when(F.col("r") >= 0, "positive").otherwise("negative")))


def readable(c: Column) -> Column:
    return tx.readable_feature(c, K.EXACT_LABELS, K.SIGNAL_LABELS, K.SUFFIX_LABELS)


def feature_influence(signals: DataFrame, importance: DataFrame, corr: DataFrame, keys: list[str], top: int = 8) -> DataFrame:
    """Features by probability-weighted mean importance over the passing signals."""
    passing = signals.filter("passes").select(*keys, "outcome", "prob")
    rated = with_direction(passing.join(importance, [*keys, "outcome"]), corr, keys)
    mean = rated.groupBy(*keys, "feature").agg(
        F.avg(F.col("importance") * F.col("prob")).alias("importance"), F.avg("r").alias("r"))
    w = Window.partitionBy(*keys).orderBy(F.desc("importance"), "feature")
    return (mean.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
            .withColumn("readable", readable(F.col("feature")))
            .withColumn("direction", F.when(F.col("r") >= 0, "positive").otherwise("negative")))


def notable_combinations(signals: DataFrame, corr: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation patterns behind the passing signals: combination, 3- and 7-day lead, and for site types season and defence."""
    passing = signals.filter("passes").select(*keys, "outcome", "dimension")
    c = passing.join(corr.filter(F.col("r").isNotNull()), [*keys, "outcome"]).withColumn("size", F.abs("r"))
    kind = (
        F.when((F.col("feature") == "s_mention_x_s_report") & (F.col("size") > 0.07), "combination")
        .when(F.col("feature").endswith("_lag3") & (F.col("size") > 0.06), "lead_3d")
        .when(F.col("feature").endswith("_lag7") & (F.col("size") > 0.06), "lead_7d")
        .when((F.col("feature") == "is_heating_season") & (F.col("dimension") == K.TYPE_DIMENSION), "season"))
    defence = F.col("feature").contains("defence") & (F.col("dimension") == K.TYPE_DIMENSION) & (F.col("size") > 0.05)
    kinds = F.array_compact(F.array(kind, F.when(defence, "defence")))
    best = F.max_by(F.struct("feature", "outcome", "r", "size"), F.struct("size", "feature", "outcome"))
    rows = c.withColumn("pattern", F.explode(kinds)).groupBy(*keys, "pattern").agg(
        best.alias("b"), F.avg("r").alias("mean_r"), F.max("size").alias("_top"))
    r = F.when(F.col("pattern") == "season", F.col("mean_r")).otherwise(F.col("b.r"))
    limit = F.when(F.col("pattern") == "defence", 0.08).otherwise(0.10)
    strength = (F.when(F.col("pattern") == "combination", "notable").when(F.col("pattern") == "season", "seasonal")
                 .when(F.abs("r") >= limit, "notable").otherwise("moderate"))
    return (rows.filter((F.col("pattern") != "season") | (F.col("_top") > 0.05))
            .select(*keys, "pattern", F.col("b.feature").alias("feature"), F.col("b.outcome").alias("outcome"), r.alias("r"))
            .withColumn("strength", strength))
