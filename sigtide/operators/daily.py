"""Daily rollups and the gap-free daily frame. Everything is keyed by a list of series columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions import scoring
from sigtide.functions import text as tx
from sigtide.operators import incidents as inc
from sigtide.operators.areas import with_reach


def daily_incidents(incidents: DataFrame, reach: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series and day: count, significant, reach and the six incident counters.

    Incidents shrink to one row per (series, area, day) before the repeat window, so a hot area
    costs the window no more than its calendar days.
    """
    act = inc.active(incidents)
    sig = scoring.significant(F.col("confirmed"), F.col("fire"), F.col("severity")).cast("int")
    group = list(dict.fromkeys([*keys, "area", "macro_area", "date"]))
    compact = act.groupBy(*group).agg(
        F.count("*").alias("inc_count"),
        F.max(sig).alias("significant"),
        F.sum(F.col("fire").cast("int")).alias("fire_count"),
        F.sum(F.col("confirmed").cast("int")).alias("hit_count"),
        F.sum(F.col("shutdown").cast("int")).alias("shutdown_count"),
        F.sum("explosions").alias("explosion_total"),
        F.sum(F.col("combined").cast("int")).alias("combined_count"),
    )
    w = (Window.partitionBy("area").orderBy(inc.day_number("date")).rangeBetween(-K.REPEAT_DAYS, -1))
    repeated = (F.count("*").over(w) > 0).cast("int") * F.col("inc_count")
    scored = with_reach(compact.withColumn("_repeated", repeated), reach)
    return scored.groupBy(*keys, "date").agg(
        F.sum("inc_count").alias("inc_count"), F.max("significant").alias("significant"),
        F.max("reach_score").alias("reach_score"), F.sum("fire_count").alias("fire_count"),
        F.sum("hit_count").alias("hit_count"), F.sum("shutdown_count").alias("shutdown_count"),
        F.sum("explosion_total").alias("explosion_total"), F.sum("combined_count").alias("combined_count"),
        F.sum("_repeated").alias("repeated_count"),
    )


def daily_timeline(incidents: DataFrame, keys: list[str]) -> DataFrame:
    """Timeline rollup: count, five sums, mean severity, and the 7-event-day trailing mean."""
    def total(c: str) -> Column:
        return F.sum(F.col(c).cast("int"))
    daily = inc.active(incidents).groupBy(*keys, "date").agg(
        F.count("*").alias("inc_count"), total("fire").alias("fire_count"), total("confirmed").alias("hits"),
        total("shutdown").alias("shutdowns"), total("defended").alias("defended_count"),
        total("combined").alias("combined_count"),
        F.avg(scoring.severity_rank(F.col("severity"))).alias("avg_severity"),
    )
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-6, 0)
    return daily.withColumn("rolling_7d", F.avg("inc_count").over(w))


def intense_days(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Event days flagged ``intense`` at or above the 75th percentile; threshold 3 for up to four days."""
    days = daily.filter(F.col("inc_count") > 0)
    limits = days.groupBy(*keys).agg(F.percentile("inc_count", F.lit(0.75)).alias("_p75"), F.count("*").alias("_n"))
    limit = F.when(F.col("_n") > 4, F.col("_p75")).otherwise(F.lit(3.0))
    return (days.join(limits, keys).withColumn("threshold", limit)
            .withColumn("intense", F.col("inc_count") >= F.col("threshold")).drop("_p75", "_n"))


def date_spine(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every calendar day between the first and the last date of each series."""
    bounds = df.groupBy(*keys).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return bounds.select(*keys, F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))


def full_daily(inc_daily: DataFrame, sig_daily: DataFrame, keys: list[str], extra: DataFrame | None = None) -> DataFrame:
    """Incident and signal counters of every day of each series, 0 where there is nothing.

    Both sides hold at most one row per (series, day), so the spine joins reduce to one union and
    one grouped sum; gaps are filled from the next date of the series. One shuffle per step, no join.
    ``extra`` adds further 0/1 day columns (site types) without stretching the date range.
    """
    inc_cols, sig_cols = [c for c in K.INCIDENT_DAILY if c in inc_daily.columns], K.SIGNALS
    cols = [*inc_cols, *sig_cols]
    extra_cols = [] if extra is None else [c for c in extra.columns if c not in (*keys, "date")]

    def padded(df: DataFrame, real: bool) -> DataFrame:
        every = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) if c in df.columns else F.lit(0).cast("bigint").alias(c)
                 for c in [*cols, *extra_cols]]
        return df.select(*keys, "date", *every, F.lit(real).alias("_real"))

    parts = padded(inc_daily, True).unionByName(padded(sig_daily, True))
    if extra is not None:
        parts = parts.unionByName(padded(extra, False))
    days = parts.groupBy(*keys, "date").agg(*[F.sum(c).alias(c) for c in [*cols, *extra_cols]],
                                            F.bool_or("_real").alias("_real"))
    if extra is not None:
        days = days.filter("_real")
    w = Window.partitionBy(*keys).orderBy("date")
    last = F.date_sub(F.coalesce(F.lead("date").over(w), F.date_add("date", 1)), 1)
    gaps = days.withColumn("_last", last)
    filled = gaps.select(*keys, *cols, *extra_cols,
                         F.posexplode(F.sequence("date", "_last", F.expr("interval 1 day"))).alias("_gap", "_day"))
    here = F.col("_gap") == 0
    out = filled.select(*keys, F.col("_day").alias("date"),
                        *[F.when(here, F.col(c)).otherwise(0).alias(c) for c in [*cols, *extra_cols]])
    return with_internal(out)


def with_internal(df: DataFrame) -> DataFrame:
    """Derived signal: broad minus cross, never below zero."""
    return df.withColumn(K.DERIVED_SIGNAL, F.greatest(F.col("s_broad") - F.col("s_cross"), F.lit(0)))


def latest_rows(signals: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The latest n days of each series."""
    w = Window.partitionBy(*keys).orderBy(F.desc("date"))
    return signals.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def fill_signals(signals: DataFrame) -> DataFrame:
    return signals.fillna(0, subset=[c for c in K.SIGNALS if c in signals.columns])


def recent_reach(incidents: DataFrame, reach: DataFrame, keys: list[str], as_of: dt.date, lookback: int) -> DataFrame:
    """Highest reach score among active incidents of the last ``lookback`` days up to ``as_of``."""
    day = F.lit(as_of)
    recent = inc.active(incidents).filter((F.col("date") >= F.date_sub(day, lookback)) & (F.col("date") <= day))
    per_macro = recent.groupBy(*keys, "macro_area").agg(F.count("*").alias("n"))
    return with_reach(per_macro, reach).groupBy(*keys).agg(
        F.max("reach_score").alias("reach"), F.sum("n").alias("n"))


def frequent_types(linked: DataFrame, least: int = K.MIN_TYPE_OCCURRENCES) -> DataFrame:
    """Site types with at least ``least`` linked incidents, normalised and without soft values."""
    return (typed(linked).groupBy("site_type").agg(F.count("*").alias("n")).filter(F.col("n") >= least))


def typed(linked: DataFrame) -> DataFrame:
    t = F.lower(F.trim("site_type"))
    return (linked.filter(F.col("site_type").isNotNull() & ~t.isin("unknown", "other", ""))
            .withColumn("site_type", t))


def type_outcomes(linked: DataFrame, keys: list[str], least: int = K.MIN_TYPE_OCCURRENCES) -> DataFrame:
    """Long form of the frequent site types: distinct (keys, date, outcome), the outcome named as its column would be.

    Types are what the rows hold, at least ``least`` linked incidents in all; two that give one name are one outcome. Rows collapse to
    (series, day, type) first, so a type that a third of all rows share is no more than its days.
    """
    days = typed(linked).groupBy(*keys, "date", "site_type").agg(F.count("*").alias("n"))
    often = days.groupBy("site_type").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("site_type")
    return days.join(often, "site_type").select(*keys, "date", tx.column_name_of(F.col("site_type")).alias("outcome")).distinct()


def type_columns(outcomes: DataFrame, most: int = K.MAX_TYPE_COLUMNS) -> list[str]:
    """Names of the outcomes in order, for the wide form; more than ``most`` are an error, not a cut: the long form has no such bound."""
    names = [r["outcome"] for r in outcomes.select("outcome").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"over {most} site types; use the long form")
    return sorted(names)


def type_days(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Wide form of ``type_outcomes``: one 0/1 column per type, a row per series and day that has any."""
    names = type_columns(outcomes)
    if not names:
        return outcomes.select(*keys, "date").distinct()
    wide = outcomes.groupBy(*keys, "date").pivot("outcome", names).agg(F.lit(1))
    return wide.select(*keys, "date", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in names])


def dataset_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
