"""Helpers of the registered plans. The cached ones keep a lazy plan per session, no data."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide.operators import daily
from sigtide.rules import demo_pack
from sigtide.sources import testdata as td

PACK = demo_pack()
SHORT, LONG = ["channel"], ["macro_area"]


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


@lru_cache(maxsize=16)
def signals_short(spark: SparkSession, sf: str) -> DataFrame:
    from sigtide import constants as K
    flags = td.event_flags(td.table(spark, sf, "events"))
    return flags.groupBy("date", "channel").agg(*[F.count_if(s).alias(s) for s in K.SIGNALS], F.count("*").alias("msg_count"))


@lru_cache(maxsize=16)
def short_daily(spark: SparkSession, sf: str) -> DataFrame:
    inc = daily.daily_incidents(td.incidents_short(spark, sf), td.reach_short(spark), SHORT)
    return daily.full_daily(inc, signals_short(spark, sf), SHORT)


@lru_cache(maxsize=16)
def long_daily(spark: SparkSession, sf: str) -> DataFrame:
    inc = daily.daily_incidents(td.incidents_long(spark, sf), td.reach_long(spark, sf), LONG)
    return daily.full_daily(inc, td.signals_long(spark, sf), LONG)
