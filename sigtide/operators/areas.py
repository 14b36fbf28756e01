"""Area hierarchy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide.rules import RulePack


def reach_table(spark: SparkSession, rows: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "macro_area string, reach_score int")


def area_table(spark: SparkSession, pack: RulePack) -> DataFrame:
    return spark.createDataFrame(pack.areas, "area string, macro_area string, reach_score int")


def with_macro_area(df: DataFrame, areas: DataFrame) -> DataFrame:
    """Left join on the area table; areas outside the hierarchy get null."""
    return df.join(areas.select("area", "macro_area"), "area", "left")


def with_reach(df: DataFrame, reach: DataFrame) -> DataFrame:
    """Reach score of the macro area, 0 when unknown. Catalyst broadcasts the table while it is small."""
    return (df.join(reach.select("macro_area", "reach_score"), "macro_area", "left")
              .withColumn("reach_score", F.coalesce("reach_score", F.lit(0))))
